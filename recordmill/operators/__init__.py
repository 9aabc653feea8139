"""DataFrame -> DataFrame operators the plans are composed of."""
