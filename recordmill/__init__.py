"""recordmill: cleaning business records and reconciling them with a master store, on Spark."""
