"""Whole jobs: bulk migration and change sync."""
