"""Query plans over the catalog tables."""
