"""Operators on page logs and file catalogs."""
