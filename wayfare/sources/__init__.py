"""Catalogs from files and databases."""
