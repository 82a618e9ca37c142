"""Catalog search, change tracking and corpus preparation on Spark."""
