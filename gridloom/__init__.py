"""Raster and geometry analytics as Spark DataFrame operations."""
