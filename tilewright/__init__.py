"""Tiled raster and annotation analytics as Spark DataFrame plans."""
