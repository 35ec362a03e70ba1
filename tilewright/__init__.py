"""Slide, raster-grid and annotation analytics as Spark DataFrame operators."""
