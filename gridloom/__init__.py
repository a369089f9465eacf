"""Raster analytics as Spark DataFrames: one row a pixel, one column a channel."""
