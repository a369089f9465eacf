"""Raster operators on DataFrames."""
