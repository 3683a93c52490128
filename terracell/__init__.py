"""Spatio-temporal and raster analytics on Spark DataFrames."""
