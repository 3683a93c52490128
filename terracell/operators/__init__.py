"""Operators on DataFrames with a spatio-temporal column: filters, joins, neighbours, cells, skylines, clusters, rasters."""
