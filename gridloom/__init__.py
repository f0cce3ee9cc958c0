"""Zonal statistics over rasters and polygons as Spark DataFrames."""
