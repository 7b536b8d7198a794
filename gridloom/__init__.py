"""Raster and time-series analytics on Spark: cells are rows, dates are rows, what was not observed is NULL."""
