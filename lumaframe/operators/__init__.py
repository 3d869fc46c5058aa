"""Raster operators as joins, windows and aggregates."""
