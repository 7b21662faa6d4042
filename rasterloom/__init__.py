"""Raster tile analytics as DataFrames: catalog, extent joins, map algebra, neighbourhoods, pyramids, files."""
