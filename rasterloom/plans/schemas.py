"""Schemas of the tables that the engine reads and writes."""

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
PLACE = "array<struct<col:int,row:int>>"
COVERAGE = f"coverage_id string, path string, geom_wkt string, extent {BOX}, measurement string, measurement_rank int, time timestamp_ntz, crs string, data_type string, resolution double"
PIXELS = "layer_id string, band int, y int, x int, v double"
TILES = "layer_id string, zoom int, col int, row int, band int, cells array<double>"
RAW_TILE = f"path string, time timestamp_ntz, measurement string, measurement_rank int, coverage_id string, extent {BOX}, col int, row int, offset long, byte_count long, crs string, data_type string, cells array<double>, proj_codes {PLACE}"
REQUEST = "layer_id string, zoom int, col int, row int"
STORED = "layer string, zoom int, kind string, col int, row int, image binary"
