"""The Web-Mercator tile grid and pixel addresses, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

HALF = 20037508.342789244  # half the world's width in metres
RADIUS = 6378137.0
MAX_ZOOM = 20


def resolution(zoom: Column) -> Column:
    """Metres per pixel of a 256-pixel tile, at six decimals."""
    return F.round(F.lit(156543.033928) / F.pow(F.lit(2.0), zoom), 6)


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row (southwards) of the tile that holds a point."""
    n, phi = float(1 << zoom), F.radians(lat)
    col = F.floor((lon + 180) / 360 * n)
    row = F.floor((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)
    return col.cast("int"), row.cast("int")


def tile_corner(col: Column, row: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's north-west corner; that of (col + 1, row + 1) is the south-east one."""
    n = float(1 << zoom)
    return col / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))


def tile_extent(col: Column, row: Column, zoom: int) -> Column:
    """Geographic extent of a tile as a struct."""
    west, north = tile_corner(col, row, zoom)
    east, south = tile_corner(col + 1, row + 1, zoom)
    return F.struct(west.alias("xmin"), south.alias("ymin"), east.alias("xmax"), north.alias("ymax"))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * RADIUS, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(F.atan(F.sinh(y / RADIUS)))


def tiles_of_box(spark: SparkSession, box: tuple[float, float, float, float], zoom: int) -> DataFrame:
    """col and row of all tiles that meet (lng_min, lat_min, lng_max, lat_max)."""
    west, south, east, north = (F.lit(float(v)) for v in box)
    (c0, r0), (c1, r1) = tile_of(west, north, zoom), tile_of(east, south, zoom)
    one = spark.range(1).select(F.explode(F.sequence(c0, c1)).alias("col"), r0.alias("r0"), r1.alias("r1"))
    return one.select("col", F.explode(F.sequence("r0", "r1")).alias("row"))


def box_tiles(boxes: DataFrame, zoom: int, box: tuple[str, str, str, str] = ("xmin", "ymin", "xmax", "ymax")) -> DataFrame:
    """Rows of boxes (columns of west, south, east, north), each with col and row of every tile that its box meets."""
    west, south, east, north = (F.col(c) for c in box)
    (c0, r0), (c1, r1) = tile_of(west, north, zoom), tile_of(east, south, zoom)
    across = boxes.withColumn("col", F.explode(F.sequence(c0, c1)))
    return across.withColumn("row", F.explode(F.sequence(r0, r1)))


def morton(col: Column, row: Column, bits: int = 16) -> Column:
    """Z-curve index: the bits of col and row interleaved, col's lowest."""
    z = F.lit(0).cast("long")
    for i in range(bits):
        for k, v in enumerate((col, row)):
            z = z + F.shiftleft(F.shiftright(v, i).bitwiseAND(1).cast("long"), 2 * i + k)
    return z


def pixel_of(tile: Column, index: Column, size: int, across: bool) -> Column:
    """Global pixel coordinate of cell `index` of a tile of size x size cells."""
    return (tile * size + (index % size if across else F.floor(index / size))).cast("int")


def tile_key(layer: Column, zoom: Column, kind: Column, col: Column, row: Column) -> Column:
    """layer/zoom/format/col-row"""
    return F.concat_ws("/", layer, zoom.cast("string"), kind, F.concat_ws("-", col.cast("string"), row.cast("string")))


def parse_tile_key(key: Column) -> list[Column]:
    """layer, zoom, format, col and row of a tile key; null where a number is none."""
    place = F.split_part(key, F.lit("/"), F.lit(4))
    number = lambda c: c.try_cast("int")
    return [
        F.split_part(key, F.lit("/"), F.lit(1)).alias("layer"), number(F.split_part(key, F.lit("/"), F.lit(2))).alias("zoom"),
        F.split_part(key, F.lit("/"), F.lit(3)).alias("kind"), number(F.split_part(place, F.lit("-"), F.lit(1))).alias("col"),
        number(F.split_part(place, F.lit("-"), F.lit(2))).alias("row"),
    ]
