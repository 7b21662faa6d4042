"""Table functions for SQL: tiles of a box, cells of a tile, the index of a file.

`register(spark)` makes them known by name, for lateral calls: `SELECT ... FROM supplier, LATERAL box_tiles(w, s, e, n, 11)`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegerType, IntegralType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rasterloom.functions.grid import MAX_ZOOM
from rasterloom.sources.cog import INDEX, index_rows


#: Rows of an index. Types stand as objects, as functions are analysed where no session is.
ROWS = StructType([StructField(n, {"string": StringType(), "int": IntegerType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType()}[k]) for n, k in (x.split() for x in INDEX.split(", "))])


def numbers(args: dict[str, AnalyzeArgument], kinds: tuple[type[DataType], ...]) -> None:
    for name, a in args.items():
        if a.isTable or not isinstance(a.dataType, kinds):
            raise ValueError(f"{name} must be a number of another kind than {a.dataType.simpleString()}")


class BoxTiles:
    """(west, south, east, north, zoom): col and row of every Web-Mercator tile that the box meets; none if a value is null."""

    @staticmethod
    def analyze(west: AnalyzeArgument, south: AnalyzeArgument, east: AnalyzeArgument, north: AnalyzeArgument, zoom: AnalyzeArgument) -> AnalyzeResult:
        numbers({"west": west, "south": south, "east": east, "north": north}, (DoubleType, FloatType))
        numbers({"zoom": zoom}, (IntegralType,))
        if zoom.isConstantExpression and zoom.value is not None and not 0 <= zoom.value <= MAX_ZOOM:
            raise ValueError(f"zoom must be from 0 to {MAX_ZOOM}")
        return AnalyzeResult(StructType().add("col", IntegerType()).add("row", IntegerType()))

    def eval(self, west: float, south: float, east: float, north: float, zoom: int) -> Iterator[tuple[int, int]]:
        if None in (west, south, east, north, zoom):
            return
        n = 1 << zoom
        row = lambda lat: math.floor((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)
        for col in range(math.floor((west + 180) / 360 * n), math.floor((east + 180) / 360 * n) + 1):
            for r in range(row(north), row(south) + 1):
                yield col, r


class TileCells:
    """(col, row, cells, size): y, x and v of every cell of a tile that has data; v has the cells' own type."""

    @staticmethod
    def analyze(col: AnalyzeArgument, row: AnalyzeArgument, cells: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        numbers({"col": col, "row": row, "size": size}, (IntegralType,))
        if cells.isTable or not isinstance(cells.dataType, ArrayType):
            raise ValueError("cells must be an array")
        return AnalyzeResult(StructType().add("y", IntegerType()).add("x", IntegerType()).add("v", cells.dataType.elementType))

    def eval(self, col: int, row: int, cells: list, size: int) -> Iterator[tuple]:
        for i, v in enumerate(cells or ()):
            if v is not None:
                yield row * size + i // size, col * size + i % size, v


class CogTiles:
    """(path): the rows of a file's tile index; none for null."""

    @staticmethod
    def analyze(path: AnalyzeArgument) -> AnalyzeResult:
        if path.isTable or path.dataType.simpleString() != "string":
            raise ValueError("path must be a string")
        return AnalyzeResult(ROWS)

    def eval(self, path: str) -> Iterator[tuple]:
        for batch in index_rows(path) if path is not None else ():
            yield from zip(*(c.to_pylist() for c in batch.columns))


FUNCTIONS = {"box_tiles": BoxTiles, "tile_cells": TileCells, "cog_tiles": CogTiles}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, udtf(function))
