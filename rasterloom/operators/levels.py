"""Pyramids of whole tiles: each level is put together from quarters of the one below.

A tile carries the sum and the number of the cells with data under each of its cells. For the level above it sends its parent
a quarter of these, halved along both axes, so a level moves a quarter of the cells of the one below and no row is a pixel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

NAMES = ["band", "col", "row", "s", "c"]


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    at = np.cumsum([0, *(a.size for a in arrays)])
    flat = np.concatenate([a.ravel() for a in arrays]) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind))


def sums_of(tiles: DataFrame) -> DataFrame:
    """Tiles with sum s and number c for each cell, 0 where there is no data."""

    def run(batches):
        for b in batches:
            cells = [b.column(3)[i].values for i in range(b.num_rows)]
            counts = [c.is_valid().to_numpy(zero_copy_only=False).astype(np.int64) for c in cells]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], lists([c.fill_null(0).to_numpy(zero_copy_only=False).astype(float) for c in cells], pa.float64()), lists(counts, pa.int64())], NAMES)

    return tiles.select("band", "col", "row", "cells").mapInArrow(run, schema_of(tiles))


def schema_of(tiles: DataFrame) -> str:
    return f"band {tiles.schema['band'].dataType.simpleString()}, col int, row int, s array<double>, c array<bigint>"


def level_above(sums: DataFrame, size: int) -> DataFrame:
    """The tiles above those with sums, each from the quarters that are there."""
    half = size // 2

    def halve(batches):
        for b in batches:
            parts = [[b.column(k)[i].values.to_numpy(zero_copy_only=False).reshape(half, 2, half, 2).sum(axis=(1, 3)) for i in range(b.num_rows)] for k in (3, 4)]
            col, row = (b.column(k).to_numpy() for k in (1, 2))
            place = [pa.array(v, pa.int32()) for v in (col >> 1, row >> 1, (col & 1) + 2 * (row & 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *place, lists(parts[0], pa.float64()), lists(parts[1], pa.int64())], ["band", "col", "row", "q", "s", "c"])

    def assemble(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        out = [np.zeros((size, size)), np.zeros((size, size), np.int64)]
        for i, q in enumerate(table["q"].to_pylist()):
            at = slice(half * (q // 2), half * (q // 2) + half), slice(half * (q % 2), half * (q % 2) + half)
            for a, name in zip(out, ("s", "c")):
                a[at] = table[name][i].values.to_numpy(zero_copy_only=False).reshape(half, half)
        return pa.table([*(table[c].slice(0, 1) for c in NAMES[:3]), lists(out[:1], pa.float64()), lists(out[1:], pa.int64())], NAMES)

    kinds = schema_of(sums)
    quarters = sums.select(*NAMES).mapInArrow(halve, kinds.replace("row int,", "row int, q int,"))
    return quarters.groupBy("band", "col", "row").applyInArrow(assemble, kinds)


def pyramid_tiles(tiles: DataFrame, levels: int, size: int) -> DataFrame:
    """Tiles (level, band, col, row, cells) of the means of 2^k x 2^k cells with data, for k from 0 to levels; null where none has.

    size: cells of a tile's side at every level, an even number.
    """
    if size % 2:
        raise ValueError("tiles of an even number of cells a side")
    sums, out = sums_of(tiles), None
    mean = F.transform(F.arrays_zip("s", "c"), lambda x: F.try_divide(x["s"], x["c"]))
    for k in range(levels + 1):
        part = sums.select(F.lit(k).alias("level"), "band", "col", "row", mean.alias("cells"))
        out = part if out is None else out.unionByName(part)
        if k < levels:
            sums = level_above(sums, size)
    return out
