"""Neighbourhood operators on whole tiles, with an exchange of border strips.

A tile sends each neighbour within the radius only the cells that it can see: strips of r x size cells along its edges, r x r
corners, and for a radius beyond a tile the strips of tiles further away. What meets at a tile is laid out as one array of
(size + 2 r) squared cells, whatever the layer's size, and a numpy kernel makes the tile of it: box means by a summed-area
table, whatever the radius, terrain from shifted views. Tiles that are not there count as no data and get no result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rasterloom.operators.raster import BIG

#: A kernel: (values, which have data, radius) of a laid-out tile to (values, which have data) of the tile itself.
Kernel = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def span(step: int, size: int, radius: int) -> tuple[int, int]:
    """First and last cell (exclusive), along one axis, of a tile that the tile `step` tiles further on can see."""
    near = radius - (abs(step) - 1) * size
    if step == 0 or near >= size:
        return 0, size
    return (size - near, size) if step > 0 else (0, near)


def strips(tiles: DataFrame, keys: list[str], size: int, radius: int) -> DataFrame:
    """Every tile (keys, col, row, cells) for itself, and its strips for the tiles around: dc and dr tell how many tiles a strip has come."""
    ring, names = -(-radius // size), [*keys, "col", "row", "dc", "dr", "cells"]
    steps = [(dc, dr) for dc in range(-ring, ring + 1) for dr in range(-ring, ring + 1)]

    def run(batches):
        grid, index = np.arange(size * size).reshape(size, size), {}
        for dc, dr in steps:
            (x0, x1), (y0, y1) = span(dc, size, radius), span(dr, size, radius)
            index[dc, dr] = pa.array(grid[y0:y1, x0:x1].ravel())
        for b in batches:
            cells = b.column(len(keys) + 2)
            own = [b.column(i) for i in range(len(keys))]
            for i in range(b.num_rows):
                values, (col, row) = cells[i].values, (b.column(len(keys) + k)[i].as_py() for k in (0, 1))
                parts = [values.take(index[s]) for s in steps]
                # strips without data say nothing
                sent = [k for k, s in enumerate(steps) if s == (0, 0) or parts[k].null_count < len(parts[k])]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(parts[k]) for k in sent)]), pa.int32()), pa.concat_arrays([parts[k] for k in sent]))
                place = [pa.array([v[k] for k in sent], pa.int32()) for v in ([col + dc for dc, _ in steps], [row + dr for _, dr in steps], [s[0] for s in steps], [s[1] for s in steps])]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(c[i], len(sent)) for c in own), *place, lists], names)

    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "col int, row int, dc int, dr int", f"cells {types['cells']}"])
    return tiles.select(*keys, "col", "row", "cells").mapInArrow(run, schema)


def apply_with_halo(tiles: DataFrame, size: int, radius: int, kernel: Kernel, kind: str = "bigint", keys: list[str] | None = None) -> DataFrame:
    """kernel of every tile (keys, col, row, cells) with its surroundings; kind: the result's cells.

    keys: what tells layers apart (band, if not given). One shuffle: a tile once, and its strips.
    """
    keys = keys or ["band"]
    types = {f.name: f.dataType.simpleString() for f in tiles.schema.fields}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[kind]
    wide = size + 2 * radius

    def make(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        steps = list(zip(table["dc"].to_pylist(), table["dr"].to_pylist()))
        if (0, 0) not in steps:
            return table.select([*keys, "col", "row", "cells"]).slice(0, 0).cast(pa.schema([*(table.schema.field(c) for c in (*keys, "col", "row")), ("cells", pa.list_(arrow))]))
        cells = table["cells"].combine_chunks()
        values, has = np.zeros((wide, wide), cells.type.value_type.to_pandas_dtype()), np.zeros((wide, wide), bool)
        for i, (dc, dr) in enumerate(steps):
            # a strip that has come dc tiles to the east lies dc tiles to the west
            (x0, x1), (y0, y1) = span(dc, size, radius), span(dr, size, radius)
            at = slice(radius + y0 - dr * size, radius + y1 - dr * size), slice(radius + x0 - dc * size, radius + x1 - dc * size)
            part = cells[i].values
            has[at] = part.is_valid().to_numpy(zero_copy_only=False).reshape(y1 - y0, x1 - x0)
            values[at] = part.fill_null(0).to_numpy(zero_copy_only=False).reshape(y1 - y0, x1 - x0)
        out, ok = kernel(values, has, radius)
        row = table.slice(steps.index((0, 0)), 1)
        made = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(out.ravel(), arrow, mask=~ok.ravel()))
        return pa.table([*(row[c] for c in (*keys, "col", "row")), made], [*keys, "col", "row", "cells"])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"col int, row int, cells array<{kind}>"])
    return strips(tiles, keys, size, radius).groupBy(*keys, "col", "row").applyInArrow(make, schema)


def boxes(a: np.ndarray, radius: int) -> np.ndarray:
    """Sums of the (2 r + 1) squares around the inner cells, from a summed-area table."""
    table = np.zeros((a.shape[0] + 1, a.shape[1] + 1), np.float64 if a.dtype.kind == "f" else np.int64)
    np.cumsum(np.cumsum(a, axis=0, dtype=table.dtype), axis=1, out=table[1:, 1:])
    d = 2 * radius + 1
    return table[d:, d:] - table[:-d, d:] - table[d:, :-d] + table[:-d, :-d]


def mean_kernel(values: np.ndarray, has: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Truncated mean of the cells with data; none where the square has no data."""
    total, count = boxes(np.where(has, values, 0), radius), boxes(has.astype(np.int64), radius)
    some = np.maximum(count, 1)
    mean = np.trunc(total / some) if total.dtype.kind == "f" else np.sign(total) * (np.abs(total) // some)
    return mean.astype(np.int64), count > 0


def whole(v: np.ndarray) -> np.ndarray:
    """Truncated to a 32-bit integer that saturates."""
    return np.trunc(np.clip(v, -BIG - 1, BIG)).astype(np.int64)


def terrain_kernel(name: str, cell: float = 1.0, centre: bool = False) -> Kernel:
    """slope or aspect of a 3 x 3 window, as `raster.terrain` defines them; null where one of the eight around has no data."""
    if name not in ("slope", "aspect"):
        raise ValueError(f"no terrain function {name!r}; there are slope, aspect")

    def kernel(values, has, radius):
        v = values.astype(np.float64)
        n = len(v) - 2 * radius
        at = lambda a, dx, dy: a[radius + dy : radius + dy + n, radius + dx : radius + dx + n]
        around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
        ok = np.logical_and.reduce([at(has, *s) for s in around])
        if centre:
            ok = ok & at(has, 0, 0)
        dx = ((at(v, 1, -1) + 2 * at(v, 1, 0) + at(v, 1, 1)) - (at(v, -1, -1) + 2 * at(v, -1, 0) + at(v, -1, 1))) / cell
        dy = ((at(v, -1, 1) + 2 * at(v, 0, 1) + at(v, 1, 1)) - (at(v, -1, -1) + 2 * at(v, 0, -1) + at(v, 1, -1))) / cell
        with np.errstate(all="ignore"):
            if name == "slope":
                out = np.where(dy == 0, np.where(dx > 0, BIG, 0), whole(np.nan_to_num(dx / dy * 100, posinf=BIG, neginf=-BIG - 1)))
                ok = ok & ~((dy == 0) & (dx < 0))
            else:
                out = np.where(dx == 0, 0, np.where(dy == 0, BIG, whole(np.nan_to_num(1 / np.tan(dy / dx), posinf=BIG, neginf=-BIG - 1))))
                ok = ok & ((dx == 0) | ~((dy == 0) & (dx < 0)))
        return out, ok

    return kernel


def focal_mean(tiles: DataFrame, size: int, radius: int, keys: list[str] | None = None) -> DataFrame:
    """Tiles of the truncated box mean, for any radius."""
    return apply_with_halo(tiles, size, radius, mean_kernel, "bigint", keys)


def terrain(tiles: DataFrame, size: int, name: str, cell: float = 1.0, centre: bool = False, keys: list[str] | None = None) -> DataFrame:
    """Tiles of slope or aspect."""
    return apply_with_halo(tiles, size, 1, terrain_kernel(name, cell, centre), "bigint", keys)
