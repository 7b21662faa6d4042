"""Reprojection of whole tiles: file tiles are painted onto requested Web-Mercator tiles by inverse mapping.

A file tile is read once, with the requested tiles that the extent join has found for it. The task that has it maps the
cells of each of these back into the file's grid, takes those that fall into the file tile, nearest cell, and sends the
rectangle they fill. Rectangles of one requested tile are merged in order of their sources in one pass over sorted rows:
a task holds one tile, however many sources it has. So nothing is a row for each pixel, and only painted cells are moved.

The mapping is computed for whole scanlines: exactly at their ends, and between them linearly where that is right within a
tolerance (in cells of the file) at the quarter points, else in halves. Tolerance 0 maps every cell exactly.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.functions.projection import ARRAYS, Crs, system

#: Columns of a file tile that `paint` reads: its place in its file's grid, that grid, and the requested tiles (col, row).
SOURCE = ["source", "band", "col", "row", "cells", "tile", "width", "height", "x_min", "y_max", "cell_w", "cell_h", "crs", "codes"]


def centres(col: int, row: int, zoom: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes of a requested tile's columns of cells, latitudes of its rows."""
    n = float(size << zoom)
    lon = (col * size + np.arange(size) + 0.5) / n * 360 - 180
    return lon, np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (row * size + np.arange(size) + 0.5) / n))))


def approximate(exact: Callable, rows: int, cols: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """x and y (rows x cols) of exact(row numbers, column numbers), by scanlines that are halved where linear is too far off."""
    out = np.empty((2, rows, cols))
    r, lo, hi = np.arange(rows), np.zeros(rows, int), np.full(rows, cols - 1)
    at_lo, at_hi = (np.stack(exact(r, c)) for c in (lo, hi))
    while len(r):
        length = hi - lo
        if tolerance > 0:
            good = np.ones(len(r), bool)
            middle = lo + length // 2
            at_middle = np.stack(exact(r, middle))
            for k, at in ((lo + length // 4, None), (middle, at_middle), (lo + length - length // 4, None)):
                at = np.stack(exact(r, k)) if at is None else at
                linear = at_lo + (at_hi - at_lo) * (k - lo) / np.maximum(length, 1)
                good &= np.abs(linear - at).max(axis=0) <= tolerance
            good |= length <= 1
        else:
            # every cell on its own
            y, x = np.mgrid[:rows, :cols]
            out[:] = np.stack(exact(y.ravel(), x.ravel())).reshape(2, rows, cols)
            break
        for n in np.unique(length[good]):
            own = np.flatnonzero(good & (length == n))
            step = np.arange(n + 1)
            line = at_lo[:, own, None] + (at_hi - at_lo)[:, own, None] * (step / max(n, 1))
            out[:, r[own, None], lo[own, None] + step] = line
        bad = ~good
        r, lo, hi, middle, a, b, c = r[bad], lo[bad], hi[bad], middle[bad], at_lo[:, bad], at_middle[:, bad], at_hi[:, bad]
        r, lo, hi = np.concatenate([r, r]), np.concatenate([lo, middle]), np.concatenate([middle, hi])
        at_lo, at_hi = np.concatenate([a, b], axis=1), np.concatenate([b, c], axis=1)
    return out[0], out[1]


def source_cells(crs: Crs, place: tuple[float, float, float, float], col: int, row: int, zoom: int, size: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Column and row (fractions, by cells) in a file's grid of the centres of a requested tile's cells. place: west and north edge, cell size."""
    lon, lat = centres(col, row, zoom, size)
    west, north, w, h = place

    def exact(r, c):
        with np.errstate(all="ignore"):  # far from a system's region its formulas may have no value
            x, y = crs.forward(lon[c], lat[r], ARRAYS)
            return (x - west) / w, (north - y) / h

    return approximate(exact, size, size, tolerance)


class Mapper:
    """Cell numbers of requested tiles in files' grids; those last used are kept, since a file's tiles ask for the same ones."""

    def __init__(self, zoom: int, size: int, tolerance: float, kept: int = 32):
        self.how, self.kept, self.known = (zoom, size, tolerance), kept, OrderedDict()

    def __call__(self, crs: str, place: tuple, col: int, row: int) -> tuple[np.ndarray, np.ndarray]:
        key = crs, place, col, row
        if key in self.known:
            self.known.move_to_end(key)
            return self.known[key]
        x, y = source_cells(system(crs), place, col, row, *self.how)
        got = tuple(np.where(np.isfinite(v), np.clip(np.floor(v), -1, 1 << 30), -1).astype(np.int32) for v in (x, y))
        self.known[key] = got
        if len(self.known) > self.kept:
            self.known.popitem(last=False)
        return got


def window(x: np.ndarray, y: np.ndarray, tile: int, col: int, row: int, width: int, height: int) -> tuple[tuple[slice, slice], np.ndarray, np.ndarray] | None:
    """Which rectangle of a requested tile a file tile fills: its rows and columns, where it does, and the cells' places in the
    file tile; None where it fills none."""
    mine = (x // tile == col) & (y // tile == row) & (x < width) & (y < height) & (x >= 0) & (y >= 0)
    rows, cols = np.flatnonzero(mine.any(axis=1)), np.flatnonzero(mine.any(axis=0))
    if not len(rows):
        return None
    part = slice(int(rows[0]), int(rows[-1]) + 1), slice(int(cols[0]), int(cols[-1]) + 1)
    return part, mine[part], (y[part] - row * tile) * tile + x[part] - col * tile


def paint(tiles: DataFrame, zoom: int, size: int = 256, tolerance: float = 0.05, kept: int = 32) -> DataFrame:
    """File tiles (SOURCE columns) as rectangles of requested ones: source, band, col, row, y and x (of the rectangle's first cell
    in the tile), w, and cells, null where another file tile or none has the cell.

    What several tiles of one source paint of a requested tile is put together in the task before it is sent, for the `kept`
    requested tiles painted last.
    """
    kind = tiles.schema["cells"].dataType.simpleString()
    band = tiles.schema["band"].dataType.simpleString()
    source = tiles.schema["source"].dataType.simpleString()
    names = ["source", "band", "col", "row", "y", "x", "w", "cells"]

    def run(batches):
        mapper, held, types = Mapper(zoom, size, tolerance), OrderedDict(), None

        def sent(keys):
            out = [[] for _ in names]
            for key in keys:
                cells, filled = held.pop(key)
                rows, cols = np.flatnonzero(filled.any(axis=1)), np.flatnonzero(filled.any(axis=0))
                part = slice(rows[0], rows[-1] + 1), slice(cols[0], cols[-1] + 1)
                own = pa.array(cells[part].ravel(), types[2], mask=~filled[part].ravel())
                for k, v in enumerate((*key, int(rows[0]), int(cols[0]), int(cols[-1] - cols[0] + 1), own)):
                    out[k].append(v)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out[7])]), pa.int32()), pa.concat_arrays(out[7]))
            return pa.RecordBatch.from_arrays([*(pa.array(v, t) for v, t in zip(out[:7], (*types[:2], *[pa.int32()] * 5))), lists], names)

        for b in batches:
            at = {c: b.column(b.schema.names.index(c)) for c in SOURCE}
            types = at["source"].type, at["band"].type, at["cells"].type.value_type
            plain = {c: at[c].to_pylist() for c in SOURCE if c != "cells"}
            for i in range(b.num_rows):
                own = {c: v[i] for c, v in plain.items()}
                values = at["cells"][i].values
                has, values = values.is_valid().to_numpy(zero_copy_only=False), values.fill_null(0).to_numpy(zero_copy_only=False)
                for code in own["codes"]:
                    x, y = mapper(own["crs"], (own["x_min"], own["y_max"], own["cell_w"], own["cell_h"]), code["col"], code["row"])
                    if not (found := window(x, y, own["tile"], own["col"], own["row"], own["width"], own["height"])):
                        continue
                    (rows, cols), mine, index = found
                    (r, c), index = np.nonzero(mine), index[mine]
                    good = has[index]
                    if not good.any():
                        continue
                    key = own["source"], own["band"], code["col"], code["row"]
                    if key not in held:
                        held[key] = np.zeros((size, size), values.dtype), np.zeros((size, size), bool)
                    cells, filled = held[key]
                    held.move_to_end(key)
                    r, c = r[good] + rows.start, c[good] + cols.start
                    cells[r, c], filled[r, c] = values[index[good]], True
                if len(held) > kept:
                    yield sent(list(held)[: len(held) - kept])
        while held:
            yield sent(list(held)[:8])

    return tiles.select(*SOURCE).mapInArrow(run, f"source {source}, band {band}, col int, row int, y int, x int, w int, cells {kind}")


def merge(parts: DataFrame, size: int = 256) -> DataFrame:
    """Requested tiles (band, col, row, cells) of painted rectangles: at each cell the first source, in order, that has data.

    Rows are dealt by tile and sorted, so a task goes through a tile's rectangles one after the other with one tile in memory.
    """
    kind, band = (parts.schema[c].dataType.simpleString() for c in ("cells", "band"))

    def run(batches):
        key, cells, clear, form = None, None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], form[0]), *(pa.array([v], pa.int32()) for v in key[1:]), pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(cells.ravel(), form[1], mask=clear.ravel()))], ["band", "col", "row", "cells"])

        for b in batches:
            plain = list(zip(*(b.column(k).to_pylist() for k in range(6))))
            for i, (band_, col, row, y, x, w) in enumerate(plain):
                values = b.column(6)[i].values
                if (band_, col, row) != key:
                    if key:
                        yield done()
                    key, form = (band_, col, row), (b.column(0).type, values.type)
                    cells, clear = np.zeros((size, size), values.type.to_pandas_dtype()), np.ones((size, size), bool)
                if not clear.any():
                    continue  # earlier sources have filled the tile
                has = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, w)
                own = values.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, w)
                part = slice(y, y + len(has)), slice(x, x + w)
                take = clear[part] & has
                cells[part][take] = own[take]
                clear[part] &= ~take
        if key:
            yield done()

    dealt = parts.select("band", "col", "row", "y", "x", "w", "cells", "source").repartition("band", "col", "row").sortWithinPartitions("band", "col", "row", "source", "y", "x")
    return dealt.drop("source").mapInArrow(run, f"band {band}, col int, row int, cells {kind}")


def warp(tiles: DataFrame, zoom: int, size: int = 256, tolerance: float = 0.05) -> DataFrame:
    """Requested tiles (band, col, row, cells) of file tiles (SOURCE columns, with the requested tiles each one meets)."""
    return merge(paint(tiles, zoom, size, tolerance), size)


def mapped_cells(codes: DataFrame, zoom: int, size: int, place: tuple[float, float, float, float], tolerance: float) -> DataFrame:
    """Both mappings of requested tiles (col, row, crs): y and x of each cell, and its column and row in the file's grid,
    exact_x, exact_y and, by the tolerance, near_x, near_y."""
    names = ["col", "row", "y", "x", "exact_x", "exact_y", "near_x", "near_y"]

    def run(batches):
        for b in batches:
            for col, row, crs in zip(*(c.to_pylist() for c in b.columns)):
                both = [v.ravel() for t in (0, tolerance) for v in source_cells(system(crs), place, col, row, zoom, size, t)]
                y, x = (v.ravel() for v in np.mgrid[:size, :size])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(y), v), pa.int32()) for v in (col, row)), *(pa.array(v, pa.int32()) for v in (y, x)), *map(pa.array, both)], names)

    return codes.select(F.col("col").cast("int"), F.col("row").cast("int"), F.col("crs").cast("string")).mapInArrow(run, "col int, row int, y int, x int, exact_x double, exact_y double, near_x double, near_y double")
