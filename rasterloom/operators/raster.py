"""Rasters in pixel form: one row (band, y, x, v) for each cell, null for no data.

A neighbourhood is a window frame, so tile borders need no halo exchange. `dense` lays out all cells between the bounds,
which the separable windows need, `dense_tiles` those of the tiles present and around them. A layer's rows and columns are
spread over tasks by (band, y) and (band, x), and long ones, where a frame is bounded, by strips that overlap by the radius.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

KEYS = ["band", "y", "x"]


def dense(px: DataFrame, bounds: tuple[int, int, int, int] | None = None) -> DataFrame:
    """All cells of every band within bounds (x0, x1, y0, y1; found if not given), null where px has none.

    The bounds are one row for each band: the cells grow from it by two explodes, without a cross join.
    """
    own = px.groupBy("band").agg(*[f(c).cast("int").alias(n) for c in "xy" for f, n in ((F.min, c + "0"), (F.max, c + "1"))])
    if bounds:
        own = own.select("band", *[F.lit(v).alias(n) for n, v in zip(("x0", "x1", "y0", "y1"), bounds)])
    else:
        every = Window.partitionBy()
        own = own.select("band", *[f(n).over(every).alias(n) for n, f in (("x0", F.min), ("x1", F.max), ("y0", F.min), ("y1", F.max))])
    rows = own.select("band", F.explode(F.sequence("y0", "y1")).alias("y"), "x0", "x1")
    cells = rows.select("band", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return cells.join(px.select(*KEYS, "v"), KEYS, "left")


def tile_keys(px: DataFrame, tile: int) -> list[Column]:
    return [F.floor(F.col("x") / tile).cast("int").alias("col"), F.floor(F.col("y") / tile).cast("int").alias("row")]


def around(tiles: DataFrame, ring: int) -> DataFrame:
    """Tiles (col, row and other columns) and those up to `ring` tiles away."""
    rest = [c for c in tiles.columns if c not in ("col", "row")]
    near = lambda c: F.explode(F.sequence(F.col(c) - ring, F.col(c) + ring)).alias(c)
    return tiles.select(*rest, near("col"), "row").select(*rest, "col", near("row")).distinct()


def dense_tiles(px: DataFrame, tile: int, ring: int, only: DataFrame | None = None) -> DataFrame:
    """All cells of the tiles that a band has cells in and of `ring` tiles around them, null where px has none.

    The work follows the tiles there are, however far apart. only: of these tiles (col, row) and the ring around them.
    """
    tiles = around(px.select("band", *tile_keys(px, tile)).distinct(), ring)
    if only is not None:
        tiles = tiles.join(around(only.select("col", "row"), ring), ["col", "row"], "left_semi")
    span = lambda c: F.explode(F.sequence(F.col(c) * tile, F.col(c) * tile + tile - 1))
    cells = tiles.select("band", "col", span("row").alias("y")).select("band", "y", span("col").alias("x"))
    return cells.join(px.select(*KEYS, "v"), KEYS, "left")


#: Cells of a line that one task holds at least, where a frame is bounded.
STRIP = 4096


def along(axis: str, *more: str) -> Window:
    other = "y" if axis == "x" else "x"
    return Window.partitionBy("band", other, *more).orderBy(axis)


def in_strips(grid: DataFrame, axis: str, reach: int) -> DataFrame:
    """Each cell with its strip along an axis, and again with the strips it is within reach of."""
    at = [F.floor((F.col(axis) + d) / STRIP) for d in (-reach, reach)]
    return grid.withColumn("strip", F.explode(F.sequence(*at)))


def own_strip(axis: str) -> Column:
    return F.col("strip") == F.floor(F.col(axis) / STRIP)


def focal_sums(grid: DataFrame, radius: int) -> DataFrame:
    """Sum s and number c of the cells with data in the (2 r + 1) square around each cell, in two passes."""
    x, y = along("x", "strip").rangeBetween(-radius, radius), along("y", "strip").rangeBetween(-radius, radius)
    lines = in_strips(grid, "x", radius).select(*KEYS, "v", "strip", F.sum("v").over(x).alias("hs"), F.count("v").over(x).alias("hc")).where(own_strip("x")).drop("strip")
    out = in_strips(lines, "y", radius).select(*KEYS, "v", "strip", F.sum("hs").over(y).alias("s"), F.sum("hc").over(y).alias("c"))
    return out.where(own_strip("y")).drop("strip")


def focal_mean(px: DataFrame, radius: int = 1, bounds=None) -> DataFrame:
    """Truncated mean of the square around each cell, which shrinks at the edge; null where it has no data."""
    return mean_of(focal_sums(dense(px, bounds), radius))


def focal_mean_tiles(px: DataFrame, radius: int, tile: int, only: DataFrame) -> DataFrame:
    """`focal_mean` of the cells of some tiles (col, row), reading those and the tiles within the radius; any radius."""
    ring = -(-radius // tile)
    near = px.select("*", *tile_keys(px, tile)).join(around(only.select("col", "row"), ring), ["col", "row"], "left_semi").select(*KEYS, "v")
    mean = mean_of(focal_sums(dense_tiles(near, tile, ring, only), radius))
    return mean.select("*", *tile_keys(mean, tile)).join(only.select("col", "row"), ["col", "row"], "left_semi").select(*KEYS, "mean")


def focal(px: DataFrame, radius: int, kernel: Callable[[Column, Column, Column], Column], name: str = "v") -> DataFrame:
    """A neighbourhood aggregate by a kernel: an aggregate expression of the value and its offset (dx, dy) from the centre.

    Spark makes the buffer, its update, merge and result of it. Centres are the cells of px. For small radii: each cell
    is sent to its neighbours, with partial sums before the shuffle.
    """
    offsets = F.sequence(F.lit(-radius), F.lit(radius))
    sent = px.select(*KEYS, "v", F.explode(offsets).alias("dx")).select(*KEYS, "v", "dx", F.explode(offsets).alias("dy"))
    got = sent.groupBy("band", (F.col("y") - F.col("dy")).alias("y"), (F.col("x") - F.col("dx")).alias("x")).agg(kernel(F.col("v"), F.col("dx"), F.col("dy")).alias(name))
    return got.join(px.select(*KEYS), KEYS, "left_semi")


def in_key(layers: list[DataFrame], aggregate: Callable[[Column, Column], Column], name: str = "v") -> DataFrame:
    """An aggregate expression of the value and the layer's ordinal, over all layers' cells at each place."""
    return union(layers).groupBy(*KEYS).agg(aggregate(F.col("v"), F.col("layer")).alias(name))


def mean_of(out: DataFrame) -> DataFrame:
    return out.select(*KEYS, F.when(F.col("c") > 0, F.expr("s div c")).cast("long").alias("mean"))


def prefix_sums(px: DataFrame, bounds=None) -> DataFrame:
    """Summed-area table: sum and number of the cells up to and with each one, no data counting as 0."""
    first = (Window.unboundedPreceding, 0)
    lines = dense(px, bounds).select(*KEYS, F.sum(F.coalesce("v", F.lit(0))).over(along("x").rowsBetween(*first)).alias("s"), F.count("v").over(along("x").rowsBetween(*first)).alias("c"))
    over = along("y").rowsBetween(*first)
    return lines.select(*KEYS, F.sum("s").over(over).alias("total"), F.sum("c").over(over).alias("cells"))


def focal_mean_by_prefix(px: DataFrame, radius: int, bounds=None) -> DataFrame:
    """`focal_mean` from running sums: two lookups along each axis whatever the radius, without a join; for large ones."""

    def slide(grid: DataFrame, axis: str, pairs: dict[str, str]) -> DataFrame:
        lines = along(axis, "strip")
        running = [F.sum(c).over(lines.rowsBetween(Window.unboundedPreceding, 0)).alias(f"run_{n}") for n, c in pairs.items()]
        whole_ = [F.sum(c).over(Window.partitionBy(*KEYS[:1], "y" if axis == "x" else "x", "strip")).alias(f"all_{n}") for n, c in pairs.items()]
        runs = in_strips(grid, axis, radius + 1).select(*KEYS, "strip", *running, *whole_)
        # beyond the end all is summed, before the beginning nothing
        sums = [(F.coalesce(F.lead(f"run_{n}", radius).over(lines), F.col(f"all_{n}")) - F.coalesce(F.lag(f"run_{n}", radius + 1).over(lines), F.lit(0))).alias(n) for n in pairs]
        return runs.select(*KEYS, "strip", *sums).where(own_strip(axis)).drop("strip")

    grid = dense(px, bounds).select(*KEYS, F.coalesce("v", F.lit(0)).cast("long").alias("s"), F.col("v").isNotNull().cast("long").alias("c"))
    return mean_of(slide(slide(grid, "x", {"s": "s", "c": "c"}), "y", {"s": "s", "c": "c"}))


def window3(px: DataFrame, bounds=None) -> DataFrame:
    """e1..e8 around e0, laid out e5 e2 e6 / e1 e0 e3 / e8 e4 e7; null beyond the edge."""
    x, y = along("x"), along("y")
    g = dense(px, bounds).select(*KEYS, F.col("v").alias("e0"), F.lag("v").over(x).alias("e1"), F.lead("v").over(x).alias("e3"))
    up = [F.lag(c).over(y).alias(n) for c, n in (("e0", "e2"), ("e1", "e5"), ("e3", "e6"))]
    down = [F.lead(c).over(y).alias(n) for c, n in (("e0", "e4"), ("e1", "e8"), ("e3", "e7"))]
    return g.select(*KEYS, "e0", "e1", "e3", *up, *down)


def gradient(e: DataFrame, cell: float = 1.0, zero_edge: bool = False) -> DataFrame:
    """dx and dy of a 3x3 window; null if one of the eight is, or counted as 0 with zero_edge."""
    v = {i: F.coalesce(f"e{i}", F.lit(0)) if zero_edge else F.col(f"e{i}") for i in range(1, 9)}
    dx = (v[6] + 2 * v[3] + v[7]) - (v[5] + 2 * v[1] + v[8])
    dy = (v[8] + 2 * v[4] + v[7]) - (v[5] + 2 * v[2] + v[6])
    return e.select(*KEYS, "e0", (dx / F.lit(cell)).alias("dx"), (dy / F.lit(cell)).alias("dy"))


BIG = 2147483647


def whole(v: Column) -> Column:
    """Truncated to a 32-bit integer that saturates."""
    t = F.when(v >= BIG, BIG).when(v <= -BIG - 1, -BIG - 1)
    return t.otherwise(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))).cast("int")


def slope_of(dx: Column, dy: Column, safe: bool = False) -> Column:
    """(dx / dy) * 100, truncated; with dy = 0: 0, the largest integer or null by the sign of dx (safe: null)."""
    flat = F.when(dx == 0, 0).when(dx > 0, BIG) if not safe else F.lit(None).cast("int")
    return F.when(dx.isNull() | dy.isNull(), None).when(dy == 0, flat).otherwise(whole(F.try_divide(dx, dy) * 100))


def aspect_of(dx: Column, dy: Column, safe: bool = False) -> Column:
    """1 / tan(dy / dx), truncated; dx = 0 gives 0, dy = 0 the largest integer or null (safe: null for both)."""
    null = F.lit(None).cast("int")
    value = whole(F.try_divide(F.lit(1.0), F.tan(F.try_divide(dy, dx))))
    return F.when(dx.isNull() | dy.isNull(), null).when(dx == 0, null if safe else F.lit(0)).when(dy == 0, null if safe else F.when(dx > 0, BIG)).otherwise(value)


def horn_slope(dx: Column, dy: Column) -> Column:
    """Slope in degrees from the gradient of a 3x3 window."""
    return F.degrees(F.atan(F.sqrt(dx * dx + dy * dy) / 8))


def horn_aspect(dx: Column, dy: Column) -> Column:
    """Direction of descent in degrees clockwise from north; null where flat."""
    return F.when((dx == 0) & (dy == 0), None).otherwise(F.pmod(F.degrees(F.atan2(-dx, dy)) + F.lit(360.0), F.lit(360.0)))


TERRAIN: dict[str, Callable] = {"slope": slope_of, "aspect": aspect_of, "horn_slope": horn_slope, "horn_aspect": horn_aspect}


def terrain(px: DataFrame, name: str, cell: float = 1.0, centre: bool = False, zero_edge: bool = False, bounds=None) -> DataFrame:
    """A terrain function by name. centre: cells without data of their own have none (the compact form)."""
    if name not in TERRAIN:
        raise ValueError(f"no terrain function {name!r}; there are {', '.join(TERRAIN)}")
    g = gradient(window3(px, bounds), cell, zero_edge)
    out = TERRAIN[name](F.col("dx"), F.col("dy"))
    return g.select(*KEYS, (F.when(F.col("e0").isNotNull(), out) if centre else out).alias(name))


def halo(px: DataFrame, tile: int, radius: int) -> DataFrame:
    """Cells of each tile and of all tiles around it within radius, which may be larger than a tile: (tile_col, tile_row) asks, (y, x) is the cell.

    The map-side form of the neighbour join, for operators that need whole tiles; tiles without own cells get none.
    """
    near = lambda c: F.sequence(*(F.floor((F.col(c) + d) / tile).cast("int") for d in (-radius, radius)))
    spread = px.select(*KEYS, "v", F.explode(near("x")).alias("tile_col"), near("y").alias("_r"))
    spread = spread.select(*KEYS, "v", "tile_col", F.explode("_r").alias("tile_row"))
    own = px.select("band", F.floor(F.col("x") / tile).cast("int").alias("tile_col"), F.floor(F.col("y") / tile).cast("int").alias("tile_row")).distinct()
    return spread.join(own, ["band", "tile_col", "tile_row"], "left_semi")


def apply_tiles(px: DataFrame, tile: int, radius: int, kernel: Callable, schema: str) -> DataFrame:
    """The escape hatch: a pandas function of a tile with its halo, for kernels that no expression states."""
    return halo(px, tile, radius).groupBy("band", "tile_col", "tile_row").applyInPandas(kernel, schema)


def normalized_difference(px: DataFrame, first: int, second: int, whole_numbers: bool = False) -> DataFrame:
    """(b0 - b1) / (b0 + b1) of two bands; null on a zero denominator."""
    two = px.where(F.col("band").isin(first, second)).groupBy("y", "x").agg(F.max(F.when(F.col("band") == first, F.col("v"))).alias("a"), F.max(F.when(F.col("band") == second, F.col("v"))).alias("b"))
    value = F.expr("CASE WHEN a + b <> 0 THEN (a - b) div (a + b) END") if whole_numbers else F.try_divide((F.col("a") - F.col("b")).cast("double"), (F.col("a") + F.col("b")).cast("double"))
    return two.where("a IS NOT NULL AND b IS NOT NULL").select("y", "x", value.alias("nd"))


def local(a: DataFrame, b: DataFrame, op: Callable[[Column, Column], Column], name: str = "v") -> DataFrame:
    """A cellwise function of two layers on their common cells; null where one has no data."""
    return a.select(*KEYS, F.col("v").alias("_a")).join(b.select(*KEYS, F.col("v").alias("_b")), KEYS).select(*KEYS, op(F.col("_a"), F.col("_b")).alias(name))


def in_order(tiles: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """Rows with their place (from 0) in the order of keys, column, row and band being the usual ones; ties take any order.

    Rows are dealt by ranges and numbered within them; of each range only its number of rows meets the others' in one task.
    The ranges are found by a sample, which another evaluation could take otherwise, so the dealt rows are kept (persist):
    both uses, and tasks that are run again, read one dealing.
    """
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tiles.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()).withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*keys))).persist()
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(before, "_part").withColumn(name, F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def union(layers: list[DataFrame]) -> DataFrame:
    """Layers one after the other, with their ordinal in `layer`."""
    out = None
    for i, px in enumerate(layers):
        part = px.select(*KEYS, "v", F.lit(i).alias("layer"))
        out = part if out is None else out.unionByName(part)
    return out


def keep_first(px: DataFrame) -> DataFrame:
    """The first layer's cell at each place, with or without data."""
    return px.groupBy(*KEYS).agg(F.min_by("v", "layer").alias("v"))


def merge(px: DataFrame) -> DataFrame:
    """The first layer's data at each place: no data is filled from later layers. One partial aggregate, no sort."""
    return px.groupBy(*KEYS).agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("layer"))).alias("v"))


def add(px: DataFrame) -> DataFrame:
    """Sum of all layers at each place; null if one has no data there."""
    return px.groupBy(*KEYS).agg(F.when(F.count("v") == F.count("*"), F.sum("v")).alias("v"))


def pyramid(px: DataFrame, levels: int) -> DataFrame:
    """Means of 2^k x 2^k cells with data, for k from 0 to levels. Each level is summed from the one below: a quarter of it."""
    sums = [F.sum("s").alias("s"), F.sum("c").alias("c")]
    level = px.groupBy(*KEYS).agg(F.sum("v").alias("s"), F.count("v").alias("c"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, levels + 1):
        level = level.groupBy("band", F.shiftright("y", 1).alias("y"), F.shiftright("x", 1).alias("x")).agg(*sums)
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out.select("level", *KEYS, F.try_divide(F.col("s").cast("double"), F.col("c")).alias("v"))


def to_tiles(px: DataFrame, size: int) -> DataFrame:
    """Tile form: cells (row-major, null for none) of each band and tile. An Arrow function puts a tile's cells in place, in linear time."""
    tile = lambda c: F.floor(F.col(c) / size).cast("int")
    place = (F.pmod("y", F.lit(size)) * size + F.pmod("x", F.lit(size))).cast("int")
    cells = px.select("band", tile("x").alias("col"), tile("y").alias("row"), place.alias("i"), "v")

    def fill(table: pa.Table) -> pa.Table:
        at = np.full(size * size, -1, np.int64)
        at[table["i"].to_numpy()] = np.arange(table.num_rows)
        values = table["v"].combine_chunks().take(pa.array(at, mask=at < 0))
        made = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), values)
        return pa.table([*(table[c].slice(0, 1) for c in ("band", "col", "row")), made], ["band", "col", "row", "cells"])

    band, v = (px.schema[c].dataType.simpleString() for c in ("band", "v"))
    return cells.groupBy("band", "col", "row").applyInArrow(fill, f"band {band}, col int, row int, cells array<{v}>")


def from_tiles(tiles: DataFrame, size: int) -> DataFrame:
    """Pixel form of tiles, without cells that have no data."""
    cell = tiles.select("band", "col", "row", F.posexplode("cells").alias("i", "v")).where("v IS NOT NULL")
    return cell.select("band", (F.col("row") * size + F.floor(F.col("i") / size)).cast("int").alias("y"), (F.col("col") * size + F.col("i") % size).cast("int").alias("x"), "v")


def band_stack(tiles: DataFrame) -> DataFrame:
    """Bands of each tile in the order of their rank: arrays of the ranks and of their cells."""
    ranked = F.array_sort(F.collect_list(F.struct("band", "cells")))
    return tiles.groupBy("col", "row").agg(ranked.alias("s")).select("col", "row", F.col("s.band").alias("bands"), F.col("s.cells").alias("stack"))


def reproject(px: DataFrame, cells: DataFrame, lon: Column, lat: Column, origin: tuple[float, float], step: tuple[float, float]) -> DataFrame:
    """Nearest neighbour: cells (keyed as they like) whose centre is at lon, lat get the source cell it falls in.

    origin: west and north edge of the source; step: its cell size. Each target cell is mapped back, then joined by cell.
    """
    place = cells.withColumn("_x", F.floor((lon - origin[0]) / step[0]).cast("int")).withColumn("_y", F.floor((origin[1] - lat) / step[1]).cast("int"))
    source = px.select("band", F.col("y").alias("_y"), F.col("x").alias("_x"), "v")
    return place.join(source, ["_y", "_x"]).drop("_x", "_y")


def mosaic(sources: list[tuple[DataFrame, tuple[float, float], tuple[float, float]]], cells: DataFrame, lon: Column, lat: Column, keys: list[str]) -> DataFrame:
    """Target cells (keys, band, v) from several sources (px, origin, step) by nearest neighbour: at each place the first
    source that has data. One partial aggregate over all sources; cells that no source covers have no row.
    """
    out = None
    for i, (px, origin, step) in enumerate(sources):
        part = reproject(px, cells, lon, lat, origin, step).select(*keys, "band", "v", F.lit(i).alias("layer"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "band").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("layer"))).alias("v"))
