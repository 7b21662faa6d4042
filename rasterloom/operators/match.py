"""Matching requested map tiles with file tiles: overview levels, tile windows, extent joins, what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BOX = ["xmin", "ymin", "xmax", "ymax"]


def overview_level(wanted: Column, own: Column, levels: Column) -> Column:
    """Overview for a wanted resolution (null: the file's own): floor(log2(wanted / own)) + 1 within the levels."""
    level = F.floor(F.log2(wanted / own)) + 1
    return F.when(wanted.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(levels - 1, level))).cast("int")


def tile_size(cell: Column, level: Column, tile: int | Column = 256) -> Column:
    return tile * cell * F.pow(F.lit(2.0), level)


def tile_window(lo: Column, hi: Column, origin: Column, size: Column, count: Column) -> tuple[Column, Column]:
    """First and last tile index along one axis for a range, cut towards 0 and kept within the grid.

    For rows, which grow southwards, give the negated ordinates.
    """
    index = lambda v: F.when((v - origin) / size < 0, F.ceil((v - origin) / size)).otherwise(F.floor((v - origin) / size))
    return F.greatest(F.lit(0), index(lo)).cast("int"), F.least(count - 1, index(hi)).cast("int")


def cog_tile_extent(row: Column, col: Column, level: Column, x_min: Column, y_max: Column, cell_w: Column, cell_h: Column, tile: int | Column = 256) -> list[Column]:
    w, h = tile_size(cell_w, level, tile), tile_size(cell_h, level, tile)
    return [(col * w + x_min).alias("xmin"), (y_max - (row + 1) * h).alias("ymin"), ((col + 1) * w + x_min).alias("xmax"), (y_max - row * h).alias("ymax")]


def meets(a: str, b: str) -> Column:
    """Closed extents with these column prefixes touch or overlap."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


#: Buckets that one extent may touch.
MOST_BUCKETS = 1 << 20


def extent_join(a: DataFrame, b: DataFrame, bucket: float) -> DataFrame:
    """Pairs of rows whose extents (BOX columns) meet; the columns of both come prefixed a_ and b_.

    An inequality join would compare all pairs. Here each row goes to the buckets of a square grid that its extent
    touches, rows of one bucket are joined by it, and a pair counts in one bucket only: that of the greater of their
    lower corners. bucket should be near the usual extent; a hot bucket is split by the skew join. An extent that touches more
    than MOST_BUCKETS buckets, whatever its rows would be, is an error that says so.
    """
    sides = []
    for df, p in ((a, "a_"), (b, "b_")):
        df = df.toDF(*[p + c for c in df.columns])
        count = (F.floor(F.col(f"{p}xmax") / bucket) - F.floor(F.col(f"{p}xmin") / bucket) + 1) * (F.floor(F.col(f"{p}ymax") / bucket) - F.floor(F.col(f"{p}ymin") / bucket) + 1)
        fine = F.when(count > MOST_BUCKETS, F.raise_error(F.lit(f"an extent touches more than {MOST_BUCKETS} buckets of {bucket}: choose larger ones"))).otherwise(F.lit(0)).cast("int")
        # the check is part of the bucket's number, so that no row is made before it
        span = lambda lo, hi, fine=fine: F.sequence(F.floor(F.col(lo) / bucket) + fine, F.floor(F.col(hi) / bucket))
        df = df.withColumn("gx", F.explode(span(f"{p}xmin", f"{p}xmax"))).withColumn("gy", F.explode(span(f"{p}ymin", f"{p}ymax")))
        sides.append(df)
    low = lambda v: F.floor(F.greatest(f"a_{v}", f"b_{v}") / bucket)
    joined = sides[0].join(sides[1], ["gx", "gy"])
    return joined.where(meets("a_", "b_") & (F.col("gx") == low("xmin")) & (F.col("gy") == low("ymin"))).drop("gx", "gy")


#: About as many items of lists one task returns, unless the keys of one copy of a list have more. A list of more than LONG_LIST items is dealt to
#: so few keys at a time that they have twice as many together.
TASK_ITEMS, LONG_LIST = 1 << 22, 1 << 17


def met_lists(a: DataFrame, keys: list[str], b: DataFrame, item: Column, name: str, bucket: float, form: Callable[[Column], Column] | None, most: int = 1000) -> DataFrame:
    """Each key of a whose extents meet one of b, with what form makes of the sorted items of the rows of b that they meet.

    Rows of equal extents meet the same ones, so extents are joined once however many rows have them: b's by lists of items,
    a's by classes of keys with the same extents. A class's list is made once and dealt to its keys, `most` to a copy of it.

    Copies go to numbered tasks, so that a task returns either few items or rows of one list only. Where a task began with
    many rows of one large list and went on with another, a Parquet writer, which keeps repeated values once as long as they are
    few, would see almost nothing in its first 100 rows, not look again for up to 10,000 and by then hold gigabytes. The items
    are counted beforehand by a join without lists, which is run at once.
    """
    own, kind, k, m, n, part, share, start, first, deal, task, held, items = (f"_{x}" for x in ("extents", "kind", "k", "m", "n", "part", "share", "start", "first", "deal", "task", "held", "items"))
    there = [F.col(c).isNotNull() for c in BOX]
    owned = a.where(there[0] & there[1] & there[2] & there[3]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*BOX))).alias(own))
    classes = owned.groupBy(own).agg(F.count("*").alias(k))
    counts = extent_join(classes.select(own, k, F.inline(own)), b.groupBy(*BOX).agg(F.count("*").alias(m)), bucket)
    sizes = counts.groupBy(F.col(f"a_{own}").alias(kind), F.col(f"a_{k}").alias(k)).agg(F.sum(f"b_{m}").alias(m))
    # copies of each list, and what one of them takes of a task; those that take a whole one come first, so that they begin with it
    rows = F.when(F.col(m) > LONG_LIST, F.greatest(F.lit(1), F.least(F.lit(most), F.floor(2 * TASK_ITEMS / F.col(m))))).otherwise(most)
    sizes = sizes.withColumn(n, F.ceil(F.col(k) / rows)).withColumn(share, F.least(F.lit(TASK_ITEMS), F.ceil((F.col(m) + 8) * F.col(k) / F.col(n))))
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.partitionBy(part).orderBy(F.desc(share), kind).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(part, F.pmod(F.xxhash64(kind), F.lit(parts))).withColumn(start, F.coalesce(F.sum(F.col(n) * F.col(share)).over(before), F.lit(0))).persist()
    # of each part only its number of tasks meets the others' in one task
    ends = sizes.groupBy(part).agg(F.ceil(F.max(F.col(start) + F.col(n) * F.col(share)) / TASK_ITEMS).alias(task))
    firsts = ends.select(part, (F.sum(task).over(Window.orderBy(part)) - F.col(task)).alias(first))
    place = F.col(first) + F.floor((F.col(start) + F.col(deal) * F.col(share)) / TASK_ITEMS)
    lists = b.groupBy(*BOX).agg(F.collect_list(item).alias(items))
    made = extent_join(sizes.select(kind, F.inline(kind)), lists, bucket).groupBy(F.col(f"a_{kind}").alias(kind)).agg(F.sort_array(F.flatten(F.collect_list(f"b_{items}"))).alias(name))
    if form:
        made = made.withColumn(name, form(F.col(name)))
    dealt = owned.withColumnRenamed(own, kind).join(sizes.join(F.broadcast(firsts), part), kind).withColumn(deal, F.pmod(F.xxhash64(*keys), F.col(n)))
    copies = dealt.withColumn(task, place.cast("int")).groupBy(kind, deal, task).agg(F.collect_list(F.struct(*keys)).alias(held))
    return copies.join(made, kind).select(task, held, name).repartitionById(ends.agg(F.sum(task)).first()[0] or 1, task).select(F.inline(held), name)


def match_inverted(tiles: DataFrame, codes: DataFrame, bucket: float, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each file tile (id, BOX) that meets a requested one (col, row, BOX), once, with those it meets (codes, or form of it)."""
    return met_lists(tiles, ["id"], codes, F.struct("col", "row"), "codes", bucket, form)


def match_forward(tiles: DataFrame, codes: DataFrame, bucket: float, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each requested tile that meets a file tile, with those it meets (tiles, or form of it). The same join, grouped the other way."""
    return met_lists(codes, ["col", "row"], tiles, F.col("id"), "tiles", bucket, form)


def visible_tiles(tiles: DataFrame, codes: DataFrame, bucket: float, strategy: str = "inverted") -> DataFrame:
    """Pairs (id, col, row) by either strategy; both give the same rows.

    Different extents are joined once, and their pairs brought back to the rows by equal extents, those of the file tiles first
    (inverted) or those of the requested ones (forward). No row holds a list.
    """
    if strategy not in ("inverted", "forward"):
        raise ValueError(f"no strategy {strategy!r}")
    sides = {"a": tiles.select("id", *BOX), "b": codes.select("col", "row", *BOX)}
    met = extent_join(*(df.select(*BOX).dropna().distinct() for df in sides.values()), bucket)
    for p in "ab" if strategy == "inverted" else "ba":
        own = sides[p].toDF(*(f"{p}_{c}" if c in BOX else c for c in sides[p].columns))
        met = own.join(met, [f"{p}_{c}" for c in BOX])
    return met.select("id", "col", "row")


def codes_by_bands(codes: DataFrame, bands: list[str]) -> DataFrame:
    """Every requested tile with every band (a short list): an explode, where a cross join would do the same."""
    return codes.withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))


def missing(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows whose key is not stored: the incremental difference, also for the header cache."""
    return wanted.join(stored.select(*keys).distinct(), keys, "left_anti")


def coalesce_ranges(reads: DataFrame, gap: int) -> DataFrame:
    """Byte ranges (path, offset, byte_count) of a file joined into islands with gaps of at most `gap` bytes.

    A read starts an island if it begins more than gap bytes after all earlier reads of its file end.
    """
    w = Window.partitionBy("path").orderBy("offset", "byte_count")
    before = F.max(F.col("offset") + F.col("byte_count")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("offset") > before + gap), 1).otherwise(0)
    numbered = reads.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("path", "island").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("byte_count")).alias("end"), F.count("*").alias("tiles"))
