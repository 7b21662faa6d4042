"""The engine's queries over the test tables, each beside SQL that states its result another way."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.functions import grid, projection, scalar, tables
from rasterloom.operators import halo, levels, match, raster, warp
from rasterloom.plans import jobs
from rasterloom.sources import catalog as cat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIDE, ZOOM, CELL = 64, 11, 76.437028
BOUNDS = (0, SIDE - 1, 0, SIDE - 1)


def query(sql: str | None = None):
    """Registers a query by its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Test rasters, boxes and points, derived from the tables by the same rules in both languages.


def px(spark, d) -> DataFrame:
    """Line items as a raster with gaps: 64 x 64 cells in seven bands."""
    c = F.col
    key = [c("l_linenumber").cast("int").alias("band"), (c("l_suppkey") % SIDE).cast("int").alias("y"), (c("l_partkey") % SIDE).cast("int").alias("x")]
    return table(spark, d, "lineitem").groupBy(*key).agg(F.min(c("l_quantity").cast("int")).alias("v"))


def points(spark, d) -> DataFrame:
    lon = (F.col("event_id") * 7919 % 100003) / 100003 * 360 - 180
    lat = ((F.col("user_id") * 104729 + F.col("event_id") * 31) % 100019) / 100019 * 160 - 80
    return table(spark, d, "events").select("event_id", lon.alias("lon"), lat.alias("lat"))


def file_tiles(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    box = [s.cast("double").alias("xmin"), (k % 50).cast("double").alias("ymin"), (s + k % 5).cast("double").alias("xmax"), (k % 50 + 3).cast("double").alias("ymax")]
    return table(spark, d, "part").select(k.alias("id"), *box)


def code_boxes(spark, d) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    box = [(k % 53).cast("double").alias("xmin"), (n * 2).cast("double").alias("ymin"), (k % 53 + 2).cast("double").alias("xmax"), (n * 2 + 4).cast("double").alias("ymax")]
    return table(spark, d, "supplier").select(k.alias("col"), n.alias("row"), *box)


PX = f"""px AS (
  SELECT CAST(l_linenumber AS INT) AS band, CAST(l_suppkey % {SIDE} AS INT) AS y, CAST(l_partkey % {SIDE} AS INT) AS x, min(CAST(l_quantity AS INT)) AS v
  FROM lineitem GROUP BY 1, 2, 3)"""
GRID = f"""{PX}, grid AS MATERIALIZED (
  SELECT b.band, CAST(r.y AS INT) AS y, CAST(c.x AS INT) AS x, px.v FROM (SELECT DISTINCT band FROM px) b CROSS JOIN range({SIDE}) r(y) CROSS JOIN range({SIDE}) c(x)
  LEFT JOIN px ON px.band = b.band AND px.y = r.y AND px.x = c.x)"""
PTS = """pts AS (SELECT event_id, (event_id * 7919 % 100003) / 100003 * 360 - 180 AS lon, ((user_id * 104729 + event_id * 31) % 100019) / 100019 * 160 - 80 AS lat FROM events)"""
TILES = """t AS (SELECT p_partkey AS id, p_size::DOUBLE AS xmin, (p_partkey % 50)::DOUBLE AS ymin, (p_size + p_partkey % 5)::DOUBLE AS xmax, (p_partkey % 50 + 3)::DOUBLE AS ymax FROM part)"""
CODES = """c AS (SELECT s_suppkey AS col, s_nationkey AS row, (s_suppkey % 53)::DOUBLE AS xmin, (s_nationkey * 2)::DOUBLE AS ymin, (s_suppkey % 53 + 2)::DOUBLE AS xmax, (s_nationkey * 2 + 4)::DOUBLE AS ymax FROM supplier)"""
MEET = "t.xmin <= c.xmax AND c.xmin <= t.xmax AND t.ymin <= c.ymax AND c.ymin <= t.ymax"
AROUND = {"e1": (-1, 0), "e2": (0, -1), "e3": (1, 0), "e4": (0, 1), "e5": (-1, -1), "e6": (1, -1), "e7": (1, 1), "e8": (-1, 1)}
# the neighbours by one self-join, for all nine offsets
E = f"""{GRID}, o(k, dx, dy) AS (VALUES (0, 0, 0), {", ".join(f"({e[1]}, {dx}, {dy})" for e, (dx, dy) in AROUND.items())}),
  asked AS MATERIALIZED (SELECT g.band, g.y, g.x, o.k, g.y + o.dy AS ny, g.x + o.dx AS nx FROM grid g CROSS JOIN o),
  e AS MATERIALIZED (SELECT a.band, a.y, a.x, {", ".join(f"max(n.v) FILTER (a.k = {k}) AS e{k}" for k in range(9))}
  FROM asked a LEFT JOIN grid n ON n.band = a.band AND n.y = a.ny AND n.x = a.nx GROUP BY a.band, a.y, a.x)"""
D = f"""{E}, d AS (SELECT band, y, x, e0, ((e6 + 2 * e3 + e7) - (e5 + 2 * e1 + e8)) / {CELL}::DOUBLE AS dx, ((e8 + 2 * e4 + e7) - (e5 + 2 * e2 + e6)) / {CELL}::DOUBLE AS dy FROM e)"""
WHOLE = "CASE WHEN {0} >= 2147483647 THEN 2147483647 WHEN {0} <= -2147483648 THEN -2147483648 ELSE CAST(trunc({0}) AS INT) END"
SLOPE = "CASE WHEN dx IS NULL OR dy IS NULL THEN NULL WHEN dy = 0 THEN CASE WHEN dx = 0 THEN 0 WHEN dx > 0 THEN 2147483647 END ELSE " + WHOLE.format("dx / dy * 100") + " END"
ASPECT = "CASE WHEN dx IS NULL OR dy IS NULL THEN NULL WHEN dx = 0 THEN 0 WHEN dy = 0 THEN CASE WHEN dx > 0 THEN 2147483647 END ELSE " + WHOLE.format("1 / tan(dy / dx)") + " END"


# transverse Mercator by Krueger's series with the literature's numbers for WGS 84
TM = """t AS (SELECT *, sinh(atanh(sin(radians(lat))) - 0.0818191908426215 * atanh(0.0818191908426215 * sin(radians(lat)))) AS tau, radians(lon - lon0) AS lam FROM {0}),
  u AS (SELECT *, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta FROM t),
  tm AS (SELECT *, 500000 + 6364902.166165091::DOUBLE * (eta + {1}) AS e, 6364902.166165091::DOUBLE * (xi + {2}) AS n FROM u)"""
ALPHA = [8.377318206244698e-4, 7.608527773572307e-7, 1.197645503329453e-9, 2.429170607201358e-12, 5.711757677865804e-15, 1.4911177312583895e-17]
TM = TM.format("{0}", " + ".join(f"{c!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(ALPHA, 1)), " + ".join(f"{c!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(ALPHA, 1)))


# Neighbourhoods


def _focal_sql(r: int) -> str:
    return f"""WITH {GRID} SELECT a.band, a.y, a.x, CAST(sum(b.v) // count(b.v) AS BIGINT) AS mean FROM grid a
      JOIN grid b ON a.band = b.band AND b.y BETWEEN a.y - {r} AND a.y + {r} AND b.x BETWEEN a.x - {r} AND a.x + {r} GROUP BY ALL"""


@query(_focal_sql(1))
def focal_mean(spark, d):
    return raster.focal_mean(px(spark, d), 1, BOUNDS)


@query(_focal_sql(3))
def focal_mean_wide(spark, d):
    return raster.focal_mean_by_prefix(px(spark, d), 3, BOUNDS)


@query(f"""WITH {GRID} SELECT band, y, x, CAST(sum(s) OVER (PARTITION BY band, x ORDER BY y) AS BIGINT) AS total, CAST(sum(c) OVER (PARTITION BY band, x ORDER BY y) AS BIGINT) AS cells
  FROM (SELECT band, y, x, sum(coalesce(v, 0)) OVER w AS s, count(v) OVER w AS c FROM grid WINDOW w AS (PARTITION BY band, y ORDER BY x))""")
def prefix_sum_2d(spark, d):
    return raster.prefix_sums(px(spark, d), BOUNDS)


@query(f"WITH {E} SELECT band, y, x, e0, e1, e2, e3, e4, e5, e6, e7, e8 FROM e")
def dem_window(spark, d):
    return raster.window3(px(spark, d), BOUNDS).select("band", "y", "x", *[f"e{i}" for i in range(9)])


@query(f"WITH {D} SELECT band, y, x, e0, round(dx, 9) AS dx, round(dy, 9) AS dy FROM d")
def gradient(spark, d):
    g = raster.gradient(raster.window3(px(spark, d), BOUNDS), CELL)
    return g.select("band", "y", "x", "e0", F.round("dx", 9).alias("dx"), F.round("dy", 9).alias("dy"))


@query(f"WITH {D} SELECT band, y, x, {SLOPE} AS slope FROM d")
def dem_slope(spark, d):
    return raster.terrain(px(spark, d), "slope", CELL, bounds=BOUNDS)


@query(f"WITH {D} SELECT band, y, x, {ASPECT} AS aspect FROM d")
def dem_aspect(spark, d):
    return raster.terrain(px(spark, d), "aspect", CELL, bounds=BOUNDS)


@query(f"WITH {D} SELECT band, y, x, CASE WHEN e0 IS NOT NULL THEN {SLOPE} END AS slope FROM d")
def slope(spark, d):
    return raster.terrain(px(spark, d), "slope", CELL, centre=True, bounds=BOUNDS)


@query(f"WITH {D} SELECT band, y, x, CASE WHEN e0 IS NOT NULL THEN {ASPECT} END AS aspect FROM d")
def aspect(spark, d):
    return raster.terrain(px(spark, d), "aspect", CELL, centre=True, bounds=BOUNDS)


@query(f"WITH {D} SELECT band, y, x, round(degrees(atan(sqrt(dx * dx + dy * dy) / 8)), 6) AS horn_slope FROM d")
def horn_slope(spark, d):
    return raster.terrain(px(spark, d), "horn_slope", CELL, bounds=BOUNDS).withColumn("horn_slope", F.round("horn_slope", 6))


@query(f"""WITH {PX}, own AS (SELECT DISTINCT band, x // 16 AS tile_col, y // 16 AS tile_row FROM px)
  SELECT p.band, CAST(p.y AS INT) AS y, CAST(p.x AS INT) AS x, p.v, CAST(o.tile_col AS INT) AS tile_col, CAST(o.tile_row AS INT) AS tile_row FROM px p JOIN own o ON p.band = o.band
  AND p.x BETWEEN o.tile_col * 16 - 2 AND o.tile_col * 16 + 17 AND p.y BETWEEN o.tile_row * 16 - 2 AND o.tile_row * 16 + 17""")
def halo_neighbors(spark, d):
    return raster.halo(px(spark, d), 16, 2)


# Whole tiles


@query(f"""WITH {PX}, far AS (SELECT 1 AS band, y, x + 100000 * band AS x, v FROM px), t AS (SELECT DISTINCT x // 16 AS c, y // 16 AS r FROM far),
  g AS (SELECT c * 16 + i AS x, r * 16 + j AS y, c // 100 AS part FROM t CROSS JOIN range(16) a(i) CROSS JOIN range(16) b(j)),
  f AS (SELECT g.x, g.y, g.part, far.v FROM g LEFT JOIN far ON far.x = g.x AND far.y = g.y),
  h AS (SELECT x, y, part, sum(v) OVER w AS s, count(v) OVER w AS n FROM f WINDOW w AS (PARTITION BY part, y ORDER BY x RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING)),
  q AS (SELECT x, y, sum(s) OVER w AS s, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY part, x ORDER BY y RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING))
  SELECT 1 AS band, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(s // n AS BIGINT) AS mean FROM q WHERE n > 0""")
def focal_mean_strips(spark, d):
    far = px(spark, d).select(F.lit(1).alias("band"), "y", (F.col("x") + 100000 * F.col("band")).alias("x"), "v")
    return raster.from_tiles(halo.focal_mean(raster.to_tiles(far, 16), 16, 50), 16).withColumnRenamed("v", "mean")


@query(f"WITH {D}, s AS (SELECT band, y, x, {SLOPE} AS slope FROM d) SELECT band, y, x, CAST(slope AS BIGINT) AS slope FROM s WHERE slope IS NOT NULL AND (band, x // 16, y // 16) IN (SELECT (band, x // 16, y // 16) FROM px)")
def slope_tiles(spark, d):
    return raster.from_tiles(halo.terrain(raster.to_tiles(px(spark, d), 16), 16, "slope", CELL), 16).withColumnRenamed("v", "slope")


@query(f"WITH {PX} SELECT CAST(k AS INT) AS level, CAST(band AS INT) AS band, CAST(y // (1 << k) AS INT) AS y, CAST(x // (1 << k) AS INT) AS x, round(avg(v), 6) AS v FROM px CROSS JOIN range(4) r(k) GROUP BY ALL")
def pyramid_of_tiles(spark, d):
    tiles = levels.pyramid_tiles(raster.to_tiles(px(spark, d), 16), 3, 16)
    # the level goes along in the band's number
    flat = raster.from_tiles(tiles.withColumn("band", F.col("band") * 10 + F.col("level")), 16)
    return flat.select((F.col("band") % 10).alias("level"), F.floor(F.col("band") / 10).cast("int").alias("band"), "y", "x", F.round("v", 6).alias("v"))


#: Three files of 64 x 64 cells: system, west and north edge, cell.
FILES = [("EPSG:4326", 110.0, 32.0, 0.02), ("EPSG:3857", 12278539.8, 3670000.0, 2000.0), ("EPSG:32649", 404000.0, 3540000.0, 2000.0)]


def requested(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select((206 + F.col("s_suppkey") % 2).cast("int").alias("col"), (103 + F.col("s_nationkey") % 3).cast("int").alias("row")).distinct()


def file_rows(spark, d, tiles: DataFrame) -> DataFrame:
    """Tiles of the test raster as those of three files, of which the later ones have fewer bands, with the requested tiles each one meets."""
    out = None
    for i, (crs, west, north, cell) in enumerate(FILES):
        box = match.cog_tile_extent(F.col("row"), F.col("col"), F.lit(0), F.lit(west), F.lit(north), F.lit(cell), F.lit(cell), 16)
        own = tiles.where(F.col("band") % 3 >= i).select("band", "col", "row", *box)
        met = match.extent_join(own, jobs.code_extents(requested(spark, d), 8, crs), 64 * cell)
        codes = met.groupBy(F.col("a_band").alias("band"), F.col("a_col").alias("col"), F.col("a_row").alias("row")).agg(F.collect_list(F.struct(F.col("b_col").alias("col"), F.col("b_row").alias("row"))).alias("codes"))
        place = {"source": i, "tile": 16, "width": 64, "height": 64, "x_min": west, "y_max": north, "cell_w": cell, "cell_h": cell, "crs": crs}
        part = tiles.join(codes, ["band", "col", "row"]).select("*", *(F.lit(v).alias(k) for k, v in place.items()))
        out = part if out is None else out.unionByName(part)
    return out


#: The nearest cells of the first file that has data, of a raster r, in the requested tiles.
WARPED = f"""c AS (SELECT DISTINCT 206 + s_suppkey % 2 AS c, 103 + s_nationkey % 3 AS r FROM supplier),
  g AS (SELECT c * 32 + i AS x, r * 32 + j AS y, (c * 32 + i + 0.5) / 8192 * 360 - 180 AS lon, degrees(2 * atan(exp(pi() * (1 - 2 * (r * 32 + j + 0.5) / 8192))) - pi() / 2) AS lat, 111 AS lon0
    FROM c CROSS JOIN range(32) a(i) CROSS JOIN range(32) b(j)), {TM.format("g")},
  m AS (SELECT x, y, 0 AS source, lon AS e, lat AS n FROM g UNION ALL SELECT x, y, 1, 6378137.0 * radians(lon), 6378137.0 * atanh(sin(radians(lat))) FROM g UNION ALL SELECT x, y, 2, e, n FROM tm),
  files(source, west, north, cell) AS (VALUES {", ".join(f"({i}, {w}::DOUBLE, {n}::DOUBLE, {c}::DOUBLE)" for i, (_, w, n, c) in enumerate(FILES))}),
  k AS (SELECT m.x, m.y, r.band, r.v, row_number() OVER (PARTITION BY m.x, m.y, r.band ORDER BY source) AS rank FROM m JOIN files f USING (source)
    JOIN r ON r.x = floor((e - west) / cell) AND r.y = floor((north - n) / cell) AND r.band % 3 >= source WHERE r.v IS NOT NULL)
  SELECT band, CAST(y AS INT) AS y, CAST(x AS INT) AS x, v FROM k WHERE rank = 1"""


@query(f"WITH {PX}, r AS (SELECT * FROM px), {WARPED}")
def warp_tiles(spark, d):
    return raster.from_tiles(warp.warp(file_rows(spark, d, raster.to_tiles(px(spark, d), 16)), 8, 32, tolerance=0), 32)


@query(f"""WITH {GRID}, h AS (SELECT band, y, x, sum(v) OVER w AS s, count(v) OVER w AS n FROM grid WINDOW w AS (PARTITION BY band, y ORDER BY x RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)),
  q AS (SELECT band, y, x, sum(s) OVER w AS s, sum(n) OVER w AS n FROM h WINDOW w AS (PARTITION BY band, x ORDER BY y RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING)),
  r AS (SELECT band, y, x, CAST(s // n AS BIGINT) AS v FROM q WHERE n > 0 AND (band, x // 16, y // 16) IN (SELECT (band, x // 16, y // 16) FROM px)), {WARPED}""")
def raw_focal_mean(spark, d):
    mean = halo.focal_mean(raster.to_tiles(px(spark, d), 16), 16, 20)
    return raster.from_tiles(warp.warp(file_rows(spark, d, mean), 8, 32, tolerance=0), 32)


@query(f"""WITH {PTS}, c AS (SELECT DISTINCT floor((lon + 180) / 360 * 64) AS c, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 64) AS r FROM pts WHERE lat > 0.1),
  g AS (SELECT c, r, i, j, (c * 16 + i + 0.5) / 1024 * 360 - 180 AS lon, degrees(2 * atan(exp(pi() * (1 - 2 * (r * 16 + j + 0.5) / 1024))) - pi() / 2) AS lat, floor((c + 0.5) / 64 * 60) * 6 - 177 AS lon0
    FROM c CROSS JOIN range(16) a(i) CROSS JOIN range(16) b(j)), {TM.format("g")}
  SELECT CAST(c AS INT) AS col, CAST(r AS INT) AS row, CAST(j AS INT) AS y, CAST(i AS INT) AS x, round(e / 1000, 2) AS exact_x, round((10000000 - n) / 1000, 2) AS exact_y, true AS within FROM tm""")
def approximate_mapping(spark, d):
    col, row = grid.tile_of(F.col("lon"), F.col("lat"), 6)
    zone = F.floor((F.col("col") + 0.5) / 64 * 60).cast("int") + 1
    tiles = points(spark, d).where("lat > 0.1").select(col.alias("col"), row.alias("row")).distinct().withColumn("crs", F.concat(F.lit("EPSG:326"), F.lpad(zone.cast("string"), 2, "0")))
    rows = warp.mapped_cells(tiles, 6, 16, (0.0, 10000000.0, 1000.0, 1000.0), 0.05)
    near = (F.abs(F.col("exact_x") - F.col("near_x")) <= 0.05) & (F.abs(F.col("exact_y") - F.col("near_y")) <= 0.05)
    return rows.select("col", "row", "y", "x", F.round("exact_x", 2).alias("exact_x"), F.round("exact_y", 2).alias("exact_y"), near.alias("within"))


# Map algebra and layers


@query(f"""WITH {PX} SELECT a.y, a.x, round((a.v - b.v) / NULLIF(CAST(a.v + b.v AS DOUBLE), 0), 9) AS nd FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND a.band = 1 AND b.band = 2""")
def normalized_difference(spark, d):
    return raster.normalized_difference(px(spark, d), 1, 2).withColumn("nd", F.round("nd", 9))


@query(f"""WITH {PX} SELECT a.band, a.y, a.x, CAST(a.v - b.v AS INT) AS diff, CAST(a.v + b.v AS INT) AS total, round(a.v / NULLIF(CAST(b.v AS DOUBLE), 0), 9) AS ratio
  FROM px a JOIN px b ON a.y = b.y AND a.x = b.x AND b.band = a.band + 1""")
def local_ops(spark, d):
    p = px(spark, d)
    both = raster.local(p, p.withColumn("band", F.col("band") - 1), lambda a, b: F.struct((a - b).alias("diff"), (a + b).alias("total"), F.round(F.try_divide(a.cast("double"), b.cast("double")), 9).alias("ratio")), "r")
    return both.select("band", "y", "x", "r.diff", "r.total", "r.ratio")


LAYERS = f"""{PX}, l AS (SELECT 0 AS layer, band, y, x, v FROM px WHERE (x + y) % 3 <> 0 UNION ALL SELECT 1, band, y, x, CASE WHEN x % 5 = 0 THEN NULL ELSE v + 100 END FROM px WHERE x % 2 = 0
  UNION ALL SELECT 2, band, y, x, v + 200 FROM px)"""


def layers(spark, d) -> DataFrame:
    p = px(spark, d)
    second = p.where("x % 2 = 0").withColumn("v", F.when(F.col("x") % 5 != 0, F.col("v") + 100))
    return raster.union([p.where("(x + y) % 3 <> 0"), second, p.withColumn("v", F.col("v") + 200)])


@query(f"WITH {LAYERS} SELECT band, y, x, v, CAST(layer AS INT) AS layer FROM l")
def layer_union(spark, d):
    return layers(spark, d)


@query(f"WITH {LAYERS} SELECT band, y, x, v FROM (SELECT *, row_number() OVER (PARTITION BY band, y, x ORDER BY layer) AS n FROM l) WHERE n = 1")
def keep_first(spark, d):
    return raster.keep_first(layers(spark, d))


@query(f"WITH {LAYERS} SELECT band, y, x, coalesce(max(v) FILTER (layer = 0), max(v) FILTER (layer = 1), max(v) FILTER (layer = 2)) AS v FROM l GROUP BY 1, 2, 3")
def mosaic_merge(spark, d):
    return raster.merge(layers(spark, d))


@query(f"WITH {LAYERS} SELECT band, y, x, CASE WHEN bool_or(v IS NULL) THEN NULL ELSE CAST(sum(v) AS BIGINT) END AS v FROM l GROUP BY 1, 2, 3")
def local_add(spark, d):
    return raster.add(layers(spark, d))


@query(f"WITH {PX} SELECT CAST(k AS INT) AS level, band, CAST(y // (1 << k) AS INT) AS y, CAST(x // (1 << k) AS INT) AS x, round(avg(v), 6) AS v FROM px CROSS JOIN range(4) r(k) GROUP BY ALL")
def pyramid(spark, d):
    return raster.pyramid(px(spark, d), 3).withColumn("v", F.round("v", 6))


@query(f"""WITH {PX} SELECT CAST(x // 16 AS INT) AS col, CAST(y // 16 AS INT) AS row, CAST(count(DISTINCT band) AS BIGINT) AS bands, string_agg(DISTINCT CAST(band AS VARCHAR), ',' ORDER BY CAST(band AS VARCHAR)) AS names,
  CAST(sum(v) AS BIGINT) AS total, CAST(count(v) AS BIGINT) AS cells FROM px GROUP BY 1, 2""")
def band_stack(spark, d):
    s = raster.band_stack(raster.to_tiles(px(spark, d), 16))
    flat = F.filter(F.flatten("stack"), lambda v: v.isNotNull())
    return s.select("col", "row", F.size("bands").cast("long").alias("bands"), F.concat_ws(",", F.transform("bands", lambda b: b.cast("string"))).alias("names"), F.aggregate(flat, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"), F.size(flat).cast("long").alias("cells"))


@query(f"WITH {PX} SELECT band, y, x, v FROM px WHERE v IS NOT NULL")
def tile_explode(spark, d):
    return raster.from_tiles(raster.to_tiles(px(spark, d), 16), 16)


@query(f"WITH {GRID} SELECT band, CAST(x // 16 AS INT) AS col, CAST(y // 16 AS INT) AS row, string_agg(coalesce(CAST(v AS VARCHAR), '-'), ',' ORDER BY y, x) AS strip FROM grid WHERE y % 16 BETWEEN 14 AND 15 AND x % 16 BETWEEN 0 AND 2 GROUP BY 1, 2, 3 HAVING count(*) > 0 AND (band, col, row) IN (SELECT (band, x // 16, y // 16) FROM px)")
def strip(spark, d):
    t = raster.to_tiles(px(spark, d), 16)
    part = scalar.strip(F.col("cells"), 16, 14, 0, 2, 3)
    return t.select("band", "col", "row", F.concat_ws(",", F.transform(part, lambda v: F.coalesce(v.cast("string"), F.lit("-")))).alias("strip"))


@query(f"WITH {PX} SELECT band, min(x // 16)::INT AS col_min, max(x // 16)::INT AS col_max, min(y // 16)::INT AS row_min, max(y // 16)::INT AS row_max FROM px GROUP BY 1")
def layer_bounds(spark, d):
    t = px(spark, d).select("band", F.floor(F.col("x") / 16).cast("int").alias("c"), F.floor(F.col("y") / 16).cast("int").alias("r"))
    return t.groupBy("band").agg(F.min("c").alias("col_min"), F.max("c").alias("col_max"), F.min("r").alias("row_min"), F.max("r").alias("row_max"))


@query(f"WITH {PX} SELECT count(*)::BIGINT AS tiles FROM (SELECT DISTINCT band, x // 16, y // 16 FROM px)")
def tile_count(spark, d):
    return px(spark, d).select("band", F.floor(F.col("x") / 16), F.floor(F.col("y") / 16)).distinct().agg(F.count("*").alias("tiles"))


@query(f"""WITH {PX}, c AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, degrees((i + 0.5) / 128 * 2 * pi() - pi()) AS lon, degrees(atan(sinh(pi() * (1 - 2 * (j + 0.5) / 128)))) AS lat FROM range(128) a(i) CROSS JOIN range(128) b(j))
  SELECT c.i, c.j, px.band, px.v FROM c JOIN px ON px.x = floor((c.lon + 180) / 5.625) AND px.y = floor((85.06 - c.lat) / 2.6581) """)
def reproject_nn(spark, d):
    cells = spark.range(128).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(127))).alias("j"))
    lon = F.degrees((F.col("i") + 0.5) / 128 * 2 * F.pi() - F.pi())
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (F.col("j") + 0.5) / 128))))
    return raster.reproject(px(spark, d), cells, lon, lat, (-180.0, 85.06), (5.625, 2.6581))


MOSAIC = [((-180.0, 85.06), (5.625, 2.6581)), ((-60.0, 60.0), (2.0, 2.0)), ((-180.0, 85.06), (11.25, 5.3162))]


@query(f"""WITH {PX}, c AS (SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, degrees((i + 0.5) / 64 * 2 * pi() - pi()) AS lon, degrees(atan(sinh(pi() * (1 - 2 * (j + 0.5) / 64)))) AS lat FROM range(64) a(i) CROSS JOIN range(64) b(j)),
  s(layer, x0, y0, w, h) AS (VALUES {", ".join(f"({i}, {x0}::DOUBLE, {y0}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE)" for i, ((x0, y0), (w, h)) in enumerate(MOSAIC))}),
  m AS (SELECT c.i, c.j, px.band, px.v, row_number() OVER (PARTITION BY c.i, c.j, px.band ORDER BY s.layer) AS n
  FROM c CROSS JOIN s JOIN px ON px.x = floor((c.lon - s.x0) / s.w) AND px.y = floor((s.y0 - c.lat) / s.h) AND px.band % 3 >= s.layer)
  SELECT i, j, band, v FROM m WHERE n = 1""")
def mosaic_reproject(spark, d):
    cells = spark.range(64).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    lon = F.degrees((F.col("i") + 0.5) / 64 * 2 * F.pi() - F.pi())
    lat = F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * (F.col("j") + 0.5) / 64))))
    sources = [(px(spark, d).where(F.col("band") % 3 >= i), *place) for i, place in enumerate(MOSAIC)]
    return raster.mosaic(sources, cells, lon, lat, ["i", "j"])


@query(f"""WITH {PX} SELECT a.band, a.y, a.x, max(b.v) - min(b.v) AS spread, CAST(sum(b.v * (2 - abs(a.x - b.x)) * (2 - abs(a.y - b.y))) AS BIGINT) AS weighted
  FROM px a JOIN px b ON a.band = b.band AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3""")
def focal_kernel(spark, d):
    weight = lambda dx, dy: (2 - F.abs(dx)) * (2 - F.abs(dy))
    out = raster.focal(px(spark, d), 1, lambda v, dx, dy: F.struct((F.max(v) - F.min(v)).alias("spread"), F.sum(v * weight(dx, dy)).alias("weighted")))
    return out.select("band", "y", "x", "v.spread", "v.weighted")


@query(f"""WITH {PX}, l AS (SELECT *, 0 AS layer FROM px UNION ALL SELECT band, y, 63 - x, v + 1, 1 FROM px)
  SELECT band, y, x, CAST(count(v) AS BIGINT) AS n, max(v * 10 + layer) AS top FROM l GROUP BY 1, 2, 3""")
def in_key_aggregate(spark, d):
    own = px(spark, d)
    other = own.select("band", "y", (63 - F.col("x")).alias("x"), (F.col("v") + 1).alias("v"))
    out = raster.in_key([own, other], lambda v, layer: F.struct(F.count(v).alias("n"), F.max(v * 10 + layer).alias("top")))
    return out.select("band", "y", "x", "v.n", "v.top")


@query(f"WITH {PX} SELECT band, y, x, ({' + '.join(f'((x >> {i}) & 1) * {4**i} + ((y >> {i}) & 1) * {2 * 4**i}' for i in range(16))})::BIGINT AS z FROM px")
def zorder(spark, d):
    return px(spark, d).select("band", "y", "x", grid.morton(F.col("x"), F.col("y")).alias("z"))


@query(f"WITH {PX} SELECT band, y, x, row_number() OVER (ORDER BY x, y, band) - 1 AS place FROM px")
def key_order(spark, d):
    return raster.in_order(px(spark, d).select("band", "y", "x"), ["x", "y", "band"])


# Matching


@query(f"WITH {TILES}, {CODES} SELECT t.id, string_agg(c.col || ':' || c.row, ',' ORDER BY c.col, c.row) AS codes FROM t JOIN c ON {MEET} GROUP BY 1")
def extent_join_inverted(spark, d):
    text = lambda codes: F.concat_ws(",", F.transform(codes, lambda s: F.concat_ws(":", s.col.cast("string"), s.row.cast("string"))))
    return match.match_inverted(file_tiles(spark, d), code_boxes(spark, d), 4.0, text)


@query(f"WITH {TILES}, {CODES} SELECT c.col, c.row, string_agg(CAST(t.id AS VARCHAR), ',' ORDER BY t.id) AS tiles FROM t JOIN c ON {MEET} GROUP BY 1, 2")
def extent_join_forward(spark, d):
    return match.match_forward(file_tiles(spark, d), code_boxes(spark, d), 4.0, lambda tiles: F.concat_ws(",", F.transform(tiles, lambda v: v.cast("string"))))


@query(f"WITH {CODES} SELECT col, row, b.band FROM c CROSS JOIN (VALUES ('B1'), ('B3'), ('B4')) b(band)")
def codes_cross_bands(spark, d):
    return match.codes_by_bands(code_boxes(spark, d).select("col", "row"), ["B1", "B3", "B4"])


@query("SELECT DISTINCT l_partkey AS col, l_suppkey AS row FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_returnflag = 'R' AND s.l_partkey = lineitem.l_partkey AND s.l_suppkey = lineitem.l_suppkey)")
def incremental_tiles(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("col"), F.col("l_suppkey").alias("row"), "l_returnflag")
    return match.missing(rows.select("col", "row").distinct(), rows.where("l_returnflag = 'R'"), ["col", "row"])


@query("SELECT c_custkey AS path, c_mktsegment AS band, n.orders IS NOT NULL AS cached, coalesce(n.orders, 0) AS tiles FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) n ON o_custkey = c_custkey")
def header_cache_miss(spark, d):
    want = table(spark, d, "customer").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("band"))
    cache = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.count("*").alias("tiles"))
    hit = want.join(cache, "path").select("path", "band", F.lit(True).alias("cached"), "tiles")
    return hit.unionByName(match.missing(want, cache, ["path"]).select("path", "band", F.lit(False).alias("cached"), F.lit(0).cast("long").alias("tiles")))


@query("""WITH r AS (SELECT o_custkey AS path, o_orderkey AS "offset", 100 + o_orderkey % 7 AS byte_count FROM orders),
  b AS (SELECT *, max("offset" + byte_count) OVER (PARTITION BY path ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR "offset" > before + 800 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY "offset") AS island FROM b)
  SELECT path, CAST(island AS BIGINT) AS island, min("offset") AS start, max("offset" + byte_count) AS "end", count(*) AS tiles FROM i GROUP BY 1, 2""")
def coalesce_ranges(spark, d):
    reads = table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("offset"), (100 + F.col("o_orderkey") % 7).alias("byte_count"))
    return match.coalesce_ranges(reads, 800)


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 7 = 0 THEN 0 ELSE greatest(0, least(p_partkey % 4, CAST(floor(log2(round(156543.033928 / pow(2.0, p_size % 21), 6) / (10 + p_partkey % 90))) AS INT) + 1)) END AS INT) AS level FROM part""")
def overview_level(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    wanted = F.when(s % 7 != 0, grid.resolution((s % 21).cast("double")))
    return table(spark, d, "part").select("p_partkey", match.overview_level(wanted, (10 + k % 90).cast("double"), k % 4 + 1).alias("level"))


@query("""SELECT p_partkey, CAST(greatest(0, trunc((p_size - 20.0) / 7.5)) AS INT) AS first, CAST(least(p_partkey % 9, trunc((p_size + p_partkey % 31 - 20.0) / 7.5)) AS INT) AS last FROM part""")
def tile_window(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = match.tile_window(s.cast("double"), (s + k % 31).cast("double"), F.lit(20.0), F.lit(7.5), k % 9 + 1)
    return table(spark, d, "part").select("p_partkey", a.alias("first"), b.alias("last"))


@query("""SELECT p_partkey, (p_size % 5) * 7680.0 * pow(2.0, p_partkey % 4) + 300000 AS xmin, 4500000 - (p_partkey % 6 + 1) * 7680.0 * pow(2.0, p_partkey % 4) AS ymin,
  (p_size % 5 + 1) * 7680.0 * pow(2.0, p_partkey % 4) + 300000 AS xmax, 4500000 - (p_partkey % 6) * 7680.0 * pow(2.0, p_partkey % 4) AS ymax FROM part""")
def cog_tile_extent(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", *match.cog_tile_extent(k % 6, s % 5, k % 4, F.lit(300000.0), F.lit(4500000.0), F.lit(30.0), F.lit(30.0)))


# Catalog


@query("""SELECT o_orderkey, c_name, p_name, l_linenumber AS rank, c_mktsegment || '/' || o_orderkey || '_' || l_linenumber || '.tif' AS path
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' AND l_linenumber <> 1""")
def catalog_lookup(spark, d):
    o, c, i, p = (table(spark, d, n) for n in ("orders", "customer", "lineitem", "part"))
    rows = cat.select(
        o, ["o_orderkey", "c_name", "p_name", "l_linenumber", "c_mktsegment"], [("o_orderstatus", "=", "F"), ("c_mktsegment", "=", "BUILDING"), ("l_linenumber", "<>", 1)],
        [(c, o.o_custkey == c.c_custkey), (i, i.l_orderkey == o.o_orderkey), (p, i.l_partkey == p.p_partkey)], {"l_linenumber": "rank"},
    )
    path = F.concat("c_mktsegment", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("_"), F.col("rank").cast("string"), F.lit(".tif"))
    return rows.select("o_orderkey", "c_name", "p_name", "rank", path.alias("path"))


@query("SELECT l_orderkey, l_quantity AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag <> 'N' AND l_linenumber <= 3")
def conj_filter(spark, d):
    tests = [("l_quantity", ">=", 10), ("l_discount", "<", 0.05), ("l_returnflag", "!=", "N"), ("l_linenumber", "<=", 3)]
    return cat.select(table(spark, d, "lineitem"), ["l_orderkey", "l_quantity"], tests, aliases={"l_quantity": "quantity"})


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13')")
def band_filter(spark, d):
    return cat.only_bands(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["Brand#11", "Brand#12", "Brand#13"], "p_brand")


# Scalars


@query(f"WITH {PTS} SELECT event_id, CAST(floor((lon + 180) / 360 * 2048) AS INT) AS col, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 2048) AS INT) AS row FROM pts")
def point_to_tile(spark, d):
    col, row = grid.tile_of(F.col("lon"), F.col("lat"), ZOOM)
    return points(spark, d).select("event_id", col.alias("col"), row.alias("row"))


@query(f"WITH {PTS} SELECT event_id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * atanh(sin(radians(lat))), 3) AS y FROM pts")
def mercator_xy(spark, d):
    x, y = grid.to_mercator(F.col("lon"), F.col("lat"))
    return points(spark, d).select("event_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("""SELECT event_id, round(degrees((event_id * 7919 % 40075017 - 20037508) / 6378137.0), 8) AS lon,
  round(degrees(2 * atan(exp((user_id * 104729 % 30000001 - 15000000) / 6378137.0)) - pi() / 2), 8) AS lat FROM events""")
def mercator_back(spark, d):
    x, y = F.col("event_id") * 7919 % 40075017 - 20037508, F.col("user_id") * 104729 % 30000001 - 15000000
    lon, lat = grid.from_mercator(x.cast("double"), y.cast("double"))
    return table(spark, d, "events").select("event_id", F.round(lon, 8).alias("lon"), F.round(lat, 8).alias("lat"))


@query(f"""WITH {PTS}, p AS (SELECT event_id, 108 + (lon + 180) / 60 AS lon, lat, 111 AS lon0 FROM pts), {TM.format("p")}
  SELECT event_id, round(e, 2) AS x, round(n, 2) AS y, 0.0::DOUBLE AS off_lon, 0.0::DOUBLE AS off_lat FROM tm""")
def utm_round_trip(spark, d):
    # within a zone; there and back differs by less than a tenth of a metre
    p = points(spark, d).withColumn("lon", 108 + (F.col("lon") + 180) / 60)
    p = p.withColumn("to", projection.projected(F.col("lon"), F.col("lat"), 32649))
    p = p.withColumn("back", projection.projected(F.col("to.x"), F.col("to.y"), 32649, inverse=True))
    off = lambda a, b: F.round(F.abs(a - b), 6) + 0.0
    return p.select("event_id", F.round("to.x", 2).alias("x"), F.round("to.y", 2).alias("y"), off(F.col("back.x"), F.col("lon")).alias("off_lon"), off(F.col("back.y"), F.col("lat")).alias("off_lat"))


@query(f"""WITH {PTS}, p AS (SELECT event_id, lon / 6 - 96 AS lon, 25 + (lat + 80) / 160 * 25 AS lat FROM pts),
  e(e2, ec, f1, f2, f0) AS (VALUES (0.006694380022900788, 0.08181919104281579, radians(29.5), radians(45.5), radians(23.0))),
  q AS (SELECT *, (1 - e2) * (sin(radians(lat)) / (1 - e2 * pow(sin(radians(lat)), 2)) + atanh(ec * sin(radians(lat))) / ec) AS q, (1 - e2) * (sin(f1) / (1 - e2 * pow(sin(f1), 2)) + atanh(ec * sin(f1)) / ec) AS q1,
    (1 - e2) * (sin(f2) / (1 - e2 * pow(sin(f2), 2)) + atanh(ec * sin(f2)) / ec) AS q2, (1 - e2) * (sin(f0) / (1 - e2 * pow(sin(f0), 2)) + atanh(ec * sin(f0)) / ec) AS q0,
    pow(cos(f1), 2) / (1 - e2 * pow(sin(f1), 2)) AS m1, pow(cos(f2), 2) / (1 - e2 * pow(sin(f2), 2)) AS m2 FROM p CROSS JOIN e),
  n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n, m1 + (m1 - m2) / (q2 - q1) * q1 AS c FROM q)
  SELECT event_id, round(6378137.0 / n * sqrt(c - n * q) * sin(n * radians(lon + 96)), 2) AS x, round(6378137.0 / n * (sqrt(c - n * q0) - sqrt(c - n * q) * cos(n * radians(lon + 96))), 2) AS y FROM n""")
def albers(spark, d):
    p = points(spark, d).select("event_id", (F.col("lon") / 6 - 96).alias("lon"), (25 + (F.col("lat") + 80) / 160 * 25).alias("lat"))
    p = p.withColumn("to", projection.projected(F.col("lon"), F.col("lat"), "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +ellps=GRS80"))
    return p.select("event_id", F.round("to.x", 2).alias("x"), F.round("to.y", 2).alias("y"))


@query("""SELECT s_suppkey, round(s_suppkey % 2048 / 2048 * 360 - 180, 9) AS xmin, round((s_suppkey % 2048 + 1) / 2048 * 360 - 180, 9) AS xmax,
  round(degrees(2 * atan(exp(pi() * (1 - 2 * (800 + s_nationkey) / 2048))) - pi() / 2), 9) AS ymax, round(degrees(2 * atan(exp(pi() * (1 - 2 * (801 + s_nationkey) / 2048))) - pi() / 2), 9) AS ymin FROM supplier""")
def tile_extent(spark, d):
    e = grid.tile_extent(F.col("s_suppkey") % 2048, F.col("s_nationkey") + 800, ZOOM)
    rows = table(spark, d, "supplier").select("s_suppkey", e.alias("e"))
    return rows.select("s_suppkey", *[F.round(f"e.{c}", 9).alias(c) for c in ("xmin", "xmax", "ymax", "ymin")])


@query("SELECT p_partkey, CAST(p_size % 21 AS INT) AS zoom, round(156543.033928 / (1 << CAST(p_size % 21 AS INT)), 6) AS resolution FROM part")
def zoom_resolution(spark, d):
    zoom = (F.col("p_size") % (grid.MAX_ZOOM + 1)).cast("int")
    return table(spark, d, "part").select("p_partkey", zoom.alias("zoom"), grid.resolution(zoom.cast("double")).alias("resolution"))


@query(f"""WITH {PTS}, b AS (SELECT event_id, floor((lon + 180) / 360 * 2048) AS c0, floor((least(lon + event_id % 7 / 10.0, 179.9) + 180) / 360 * 2048) AS c1,
    floor((1 - asinh(tan(radians(lat + event_id % 3 / 10.0))) / pi()) / 2 * 2048) AS r0, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 2048) AS r1 FROM pts),
  c AS (SELECT *, unnest(range(CAST(c0 AS BIGINT), CAST(c1 AS BIGINT) + 1)) AS col FROM b)
  SELECT event_id, CAST(col AS INT) AS col, CAST(unnest(range(CAST(r0 AS BIGINT), CAST(r1 AS BIGINT) + 1)) AS INT) AS row FROM c""")
def bbox_to_tiles(spark, d):
    e = F.col("event_id")
    boxes = points(spark, d).select(e, F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.least(F.col("lon") + e % 7 / 10, F.lit(179.9)).alias("xmax"), (F.col("lat") + e % 3 / 10).alias("ymax"))
    return grid.box_tiles(boxes, ZOOM).select("event_id", "col", "row")


@query("""WITH b AS (SELECT s_suppkey, 1.0 * (s_suppkey % 300) - 150 AS w, s_nationkey * 2.5 - 30 AS s, s_suppkey % 300 - 150 + s_nationkey % 5 * 0.5 AS e, s_nationkey * 2.5 - 29.3 AS n FROM supplier),
  c AS (SELECT *, unnest(range(CAST(floor((w + 180) / 360 * 512) AS BIGINT), CAST(floor((e + 180) / 360 * 512) AS BIGINT) + 1)) AS col FROM b)
  SELECT s_suppkey, CAST(col AS INT) AS col, CAST(unnest(range(CAST(floor((1 - ln(tan(radians(n)) + 1 / cos(radians(n))) / pi()) / 2 * 512) AS BIGINT), CAST(floor((1 - ln(tan(radians(s)) + 1 / cos(radians(s))) / pi()) / 2 * 512) AS BIGINT) + 1)) AS INT) AS row FROM c""")
def lateral_box_tiles(spark, d):
    tables.register(spark)
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    w, s = (k % 300 - 150).cast("double"), n * 2.5 - 30
    boxes = table(spark, d, "supplier").select("s_suppkey", w.alias("w"), s.alias("s"), (w + n % 5 * 0.5).alias("e"), (n * 2.5 - 29.3).alias("n"))
    return spark.sql("SELECT s_suppkey, t.col, t.row FROM {boxes}, LATERAL box_tiles(w, s, e, n, 9) t", boxes=boxes)


@query(f"WITH {PX} SELECT band, y, x, v FROM px WHERE v IS NOT NULL AND band <= 2")
def lateral_tile_cells(spark, d):
    tables.register(spark)
    tiles = raster.to_tiles(px(spark, d).where("band <= 2"), 16)
    return spark.sql("SELECT band, c.y, c.x, c.v FROM {tiles}, LATERAL tile_cells(col, row, cells, 16) c", tiles=tiles)


@query(f"""WITH r(code_set, zoom, c0, c1, r0, r1, step, out_col, out_row) AS (VALUES {", ".join(f"({i}, {z}, {c[0]}, {c[1]}, {r[0]}, {r[1]}, {(*r, 1)[2]}, {o[0] if o else -1}, {o[1] if o else -1})" for i, (z, c, r, o) in enumerate(jobs.CODE_SETS))})
  SELECT s_suppkey, CAST(zoom AS INT) AS zoom, CAST(c AS INT) AS col, CAST(w AS INT) AS row FROM supplier JOIN r ON s_suppkey % 6 = code_set CROSS JOIN range(0, 1700) a(c) CROSS JOIN range(400, 860) b(w)
  WHERE c BETWEEN c0 AND c1 AND w BETWEEN r0 AND r1 AND (w - r0) % step = 0 AND NOT (c = out_col AND w = out_row)""")
def code_list(spark, d):
    asked = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % len(jobs.CODE_SETS)).cast("int").alias("code_set"))
    return asked.join(jobs.code_sets(spark), "code_set").select("s_suppkey", "zoom", "col", "row")


@query("SELECT s_suppkey, 'layer' || s_nationkey || '/11/png/' || s_suppkey || '-' || s_nationkey AS key FROM supplier")
def tile_key(spark, d):
    n = F.col("s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", grid.tile_key(F.concat(F.lit("layer"), n.cast("string")), F.lit(11), F.lit("png"), F.col("s_suppkey"), n).alias("key"))


@query("SELECT s_suppkey, 'layer' || s_nationkey AS layer, 11 AS zoom, 'png' AS kind, CAST(s_suppkey AS INT) AS col, CAST(s_nationkey AS INT) AS row FROM supplier")
def parse_tile_path(spark, d):
    return tile_key(spark, d).select("s_suppkey", *grid.parse_tile_key(F.col("key")))


@query("SELECT s_nationkey, string_agg(s_suppkey || '-' || s_nationkey, ',' ORDER BY s_suppkey) AS codes FROM supplier GROUP BY 1")
def codes_to_csv(spark, d):
    code = F.array_sort(F.collect_list("s_suppkey"))
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(code.alias("k"))
    return rows.select("s_nationkey", F.concat_ws(",", F.transform("k", lambda k: F.concat(k.cast("string"), F.lit("-"), F.col("s_nationkey").cast("string")))).alias("codes"))


@query("""SELECT o_orderkey, ('0x' || substr(m, 11, 2) || substr(m, 9, 2) || substr(m, 7, 2) || substr(m, 5, 2))::BIGINT AS value FROM (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS m FROM orders)""")
def le_decode(spark, d):
    data = F.unhex(F.md5(F.col("o_orderkey").cast("string").cast("binary")))
    return table(spark, d, "orders").select("o_orderkey", scalar.little_endian(data, 3, 4).alias("value"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS time FROM orders""")
def parse_time(spark, d):
    k, form = F.col("o_orderkey") % 5, F.lit("no time")
    for i, f in enumerate(scalar.TIME_FORMS):
        form = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(form)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(scalar.parse_time(form), "yyyy-MM-dd HH:mm:ss").alias("time"))


@query("""WITH n AS (SELECT ['int8raw', 'uint8', 'int16', 'uint16raw', 'int32', 'float32raw', 'float32', 'float64raw', 'float64'] AS names, [1, 1, 1, 1, 1, 2, 2, 3, 3] AS p)
  SELECT p_partkey, names[1 + p_size % 9] AS a, names[1 + length(p_type) % 9] AS b,
    CASE greatest(p[1 + p_size % 9], p[1 + length(p_type) % 9]) WHEN 1 THEN 'int32raw' WHEN 2 THEN 'float32raw' ELSE 'float64raw' END AS common FROM part CROSS JOIN n""")
def type_promote(spark, d):
    names = F.array(*[F.lit(n) for n in ("int8raw", "uint8", "int16", "uint16raw", "int32", "float32raw", "float32", "float64raw", "float64")])
    at = lambda k: F.element_at(names, (1 + k % 9).cast("int"))
    rows = table(spark, d, "part").select("p_partkey", at(F.col("p_size")).alias("a"), at(F.char_length("p_type")).alias("b"))
    return rows.select("p_partkey", "a", "b", scalar.promote(F.col("a"), F.col("b")).alias("common"))


@query("""WITH t AS (SELECT p_partkey AS id, p_size::DOUBLE AS x1, (p_partkey % 50)::DOUBLE AS y1, p_partkey % 31 - 7.5 AS x2, p_size * 2::DOUBLE AS y2, p_partkey % 17 - 5::DOUBLE AS x3, -3.25 AS y3 FROM part)
  SELECT id, least(x1, x2, x3)::DOUBLE AS xmin, least(y1, y2, y3)::DOUBLE AS ymin, greatest(x1, x2, x3)::DOUBLE AS xmax, greatest(y1, y2, y3)::DOUBLE AS ymax FROM t""")
def wkt_envelope(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    spots = [F.concat_ws(" ", x.cast("double").cast("string"), y.cast("double").cast("string")) for x, y in ((s, k % 50), (k % 31 - 7.5, s * 2), (k % 17 - 5, F.lit(-3.25)), (s, k % 50))]
    ring = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *spots), F.lit("))"))
    return table(spark, d, "part").select(k.alias("id"), scalar.wkt_envelope(ring).alias("e")).select("id", "e.*")