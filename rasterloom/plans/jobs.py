"""Whole jobs: from a box to stored tiles, computing only what is missing."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.functions.grid import resolution, tile_corner, tiles_of_box
from rasterloom.functions.projection import ARRAYS, system
from rasterloom.operators import halo
from rasterloom.operators.match import cog_tile_extent, extent_join, missing, overview_level, visible_tiles
from rasterloom.operators.raster import around, band_stack, focal_mean_tiles, from_tiles, to_tiles
from rasterloom.operators.warp import Mapper, warp, window
from rasterloom.sources.cog import Opened, cell_form, read_tiles, tile_cells
from rasterloom.sources.store import job_finished, load_images, write_images


#: The band sets and tile rectangles (zoom, columns, rows, a tile left out) that the command line names by index.
BAND_SETS = [["B1", "B3", "B4"], ["B3", "B5"], ["B1"]]
CODE_SETS = [
    (11, (1680, 1681), (842, 844, 2), None), (11, (1679, 1682), (841, 844), None), (11, (1677, 1684), (839, 846), None),
    (11, (1675, 1686), (837, 848), None), (10, (836, 844), (417, 425), (836, 417)), (10, (671, 674), (425, 429), None),
]


def code_set(spark: SparkSession, index: int) -> tuple[DataFrame, int]:
    """Requested tiles (col, row) by index, and their zoom."""
    zoom, cols, rows, out = CODE_SETS[index]
    span = lambda lo, hi, step=1: F.sequence(F.lit(lo), F.lit(hi), F.lit(step))
    codes = spark.range(1).select(F.explode(span(*cols)).alias("col")).select("col", F.explode(span(*rows)).alias("row"))
    return (codes.where((F.col("col") != out[0]) | (F.col("row") != out[1])) if out else codes), zoom


def code_sets(spark: SparkSession) -> DataFrame:
    """All sets' requested tiles: code_set, zoom, col, row."""
    out = None
    for i in range(len(CODE_SETS)):
        codes, zoom = code_set(spark, i)
        part = codes.select(F.lit(i).alias("code_set"), F.lit(zoom).alias("zoom"), "col", "row")
        out = part if out is None else out.unionByName(part)
    return out


def required(df: DataFrame, what: str = "tiles within the visible range") -> DataFrame:
    """df, if it has a row; an error that names what is missing otherwise. For the edge of the API: it runs the plan's start."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def incremental_job(spark: SparkSession, px: DataFrame, stored: DataFrame, box: tuple[float, float, float, float], zoom: int, tile: int, radius: int = 1) -> DataFrame:
    """Tiles (band, col, row, cells) of the focal mean for the tiles of a box that are not stored.

    Only the cells of those tiles and of the tiles within the radius are read and laid out.
    """
    wanted = missing(tiles_of_box(spark, box, zoom), stored, ["col", "row"])
    return to_tiles(focal_mean_tiles(px, radius, tile, wanted).withColumnRenamed("mean", "v"), tile)


def map_tile_job(spark: SparkSession, coverage: DataFrame, index: DataFrame, box: tuple[float, float, float, float], zoom: int, epsg: int | str, dtype: str, bucket: float, path: str, layer: str, tile: int = 256, radius: int = 1, callback: str = "", options: dict | None = None) -> int:
    """From files to images: the tiles of a box that have no image yet, of the first band's focal mean; how many.

    Writes path/layer/zoom/png/col-row.png and tells the callback which tiles are new. No tile missing: nothing is read.
    """
    wanted = tiles_of_box(spark, box, zoom)
    try:
        stored = load_images(spark, path, layer, zoom).select("col", "row")
        wanted = missing(wanted, stored, ["col", "row"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if wanted.isEmpty():
        return 0
    first = coverage.join(coverage.agg(F.min("measurement_rank").alias("measurement_rank")), "measurement_rank")
    layer_tiles = visible_tile_layer(first, index, around(wanted, -(-radius // tile)), zoom, epsg, dtype, bucket, tile, options=options)
    tiles = halo.focal_mean(layer_tiles, tile, radius).join(wanted, ["col", "row"], "left_semi").drop("band")
    count = write_images(tiles, layer, zoom, path, options=options)
    if callback:
        job_finished(callback, layer, zoom, "png", wanted)
    return count


#: Operators by the names that a request gives, with the radius that a name stands for.
RADII = {"focalMean": 3, "focalMeanV2": 50}
TERRAIN = {"demAspect": ("aspect", False), "demSlope": ("slope", False), "aspect": ("aspect", True), "slope": ("slope", True)}
OPERATORS = [*RADII, *TERRAIN, *(f"{n}V2" for n in TERRAIN)]


def operator_of(name: str, zoom: int, radius: int | None = None) -> tuple[int, halo.Kernel]:
    """Radius and kernel of a neighbourhood operator's name. Both versions of one give the same cells. The cell size of terrain
    operators is that of the zoom, in a file's own grid too."""
    if name in RADII:
        return RADII[name] if radius is None else radius, halo.mean_kernel
    if name.removesuffix("V2") in TERRAIN:
        which, centre = TERRAIN[name.removesuffix("V2")]
        return 1, halo.terrain_kernel(which, round(156543.033928 / 2.0 ** max(zoom, 0), 6), centre)
    raise ValueError(f"no operator {name!r}; there are {', '.join(OPERATORS)}")


def run_operator(name: str, tiles: DataFrame, size: int, zoom: int, radius: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Tiles of a neighbourhood operator by the name that a request gives, over layers told apart by keys (band, if not given)."""
    reach, kernel = operator_of(name, zoom, radius)
    return halo.apply_with_halo(tiles, size, reach, kernel, "bigint", keys)


def to_crs(lon: Column, lat: Column, crs: int | str) -> tuple[Column, Column]:
    """Geographic coordinates in a source's system, by its EPSG code or definition."""
    return system(crs).forward(lon, lat)


def code_extents(codes: DataFrame, zoom: int, crs: int | str) -> DataFrame:
    """codes (col, row) with their envelope in a source's system.

    Where edges may be bent, points along them are taken too, and the envelope is widened by what can lie between; these
    are computed on arrays, as the formulas are long for column expressions.
    """
    own = system(crs)
    if own.kind in ("longlat", "webmerc") and not any(own.shift):
        (x0, y1), (x1, y0) = (own.forward(*tile_corner(F.col("col") + i, F.col("row") + i, zoom)) for i in (0, 1))
        return codes.select("col", "row", x0.alias("xmin"), y0.alias("ymin"), x1.alias("xmax"), y1.alias("ymax"))

    def run(batches):
        i, j = (v.ravel() for v in np.meshgrid(np.linspace(0, 1, 5), np.linspace(0, 1, 5)))
        for b in batches:
            col, row = (b.column(k).to_numpy(zero_copy_only=False)[:, None] for k in (0, 1))
            n = 1 << zoom
            with np.errstate(all="ignore"):
                x, y = own.forward((col + i) / n * 360 - 180, np.degrees(np.arctan(np.sinh(np.pi * (1 - 2 * (row + j) / n)))), ARRAYS)
            x0, y0, x1, y1 = x.min(axis=1), y.min(axis=1), x.max(axis=1), y.max(axis=1)
            w, h = 0.02 * (x1 - x0), 0.02 * (y1 - y0)
            ok = np.isfinite(w) & np.isfinite(h)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(v, mask=~ok) for v in (x0 - w, y0 - h, x1 + w, y1 + h))], ["col", "row", "xmin", "ymin", "xmax", "ymax"])

    boxes = codes.select(F.col("col").cast("int"), F.col("row").cast("int")).mapInArrow(run, "col int, row int, xmin double, ymin double, xmax double, ymax double")
    # a tile that the system cannot show meets no file
    return boxes.where("xmin IS NOT NULL")


def source_tiles(coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, bucket: float, ring: int = 0) -> DataFrame:
    """Index rows, with band and extent, of the overview level for the zoom and of tiles that meet a requested one, or lie
    within `ring` tiles of such a one.

    coverage: path, measurement_rank, resolution of each band; index: rows of `cog_index`.
    """
    own = level_tiles(coverage, index, zoom)
    met = file_codes(own, codes, zoom, epsg, bucket).select("path", "level", "col", "row").distinct()
    if ring:
        met = around(met, ring)
    return own.join(met, ["path", "level", "col", "row"], "left_semi")


def level_tiles(coverage: DataFrame, index: DataFrame, zoom: int) -> DataFrame:
    """Index rows of each file's overview level for the zoom, with band and extent; of each file's first sample, or the one that
    coverage names in a column sample."""
    files = index.groupBy("path").agg((F.max("level") + 1).alias("levels"))
    wanted = F.lit(None).cast("double") if zoom < 0 else resolution(F.lit(float(zoom)))
    sample = F.col("sample") if "sample" in coverage.columns else F.lit(0)
    chosen = files.join(coverage.select("path", F.col("measurement_rank").alias("band"), "resolution", sample.cast("int").alias("sample")), "path")
    chosen = chosen.select("path", "band", "sample", overview_level(wanted, F.col("resolution"), F.col("levels")).alias("level"))
    tiles = index.join(chosen, ["path", "level", "sample"])
    return tiles.select("*", *cog_tile_extent(F.col("row"), F.col("col"), F.col("level"), F.col("x_min"), F.col("y_max"), F.col("cell_w"), F.col("cell_h"), F.col("tile")))


#: Columns of a file tile's index row that reading and placing it need.
PLACE = ["path", "level", "band", "row", "col", "offset", "byte_count", "width", "height", "tile", "compression", "x_min", "y_max", "cell_w", "cell_h", "predictor", "sample", "samples", "planar", "big"]


def file_codes(tiles: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, bucket: float) -> DataFrame:
    """PLACE columns of each file's tile with the code_col and code_row of each requested one it meets."""
    keep = [*PLACE, "xmin", "ymin", "xmax", "ymax"]
    met = extent_join(tiles.select(*keep), code_extents(codes, zoom, epsg), bucket)
    return met.select(*[F.col(f"a_{c}").alias(c) for c in keep[:-4]], F.col("b_col").alias("code_col"), F.col("b_row").alias("code_row"))


def grouped(pairs: DataFrame, side: int = 8) -> DataFrame:
    """Each file tile with the requested ones (codes) it meets, in rows of a square of at most side * side of these."""
    keys = [c for c in pairs.columns if c not in ("code_col", "code_row")]
    block = [F.floor(F.col(c) / side).alias(f"_{c}") for c in ("code_col", "code_row")]
    codes = F.collect_set(F.struct(F.col("code_col").alias("col"), F.col("code_row").alias("row")))
    return pairs.groupBy(*keys, *block).agg(codes.alias("codes")).drop("_code_col", "_code_row")


def as_source(tiles: DataFrame, epsg: int | str) -> DataFrame:
    """Tiles of files with their cells in the form that `warp` reads; sources stand in the order of their paths."""
    size = lambda c: (F.col(c) * F.pow(F.lit(2.0), F.col("level"))).alias(c)
    return tiles.select(F.col("path").alias("source"), "band", "col", "row", "cells", "tile", "width", "height", "x_min", "y_max", size("cell_w"), size("cell_h"), F.lit(str(epsg)).alias("crs"), "codes")


def cut_padding(tiles: DataFrame) -> DataFrame:
    """Tiles of files whose cells beyond the file's edge are no data."""
    x, y = (lambda i: F.col("col") * F.col("tile") + i % F.col("tile")), (lambda i: F.col("row") * F.col("tile") + F.floor(i / F.col("tile")))
    inside = ((F.col("col") + 1) * F.col("tile") <= F.col("width")) & ((F.col("row") + 1) * F.col("tile") <= F.col("height"))
    cut = F.transform("cells", lambda v, i: F.when((x(i) < F.col("width")) & (y(i) < F.col("height")), v))
    return tiles.withColumn("cells", F.when(inside, F.col("cells")).otherwise(cut))


def raw_tiles(coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, dtype: str, bucket: float, **how) -> DataFrame:
    """The files' own tiles that meet a requested one, in their own system: col, row, the bands in the order of their rank
    and their cells."""
    tiles = source_tiles(coverage, index, codes, zoom, epsg, bucket)
    return band_stack(read_tiles(tiles.drop("xmin", "ymin", "xmax", "ymax"), dtype, **how))


#: The numbers of the match strategies; forward or inverted, and whether reads are shared.
METHODS = {"11": ("forward", False), "12": ("forward", True), "21": ("inverted", False), "22": ("inverted", True)}


def visible_tile_layer(coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, dtype: str, bucket: float, tile: int = 256, operator: str | None = None, method: str = "22", tolerance: float = 0.05, radius: int | None = None, options: dict | None = None, files: DataFrame | None = None) -> DataFrame:
    """Requested Web-Mercator tiles (band, col, row, cells), each cell by its nearest source cell; no tile where no file has data.

    Of several files of a band the first by path that has data gives the cell. Inverted methods read each file tile once and
    send what it paints to the requested tiles; forward ones send only index rows, and the task of a requested tile reads what
    it needs. operator: a neighbourhood operator by name, applied to the files' own tiles before they are placed, with the
    tiles within its radius.
    """
    own = level_tiles(coverage, index, zoom)
    pairs = file_codes(own, codes, zoom, epsg, bucket)
    strategy, shared = METHODS[method]
    if operator:
        reach, _ = operator_of(operator, zoom, radius)
        sizes = index.select("tile").distinct().limit(2).collect()
        if len(sizes) > 1:
            raise ValueError("an operator on files' own tiles needs tiles of one size")
        if not sizes:
            return warp(as_source(read_tiles(grouped(pairs), dtype, options=options, files=files), epsg), zoom, tile, tolerance)
        size = sizes[0].tile
        keys = ["path", "level", "band", "col", "row"]
        met = around(pairs.select(*keys).distinct(), -(-reach // size))
        near = own.join(met, keys, "left_semi").select(*(c for c in pairs.columns if c in own.columns))
        read = cut_padding(read_tiles(near, dtype, options=options, files=files))
        made = run_operator(operator, read, size, zoom, radius, ["path", "level", "band"])
        return warp(as_source(made.join(grouped(pairs), keys), epsg), zoom, tile, tolerance)
    if strategy == "forward":
        if files is not None:
            raise ValueError("forward methods read files by ranges")
        return forward_tiles(pairs, zoom, epsg, dtype, tile, tolerance, shared, options)
    how = {} if shared else {"gap": 0, "most": 0}
    return warp(as_source(read_tiles(grouped(pairs), dtype, options=options, files=files, **how), epsg), zoom, tile, tolerance)


def forward_tiles(pairs: DataFrame, zoom: int, epsg: int | str, dtype: str, size: int, tolerance: float, shared: bool, options: dict | None = None, kept: int = 64) -> DataFrame:
    """Requested tiles from pairs with file tiles: one task has all pairs of a requested tile, by path, and reads and paints them.

    No cells are moved between tasks; a file tile is read for each requested one that it meets, but for the `kept` last used
    ones of a task where these are shared.
    """
    kind, arrow = cell_form(dtype)
    names = [*(c for c in pairs.columns if c not in ("band", "code_col", "code_row")), "band", "code_col", "code_row"]

    def run(batches):
        mapper, known, reader = Mapper(zoom, size, tolerance), OrderedDict(), Opened(options)
        key = cells = clear = None

        def done():
            made = pa.ListArray.from_arrays(pa.array([0, size * size], pa.int32()), pa.array(cells.ravel(), arrow, mask=clear.ravel()))
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in key), made], ["band", "col", "row", "cells"])

        for b in batches:
            for own in b.to_pylist():
                at = own["band"], own["code_col"], own["code_row"]
                if at != key:
                    if key and not clear.all():
                        yield done()
                    key, cells, clear = at, np.zeros((size, size), arrow.to_pandas_dtype()), np.ones((size, size), bool)
                step = 2.0 ** own["level"]
                x, y = mapper(str(epsg), (own["x_min"], own["y_max"], own["cell_w"] * step, own["cell_h"] * step), *at[1:])
                found = window(x, y, own["tile"], own["col"], own["row"], own["width"], own["height"])
                if not found:
                    continue
                part, mine, index = found
                take = mine & clear[part]
                if not take.any():
                    continue
                place = own["path"], own["offset"], own["sample"]
                values = known.get(place)
                if values is None:
                    values = tile_cells(own, reader(own["path"], own["offset"], own["byte_count"]), dtype)
                    if shared:
                        known[place] = values
                        if len(known) > kept:
                            known.popitem(last=False)
                cells[part][take] = values[index[take]]
                clear[part] &= ~take
        if key and not clear.all():
            yield done()
        reader.close()

    order = ["band", "code_col", "code_row", "path", "offset"]
    dealt = pairs.select(*names).distinct().repartition(*order[:3]).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"band int, col int, row int, cells array<{kind}>")


def visible_layer(coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, dtype: str, bucket: float, tile: int = 256, **how) -> DataFrame:
    """The cells (band, y, x, v) of `visible_tile_layer`; no row where none is."""
    return from_tiles(visible_tile_layer(coverage, index, codes, zoom, epsg, dtype, bucket, tile, **how), tile)


def match_job(method: str, coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, dtype: str, bucket: float, tile: int = 256, **how) -> DataFrame:
    """Requested tiles by a method's number: 11 and 12 match forward, 21 and 22 inverted, with the same tiles; any other is a
    neighbourhood operator's name, applied to the files' own cells before they are placed."""
    chosen = {"method": method} if method in METHODS else {"operator": method}
    return visible_tile_layer(coverage, index, codes, zoom, epsg, dtype, bucket, tile, **chosen, **how)


def image_job(spark: SparkSession, method: str, coverage: DataFrame, index: DataFrame, size: int, epsg: int | str, dtype: str, bucket: float, path: str, layer: str, tile: int = 256, kind: str = "jpg", callback: str = "", **how) -> int:
    """`match_job` of a set of requested tiles by its index, written as images of its first three bands; how many. Tells the
    callback which tiles the set has."""
    codes, zoom = code_set(spark, size)
    count = write_images(band_stack(match_job(method, coverage, index, codes, zoom, epsg, dtype, bucket, tile, **how)), layer, zoom, path, kind, options=how.get("options"))
    if callback:
        job_finished(callback, layer, zoom, kind, codes)
    return count


def matched(method: str, coverage: DataFrame, index: DataFrame, codes: DataFrame, zoom: int, epsg: int | str, bucket: float) -> DataFrame:
    """Pairs (id: path and offset of a file's tile, col, row of a requested one) by the strategy of a method's number."""
    tiles = level_tiles(coverage, index, zoom).select(F.struct("path", "offset").alias("id"), "xmin", "ymin", "xmax", "ymax")
    return visible_tiles(tiles, code_extents(codes, zoom, epsg), bucket, METHODS[method][0])
