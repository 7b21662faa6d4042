"""The tile store: layers as Parquet, rendered tiles as files, lookups of stored tiles, settings."""

from __future__ import annotations

import struct
import time
import urllib.request
import zlib
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from rasterloom.functions.grid import morton
from rasterloom.operators.levels import pyramid_tiles
from rasterloom.operators.raster import pyramid
from rasterloom.sources import jpeg
from rasterloom.sources.files import Ranges
from rasterloom.sources.sink import TileImages


@dataclass
class Settings:
    """What a deployment sets; `load` reads it from YAML."""

    env: str = "local"
    store: str = ""
    catalog_url: str = ""
    callback_url: str = ""
    partitions: int = 16
    options: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Settings:
        import yaml

        with open(path, encoding="utf-8") as file:
            data = yaml.safe_load(file) or {}
        known = {k: v for k, v in data.items() if k in cls.__dataclass_fields__ and k != "options"}
        return cls(**known, options={k: v for k, v in data.items() if k not in known})

    def session(self) -> SparkSession:
        builder = SparkSession.builder.config("spark.sql.adaptive.enabled", "true")
        for k, v in self.options.items():
            if k.startswith("spark."):
                builder = builder.config(k, v)
        return (builder.master("local[*]") if self.env == "local" else builder).getOrCreate()


def grey(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells' share between their least and greatest value, and whether they have data."""
    ok = np.isfinite(cells)
    low, high = (cells[ok].min(), cells[ok].max()) if ok.any() else (0.0, 0.0)
    return np.clip(np.where(ok, (cells - low) / ((high - low) or 1), 0), 0, 1), ok


def encode(image: np.ndarray, kind: int) -> bytes:
    """PNG of 8-bit lines (height, width * channels); kind: 0 grey, 2 colours, 6 colours and alpha."""
    height, width = image.shape[0], image.shape[1] // {0: 1, 2: 3, 6: 4}[kind]

    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.concatenate([np.zeros((height, 1), np.uint8), image], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def png(cells: np.ndarray, ramp: bool = True) -> bytes:
    """8-bit PNG of a square of cells: grey, or a ramp of 100 steps from black to white whose alpha falls from 255 to 170."""
    size = int(np.sqrt(len(cells)))
    part, ok = grey(cells.astype(float))
    if not ramp:
        return encode(np.round(part * 255).astype(np.uint8).reshape(size, size), 0)
    step = np.minimum((part * 100).astype(int), 99)
    tone, alpha = np.round(step / 99 * 255).astype(np.uint8), np.where(ok, np.round(255 - step / 99 * 85), 0).astype(np.uint8)
    return encode(np.stack([tone, tone, tone, alpha], axis=1).reshape(size, size * 4), 6)


def png_bands(bands: list[np.ndarray]) -> bytes:
    """8-bit PNG of a square from its bands: one grey, two or more red, green (and blue); clear where no band has data."""
    parts, oks = zip(*(grey(b.astype(float)) for b in bands[:3]))
    tones = [np.round(p * 255).astype(np.uint8) for p in parts]
    tones = tones * 3 if len(tones) == 1 else [*tones, np.zeros_like(tones[0])][:3]
    size = int(np.sqrt(len(tones[0])))
    return encode(np.stack([*tones, np.where(np.any(oks, axis=0), 255, 0).astype(np.uint8)], axis=1).reshape(size, size * 4), 6)


def jpg(cells: np.ndarray) -> bytes:
    """Grey JPEG of a square of cells; those without data are black."""
    size = int(np.sqrt(len(cells)))
    return jpeg.encode(np.round(grey(cells.astype(float))[0] * 255).astype(np.uint8).reshape(size, size))


def jpg_bands(bands: list[np.ndarray]) -> bytes:
    """JPEG of a square from its bands, as `png_bands`, without clear cells."""
    if len(bands) == 1:
        return jpg(bands[0])
    tones = [np.round(grey(b.astype(float))[0] * 255).astype(np.uint8) for b in bands[:3]]
    size = int(np.sqrt(len(tones[0])))
    return jpeg.encode(np.stack([*tones, np.zeros_like(tones[0])][:3], axis=1).reshape(size, size, 3))


#: Encoders of each kind of image: of one band's cells, of several bands'.
ENCODERS = {"png": (png, png_bands), "jpg": (jpg, jpg_bands)}


def render(cells: Column, ramp: bool = True, kind: str = "png") -> Column:
    """Images of a column of cell arrays; null cells are transparent, in JPEG black."""
    one = ENCODERS[kind][0] if kind != "png" or ramp else lambda c: png(c, False)

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda c: None if c is None else one(np.asarray(c, float)))

    return run(cells)


def render_bands(stack: Column, kind: str = "png") -> Column:
    """Images of a column of arrays of cell arrays, one for each band in the order of `band_stack`."""
    some = ENCODERS[kind][1]

    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda bands: None if bands is None else some([np.asarray(b, float) for b in bands]))

    return run(stack)


def write_layer(px: DataFrame, layer: str, zoom: int, path: str, tile: int = 256) -> None:
    """A layer with its pyramid down to zoom 0, in Z-order, partitioned by layer and zoom; only these partitions change."""
    levels = pyramid(px, zoom).select(F.lit(layer).alias("layer_id"), (zoom - F.col("level")).alias("zoom"), "band", "y", "x", "v")
    col, row = F.floor(F.col("x") / tile).cast("int"), F.floor(F.col("y") / tile).cast("int")
    out = levels.withColumn("z", morton(col, row)).repartition("zoom", "z").sortWithinPartitions("zoom", "z", "band", "y", "x")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer_id", "zoom").parquet(path)


def write_tile_layer(tiles: DataFrame, layer: str, zoom: int, path: str, size: int = 256) -> None:
    """`write_layer` of whole tiles (band, col, row, cells): rows of band, col, row and cells for each zoom, in Z-order."""
    levels = pyramid_tiles(tiles, zoom, size).select(F.lit(layer).alias("layer_id"), (zoom - F.col("level")).alias("zoom"), "band", "col", "row", "cells")
    out = levels.withColumn("z", morton(F.col("col"), F.col("row"))).repartition("zoom", "z").sortWithinPartitions("zoom", "z", "band")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer_id", "zoom").parquet(path)


def write_images(tiles: DataFrame, layer: str, zoom: int, path: str, kind: str = "png", options: dict | None = None, mode: str = "append") -> int:
    """Files path/layer/zoom/kind/col-row.kind, from the executors to a shared folder or object store, all of them or none; how many.

    tiles: col, row and cells, or the bands and stack of `band_stack`, which give coloured images. Of tiles of several bands
    only those of the lowest one are taken. mode: append, or overwrite to delete the layer's other images of the zoom.
    """
    if kind not in ENCODERS:
        raise ValueError(f"cannot write {kind}; {', '.join(ENCODERS)} only")
    spark, folder = tiles.sparkSession, f"{path}/{layer}/{zoom}/{kind}"
    if "stack" in tiles.columns:
        image = render_bands(F.col("stack"), kind)
    else:
        tiles = first_band(tiles) if "band" in tiles.columns else tiles
        image = render(F.col("cells"), kind=kind)
    spark.dataSource.register(TileImages)
    written = F.count(F.lit(1)).alias("n")
    seen = Observation()
    rows = tiles.select(F.col("col").cast("int").alias("col"), F.col("row").cast("int").alias("row"), image.alias("image")).observe(seen, written)
    rows.write.format("tile_images").options(kind=kind, **(options or {})).mode(mode).save(folder)
    return seen.get["n"]


def first_band(px: DataFrame) -> DataFrame:
    """The band of the lowest rank, for single-band images."""
    return px.join(px.agg(F.min("band").alias("band")), "band")


def load_images(spark: SparkSession, path: str, layer: str, zoom: int, kind: str = "png", wanted: DataFrame | None = None, options: dict | None = None) -> DataFrame:
    """col, row and bytes of the files of a layer, or of those wanted (col, row): only these files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(f"{path}/{layer}/{zoom}/{kind}")
    place = [F.regexp_extract("path", r"(-?\d+)-(-?\d+)\.\w+$", i).cast("int").alias(n) for i, n in ((1, "col"), (2, "row"))]
    if wanted is None:
        return files.select(*place, F.col("content").alias("image"))
    # the content is not a column of this plan, so Spark lists the files and reads none
    found = files.select(*place, "path", "length").join(wanted.select("col", "row").distinct(), ["col", "row"])

    def run(batches):
        for b in batches:
            for col, row, name, size in zip(b["col"], b["row"], b["path"], b["length"]):
                with Ranges(name, options) as read:
                    yield pd.DataFrame({"col": [col], "row": [row], "image": [read(0, size)]})

    return found.mapInPandas(run, "col int, row int, image binary")


def ensure_images(spark: SparkSession, path: str, layer: str, zoom: int, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame], kind: str = "png", options: dict | None = None) -> DataFrame:
    """col, row and bytes of the wanted images (col, row): those not stored are computed and stored before.

    compute: tiles for `write_images` from the col and row of those missing; nothing is computed where none is.
    """
    wanted = wanted.select("col", "row").distinct()
    lacking = wanted
    try:
        lacking = wanted.join(load_images(spark, path, layer, zoom, kind).select("col", "row"), ["col", "row"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    if not lacking.isEmpty():
        write_images(compute(lacking), layer, zoom, path, kind, options)
    return load_images(spark, path, layer, zoom, kind, wanted, options)


def load_wanted(images: DataFrame, wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Images wanted and not cached, of those that exist."""
    return images.join(wanted.select("col", "row"), ["col", "row"], "left_semi").join(cached.select("col", "row"), ["col", "row"], "left_anti")


def lookup(tiles: DataFrame, layer: str, zoom: int, kind: str, col: int, row: int) -> DataFrame:
    """One stored tile; the first three are partition columns of the store, so that one folder is read."""
    return tiles.where((F.col("layer") == layer) & (F.col("zoom") == zoom) & (F.col("kind") == kind) & (F.col("col") == col) & (F.col("row") == row))


def job_finished(url: str, layer: str, zoom: int, kind: str, codes: DataFrame, wait: float = 2.0) -> Future:
    """Tells a server which tiles (col, row; a job's own, so a list) a job has written, without waiting for the answer."""
    body = ",".join(f"{r.col}-{r.row}" for r in codes.select("col", "row").distinct().orderBy("col", "row").toLocalIterator())
    return post_async(f"{url}/job/finished/{layer}/{zoom}/{kind}", body.encode(), wait=wait)


def post_async(url: str, body: bytes, retries: int = 1, wait: float = 2.0) -> Future:
    """`notify` on a thread of its own; its result is the answer, or an empty string after an error."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(notify, url, body, retries, wait)
    finally:
        pool.shutdown(wait=False)


def notify(url: str, body: bytes, retries: int = 3, wait: float = 2.0) -> str:
    """POST to a callback; the answer, or an empty string when all tries fail."""
    for i in range(retries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, body), timeout=wait) as answer:
                return answer.read().decode()
        except OSError:
            time.sleep(min(0.1 * 2**i, wait))
    return ""
