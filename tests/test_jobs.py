"""The way from files to map tiles."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.grid import tile_of
from rasterloom.functions.projection import ARRAYS, system
from rasterloom.operators import raster, warp
from rasterloom.plans import jobs
from cog_files import write_cog
from rasterloom.sources import cog
from rasterloom.sources.store import Settings


LAMBERT = "+proj=lcc +lat_1=25 +lat_2=47 +lat_0=30 +lon_0=105 +ellps=krass +towgs84=15.8,-154.4,-82.3"


@pytest.mark.parametrize("epsg", [4326, 3857, 32649, LAMBERT])
def test_visible_layer(spark, tmp_path, epsg):
    """Overlapping files in several systems: every method gives, cell by cell, the first file's nearest cell."""
    rng = np.random.default_rng(5)
    own = system(epsg)
    cell = 0.01 if epsg == 4326 else 1000.0
    x0, y0 = own.forward(110.0, 31.0, ARRAYS)
    shapes = {"a1": (300, 280, 0, 0), "b1": (120, 90, -30, 40), "c2": (300, 280, 0, 0)}
    layers = {}
    for name, (h, w, dx, dy) in shapes.items():
        levels = [rng.integers(1, 9999, (h // k, w // k)).astype("<u2") for k in (1, 2)]
        origin = float(x0 + dx * cell), float(y0 + dy * cell)
        write_cog(str(tmp_path / f"{name}.tif"), levels, origin, cell, tile=64)
        layers[name] = levels[0], origin
    index = cog.cog_index(spark, str(tmp_path))
    coverage = index.select("path").distinct().select("path", F.regexp_extract("path", r"(\d)\.tif", 1).cast("int").alias("measurement_rank"), F.lit(1000.0).alias("resolution"))
    zoom, size = 8, 16
    at = spark.range(1).select(*tile_of(F.lit(110.1), F.lit(30.9), zoom)).first()
    tiles = [(at[0] + i, at[1] + j) for i in (0, 1) for j in (-1, 0)]
    codes = spark.createDataFrame(tiles, "col int, row int")
    needed = jobs.source_tiles(coverage, index, codes, zoom, epsg, 64 * cell)
    assert 0 < needed.count() < index.where("level = 0").count()
    want, edge = {}, {}
    for col, row in tiles:
        lon, lat = warp.centres(col, row, zoom, size)
        for j in range(size):
            for i in range(size):
                x, y = own.forward(lon[i], lat[j], ARRAYS)
                # 1000 m cells and 611 m wanted: the full level
                for name in reversed(sorted(layers)):
                    a, origin = layers[name]
                    u, v = (x - origin[0]) / cell, (origin[1] - y) / cell
                    if 0 <= u < a.shape[1] and 0 <= v < a.shape[0]:
                        key = int(name[1]), row * size + j, col * size + i
                        want[key] = int(a[int(v), int(u)])
                    edge[row * size + j, col * size + i] = min(edge.get((row * size + j, col * size + i), 1), abs(u - round(u)), abs(v - round(v)))
    assert len({k[0] for k in want}) == 2
    layer = lambda **how: {(r.band, r.y, r.x): r.v for r in jobs.visible_layer(coverage, index, codes, zoom, epsg, "uint16", 64 * cell, size, **how).collect()}
    for method in jobs.METHODS:
        assert layer(method=method, tolerance=0) == want
    near = layer()
    # by the tolerance, cells differ only where their centre is as near to a cell's edge
    assert near.keys() ^ want.keys() <= {k for k in near | want if edge[k[1:]] <= 0.05}
    assert all(near[k] == want[k] or edge[k[1:]] <= 0.05 for k in near.keys() & want.keys())
    assert layer(method="11") == layer(method="12") == near
    with pytest.raises(ValueError):
        jobs.to_crs(F.lit(0.0), F.lit(0.0), 9)


@pytest.mark.parametrize("planar", [1, 2])
def test_samples_of_one_file_as_bands(spark, tmp_path, planar):
    """A file of three samples, each a band by the coverage's column sample, by every method and before placing."""
    rng = np.random.default_rng(7)
    a = rng.integers(1, 999, (120, 100, 3)).astype("<u2")
    write_cog(str(tmp_path / "a.tif"), [a], (110.0, 31.0), 0.01, tile=32, planar=planar, compression=5, predictor=2, big=True)
    index = cog.cog_index(spark, str(tmp_path))
    coverage = spark.createDataFrame([(f"{tmp_path}/a.tif", 10 + k, 1000.0, k) for k in range(3)], "path string, measurement_rank int, resolution double, sample int")
    codes = spark.createDataFrame([(206, 104), (206, 105)], "col int, row int")
    layer = lambda **how: {(r.band, r.y, r.x): r.v for r in jobs.visible_layer(coverage, index, codes, 8, 4326, "uint16", 0.5, 16, tolerance=0, **how).collect()}
    want = {}
    for row in (104, 105):
        lon, lat = warp.centres(206, row, 8, 16)
        for j in range(16):
            for i in range(16):
                x, y = math.floor((lon[i] - 110) / 0.01), math.floor((31 - lat[j]) / 0.01)
                if 0 <= x < 100 and 0 <= y < 120:
                    for k in range(3):
                        want[10 + k, row * 16 + j, 206 * 16 + i] = int(a[y, x, k])
    assert want and all(layer(method=m) == want for m in jobs.METHODS)
    mean = layer(operator="focalMean", radius=0)
    assert mean == want


def test_plan_has_no_row_for_each_pixel(spark, image):
    """Between files and requested tiles no step has as many rows as there are cells."""
    _, index, coverage = image
    codes = spark.createDataFrame([(206, 104), (206, 105)], "col int, row int")
    tiles = jobs.visible_tile_layer(coverage, index, codes, 8, 4326, "uint16", 0.5, 256)
    plan = tiles._jdf.queryExecution().toString()
    assert tiles.count() <= 4 and "Generate posexplode" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rectangles_of_a_source_are_put_together(spark, image):
    """Many small tiles of a file send one rectangle for each requested tile that they paint, also where few are kept at once."""
    _, index, coverage = image
    codes = spark.createDataFrame([(206, 104), (206, 105)], "col int, row int")
    pairs = jobs.file_codes(jobs.level_tiles(coverage, index, 8), codes, 8, 4326, 0.5)
    source = jobs.as_source(cog.read_tiles(jobs.grouped(pairs).coalesce(1), "uint16"), 4326)
    every = {}
    for kept in (32, 1, 0):
        parts = warp.paint(source, 8, 64, kept=kept)
        every[kept] = {(r.band, r.col, r.row, tuple(r.cells)) for r in warp.merge(parts, 64).collect()}
        assert parts.count() >= parts.select("source", "col", "row").distinct().count()
    assert warp.paint(source.repartition(1), 8, 64).count() == source.select("source", F.explode("codes")).distinct().count() < pairs.count()
    assert every[32] == every[1] == every[0]


def test_a_usual_tile(spark):
    """Tiles of 256 cells a side to tile form and back, in seconds."""
    px = spark.range(16 * 65536).select(F.lit(1).alias("band"), F.floor(F.col("id") / 1024).cast("int").alias("y"), (F.col("id") % 1024).cast("int").alias("x"), F.col("id").cast("int").alias("v"))
    began = time.time()
    tiles = raster.to_tiles(px.where("v % 7 <> 0"), 256)
    assert tiles.select(F.sum(F.size("cells"))).first()[0] == 16 * 65536
    assert time.time() - began < 30
    assert raster.from_tiles(tiles, 256).where("v <> y * 1024 + x OR v % 7 = 0").count() == 0


def slow_mean(px: dict, y: int, x: int, r: int):
    found = [px[b, a] for b in range(y - r, y + r + 1) for a in range(x - r, x + r + 1) if (b, a) in px]
    return sum(found) // len(found) if found else None


@pytest.mark.parametrize("radius", [1, 5])
def test_incremental_job(spark, radius):
    """A radius beyond the tile, and cells far apart, of which only those near the box are laid out."""
    rng, tile, zoom = np.random.default_rng(8), 3, 6
    box = (-5.0, -5.0, 12.0, 9.0)
    codes = [(r.col, r.row) for r in jobs.tiles_of_box(spark, box, zoom).collect()]
    lo, hi = min(codes), max(codes)
    px = {}
    for _ in range(500):
        px[int(rng.integers(3 * lo[1] - 9, 3 * hi[1] + 12)), int(rng.integers(3 * lo[0] - 9, 3 * hi[0] + 12))] = int(rng.integers(0, 99))
    far = {(10**6, 10**6): 5, (0, 0): 7}
    rows = spark.createDataFrame([(1, y, x, v) for (y, x), v in (px | far).items()], "band int, y int, x int, v int")
    stored = spark.createDataFrame([codes[0]], "col int, row int")
    got = {(r.col, r.row): r.cells for r in jobs.incremental_job(spark, rows, stored, box, zoom, tile, radius).collect()}
    assert set(got) <= set(codes[1:])
    for col, row in codes[1:]:
        want = [slow_mean(px, row * tile + i // tile, col * tile + i % tile, radius) for i in range(tile * tile)]
        assert got.get((col, row), [None] * tile * tile) == want


@pytest.fixture()
def image(spark, tmp_path):
    """Two bands' files, their index and coverage rows."""
    rng = np.random.default_rng(5)
    a = rng.integers(1, 9999, (120, 100)).astype("<u2")
    for band in (1, 2):
        write_cog(str(tmp_path / f"b{band}.tif"), [a + band], (110.0, 31.0), 0.01, tile=32)
    index = cog.cog_index(spark, str(tmp_path))
    coverage = index.select("path").distinct().select("path", F.regexp_extract("path", r"b(\d)\.tif", 1).cast("int").alias("measurement_rank"), F.lit(1000.0).alias("resolution"))
    return a, index, coverage


def test_operator_before_placing(spark, image):
    a, index, coverage = image
    zoom, size = 8, 16
    at = spark.range(1).select(*tile_of(F.lit(110.5), F.lit(30.5), zoom)).first()
    codes = spark.createDataFrame([(at[0], at[1])], "col int, row int")
    cells = lambda tiles: {(r.band, r.y, r.x): r.v for r in raster.from_tiles(tiles, size).collect()}
    plain = cells(jobs.match_job("22", coverage, index, codes, zoom, 4326, "uint16", 0.5, size))
    raw = cells(jobs.match_job("focalMean", coverage, index, codes, zoom, 4326, "uint16", 0.5, size, radius=1))
    assert raw.keys() == plain.keys() and raw
    for (band, y, x), v in raw.items():
        n = size << zoom
        i, j = math.floor(((x + 0.5) / n * 360 - 290) / 0.01), math.floor((31.0 - math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (y + 0.5) / n))))) / 0.01)
        near = a[max(0, j - 1) : j + 2, max(0, i - 1) : i + 2].astype(int) + band
        assert v == near.sum() // near.size
    pairs = [sorted(map(tuple, jobs.matched(m, coverage, index, codes, zoom, 4326, 0.5).collect())) for m in ("11", "21")]
    assert pairs[0] == pairs[1] != []
    stacks = jobs.raw_tiles(coverage, index, codes, zoom, 4326, "uint16", 0.5).collect()
    assert stacks and all(list(r.bands) == [1, 2] and len(r.stack[1]) == 32 * 32 for r in stacks)
    with pytest.raises(ValueError):
        jobs.match_job("none", coverage, index, codes, zoom, 4326, "uint16", 0.5, size)
    with pytest.raises(ValueError):
        jobs.required(jobs.match_job("22", coverage, index, codes.limit(0), zoom, 4326, "uint16", 0.5, size))


def test_map_tile_job(spark, image, tmp_path):
    """From files to images: only tiles without an image are computed."""
    _, index, coverage = image
    box, zoom, out = (110.1, 30.2, 110.9, 30.9), 9, str(tmp_path / "out")
    job = lambda: jobs.map_tile_job(spark, coverage, index, box, zoom, 4326, "uint16", 0.5, out, "a", tile=16)
    first = job()
    names = sorted(p.name for p in (tmp_path / "out/a" / str(zoom) / "png").iterdir() if not p.name.startswith("."))
    assert first == len(names) > 2
    assert job() == 0 or first < len(jobs.tiles_of_box(spark, box, zoom).collect())
    gone = tmp_path / "out/a" / str(zoom) / "png" / names[0]
    before = gone.read_bytes()
    gone.unlink()
    assert job() == 1 and gone.read_bytes() == before


@pytest.mark.parametrize("method", ["22", "focalMean"])
def test_image_job(spark, tmp_path, method):
    """A set's tiles as coloured JPEG files of three bands, in one call."""
    rng = np.random.default_rng(2)
    (tmp_path / "files").mkdir()
    for band in (1, 3, 4):
        write_cog(str(tmp_path / f"files/b{band}.tif"), [rng.integers(1, 999, (300, 220)).astype("<u2")], (114.9, 31.2), 0.005, tile=32)
    index = cog.cog_index(spark, str(tmp_path / "files"))
    coverage = index.select("path").distinct().select("path", F.regexp_extract("path", r"b(\d)\.tif", 1).cast("int").alias("measurement_rank"), F.lit(500.0).alias("resolution"))
    how = {"radius": 1} if method == "focalMean" else {}
    assert jobs.image_job(spark, method, coverage, index, 0, 4326, "uint16", 0.2, str(tmp_path / "out"), "multi", tile=16, **how) == 4
    files = {p.name: p.read_bytes() for p in (tmp_path / "out/multi/11/jpg").iterdir()}
    assert files.keys() == {f"{c}-{r}.jpg" for c in (1680, 1681) for r in (842, 844)}
    assert all(d[:2] == b"\xff\xd8" and b"\x11\x00\x02\x11\x01\x03\x11\x01" in d for d in files.values())


def test_command_line(capsys):
    from rasterloom.__main__ import main

    assert main([]) == 2 and "focalMean" in capsys.readouterr().out
    assert len({m for m in jobs.METHODS.values()}) == 4 and len(jobs.BAND_SETS) == 3
    assert jobs.operator_of("focalMean", 11)[0] == 3 and jobs.operator_of("focalMeanV2", 11)[0] == 50 and jobs.operator_of("focalMeanV2", 11, 7)[0] == 7
    assert all(jobs.operator_of(name, 11)[0] == 1 for name in ("demAspectV2", "demSlope", "aspectV2", "slope"))


@pytest.mark.parametrize("method", ["22", "focalMean", "focalMeanV2", "slopeV2"])
def test_a_command(spark, tmp_path, method):
    """From settings, catalog tables and files to the tiles of a set."""
    from rasterloom.__main__ import job, main

    a = np.random.default_rng(9).integers(1, 500, (300, 220)).astype("<u2")
    (tmp_path / "files").mkdir()
    write_cog(str(tmp_path / "files/im_B1.tif"), [a], (114.9, 31.2), 0.005, tile=32)
    tables = {
        "image": [{"product_key": 1, "image_identification": "im", "crs": "EPSG:4326", "path": str(tmp_path / "files"), "geom": "POINT (1 1)", "phenomenon_time": "2015-10-02"}],
        "product": [{"id": 1, "name": "LC", "dtype": "uint16"}],
        "product_measurement": [{"product_key": 1, "measurement_key": 7, "band_num": "B1", "band_rank": 1, "band_train": 1, "resolution_m": 500.0}],
        "measurement": [{"measurement_key": 7}],
    }
    lines = ["env: local", f"files: {tmp_path}/files", "bucket: 0.2", "tile: 16", f"store: {tmp_path}/out"]
    for name, rows in tables.items():
        spark.createDataFrame(rows).write.parquet(str(tmp_path / name))
        lines.append(f"{name}: {tmp_path / name}")
    (tmp_path / "s.yml").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = {(r.col, r.row): np.array(r.cells, object).reshape(16, 16) for r in job(Settings.load(str(tmp_path / "s.yml")), method, "im/LC", 0, 2, 4).collect()}
        if method == "focalMean":
            assert main([str(tmp_path / "s.yml"), method, "im/LC", "0", "2", "4", "mean.jpg"]) == 0
            assert sorted(p.name for p in (tmp_path / "out/mean/11/jpg").iterdir()) == ["1680-842.jpg", "1680-844.jpg", "1681-842.jpg", "1681-844.jpg"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.keys() == {(1680, 842), (1681, 842), (1680, 844), (1681, 844)}
    radius = {"focalMean": 3, "focalMeanV2": 50}.get(method)
    for (col, row), cells in got.items():
        lon, lat = warp.centres(col, row, 11, 16)
        for j in range(0, 16, 5):
            for i in range(0, 16, 5):
                x, y = (lon[i] - 114.9) / 0.005, (31.2 - lat[j]) / 0.005
                if not (0 <= x < 220 and 0 <= y < 300) or min(abs(x - round(x)), abs(y - round(y))) < 0.05:
                    continue
                x, y = int(x), int(y)
                if radius:
                    near = a[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1].astype(int)
                    assert cells[j, i] == near.sum() // near.size
                elif method == "22":
                    assert cells[j, i] == a[y, x]
                elif 0 < x < 219 and 0 < y < 299:
                    e = a[y - 1 : y + 2, x - 1 : x + 2].astype(int)
                    dx, dy = (e[:, 2] - e[:, 0]) @ [1, 2, 1], (e[2] - e[0]) @ [1, 2, 1]
                    assert dy == 0 or cells[j, i] == int(dx / 76.437028 / (dy / 76.437028) * 100)


def test_code_sets(spark):
    sizes = [jobs.code_set(spark, i)[0].count() for i in range(len(jobs.CODE_SETS))]
    assert sizes == [4, 16, 64, 144, 80, 20]
