"""Tile-form neighbourhoods against the pixel form and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import halo, raster


def cells_of(tiles, size):
    return {(r.band, r.y, r.x): r.v for r in raster.from_tiles(tiles, size).collect()}


@pytest.fixture(scope="module")
def px(spark):
    """Two bands with gaps over 4 x 3 tiles of 8 cells, one tile without any cell, negative values, and a tile far away."""
    rng = np.random.default_rng(3)
    rows = [(b, y, x, int(rng.integers(-50, 99))) for b in (1, 2) for y in range(24) for x in range(32) if rng.random() < 0.7 and not (8 <= y < 16 and 16 <= x < 24)]
    return spark.createDataFrame([*rows, (1, 80_003, 160_005, 7), (1, 80_004, 160_005, 8)], "band int, y int, x int, v int")


@pytest.mark.parametrize("radius", [1, 3, 8, 20])
def test_focal_mean(spark, px, radius):
    own = {(r.band, r.y, r.x): r.v for r in px.collect()}
    tiles = raster.to_tiles(px, 8)
    got = cells_of(halo.focal_mean(tiles, 8, radius), 8)
    there = {(r.band, r.col, r.row) for r in tiles.select("band", "col", "row").collect()}
    assert {(b, x // 8, y // 8) for b, y, x in got} == there
    near = px.where("y < 100")
    plain = {(r.band, r.y, r.x): r["mean"] for r in raster.focal_mean(near, radius, (0, 31, 0, 23)).collect() if r["mean"] is not None and (r.band, r.x // 8, r.y // 8) in there}
    # the pixel form divides towards zero as well
    assert {k: v for k, v in got.items() if k[1] < 100} == plain
    far = {(y, x): v for (b, y, x), v in got.items() if y > 100}
    for y in range(80_000, 80_008):
        for x in range(160_000, 160_008):
            cells = [v for (b, j, i), v in own.items() if j > 100 and abs(j - y) <= radius and abs(i - x) <= radius]
            assert far.get((y, x)) == (sum(cells) // len(cells) if cells else None)


@pytest.mark.parametrize("name, centre", [("slope", False), ("slope", True), ("aspect", False), ("aspect", True)])
def test_terrain(spark, px, name, centre):
    tiles = raster.to_tiles(px.withColumn("v", F.col("v") % 4), 8)
    got = cells_of(halo.terrain(tiles, 8, name, 2.5, centre), 8)
    plain = raster.terrain(raster.from_tiles(tiles, 8).where("y < 100"), name, 2.5, centre, bounds=(0, 31, 0, 23))
    there = {(r.band, r.col, r.row) for r in tiles.select("band", "col", "row").collect()}
    want = {(r.band, r.y, r.x): r[name] for r in plain.collect() if r[name] is not None and (r.band, r.x // 8, r.y // 8) in there}
    assert {k: v for k, v in got.items() if k[1] < 100} == want and want


def test_what_is_sent(spark):
    """Beside each tile only its strips move: 4 r T + 4 r r cells for each of the inner ones, not eight more tiles."""
    px = spark.range(64 * 64).select(F.lit(1).alias("band"), F.floor(F.col("id") / 64).cast("int").alias("y"), (F.col("id") % 64).cast("int").alias("x"), F.lit(1.5).alias("v"))
    tiles = raster.to_tiles(px, 16)
    sizes = lambda r: {k: n for k, n in halo.strips(tiles, ["band"], 16, r).where("col between 0 and 3 and row between 0 and 3").groupBy((F.col("dc") == 0) & (F.col("dr") == 0)).agg(F.sum(F.size("cells"))).collect()}
    assert sizes(2) == {True: 4096, False: 48 * 2 * 16 + 36 * 4}
    assert sizes(20)[False] < 16 * ((16 + 40) ** 2 - 16 * 16)
    mean = halo.focal_mean(tiles, 16, 20)
    assert mean.schema.simpleString() == "struct<band:int,col:int,row:int,cells:array<bigint>>"
    assert {r.v for r in raster.from_tiles(mean, 16).select("v").distinct().collect()} == {1}


def test_pyramid_of_tiles(spark, px, tmp_path):
    """Equal to the pixel form at every level, also left and above of the origin; stored by layer and zoom in Z-order."""
    from rasterloom.operators.levels import pyramid_tiles
    from rasterloom.sources.store import write_tile_layer

    near = px.where("y < 100").withColumn("x", F.col("x") - 13).withColumn("y", F.col("y") - 5)
    tiles = raster.to_tiles(near, 8)
    want = {(r.level, r.band, r.y, r.x): round(r.v, 9) for r in raster.pyramid(near, 3).collect() if r.v is not None}
    rows = pyramid_tiles(tiles, 3, 8)
    got = {}
    for k in range(4):
        got |= {(k, *key): round(v, 9) for key, v in cells_of(rows.where(F.col("level") == k), 8).items()}
    assert got == want
    write_tile_layer(tiles, "a", 3, str(tmp_path / "s"), 8)
    stored = spark.read.parquet(str(tmp_path / "s"))
    assert {(r.zoom, r.n) for r in stored.groupBy("zoom").agg(F.count("*").alias("n")).collect()} == {(3 - r.level, r.n) for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()}
    with pytest.raises(ValueError):
        pyramid_tiles(tiles, 1, 7)
    assert pyramid_tiles(tiles.limit(0), 2, 8).count() == 0


def test_refused_and_empty(spark, px):
    with pytest.raises(ValueError):
        halo.terrain_kernel("ruggedness")
    assert halo.focal_mean(raster.to_tiles(px.limit(0), 8), 8, 3).count() == 0
    assert raster.to_tiles(px.limit(0), 8).count() == 0


def test_approximate_lines():
    """Exact where asked, at the ends of lines and where a curve needs it; within the tolerance elsewhere."""
    from rasterloom.operators.warp import approximate

    calls = []

    def exact(r, c):
        calls.append(len(r))
        return c + 3 * np.sin(c / 40) + r, r * 2.0 + c**2 / 900

    y, x = np.mgrid[:50, :257]
    want = np.stack(exact(y, x))
    for tolerance in (0, 0.05, 1.0):
        calls.clear()
        got = np.stack(approximate(exact, 50, 257, tolerance))
        assert np.abs(got - want).max() <= tolerance
        assert (tolerance == 0) == (sum(calls) >= 50 * 257)
    assert np.stack(approximate(exact, 1, 1, 0.05)).ravel().tolist() == [0, 0]
