"""Neighbourhoods, map algebra and tiles against plain loops."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import raster
from rasterloom.plans.jobs import OPERATORS, RADII, incremental_job, run_operator

SIDE = 12


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(3)
    a = rng.integers(-9, 50, (SIDE, SIDE)).astype(float)
    a[rng.random(a.shape) < 0.2] = np.nan
    a[2:6, 3:8] = np.nan  # a hole larger than a window
    a[8, :] = 7  # a flat line
    a[9, :] = 7
    a[10, :] = 7
    return a


@pytest.fixture(scope="module")
def px(spark, cells):
    rows = [(1, y, x, None if np.isnan(v) else int(v)) for (y, x), v in np.ndenumerate(cells)]
    return spark.createDataFrame([r for r in rows if r[3] is not None or (r[1] + r[2]) % 2], "band int, y int, x int, v int")


def plane(df, name):
    return {(r.y, r.x): r[name] for r in df.collect()}


@pytest.mark.parametrize("radius", [1, 2, 15])
@pytest.mark.parametrize("f", [raster.focal_mean, raster.focal_mean_by_prefix])
def test_focal_mean(px, cells, radius, f):
    got = plane(f(px, radius, (0, SIDE - 1, 0, SIDE - 1)), "mean")
    assert len(got) == SIDE * SIDE
    for (y, x), v in got.items():
        part = cells[max(0, y - radius) : y + radius + 1, max(0, x - radius) : x + radius + 1]
        part = part[~np.isnan(part)]
        assert v == (int(part.sum() / len(part)) if len(part) else None)


def test_partitions_do_not_matter(spark, px):
    one, two = (plane(raster.focal_mean(px.repartition(n), 2), "mean") for n in (1, 7))
    assert one == two


def around(cells, y, x):
    get = lambda dy, dx: cells[y + dy, x + dx] if 0 <= y + dy < SIDE and 0 <= x + dx < SIDE else np.nan
    e1, e2, e3, e4, e5, e6, e7, e8 = (get(*p) for p in ((0, -1), (-1, 0), (0, 1), (1, 0), (-1, -1), (-1, 1), (1, 1), (1, -1)))
    return (e6 + 2 * e3 + e7) - (e5 + 2 * e1 + e8), (e8 + 2 * e4 + e7) - (e5 + 2 * e2 + e6)


def test_terrain(px, cells):
    bounds = (0, SIDE - 1, 0, SIDE - 1)
    slope, aspect = plane(raster.terrain(px, "slope", bounds=bounds), "slope"), plane(raster.terrain(px, "aspect", bounds=bounds), "aspect")
    flat = 0
    for (y, x), s in slope.items():
        dx, dy = around(cells, y, x)
        if np.isnan(dx) or np.isnan(dy):
            assert s is None and aspect[y, x] is None
        elif dy == 0:
            flat += 1
            assert s == (0 if dx == 0 else raster.BIG if dx > 0 else None)
        else:
            assert s == int(dx / dy * 100)
            assert aspect[y, x] == (0 if dx == 0 else max(-(2**31), min(2**31 - 1, int(1 / np.tan(dy / dx)))))
    assert flat
    centre = plane(raster.terrain(px, "slope", centre=True, bounds=bounds), "slope")
    assert all(v == (None if np.isnan(cells[p]) else slope[p]) for p, v in centre.items())
    with pytest.raises(ValueError):
        raster.terrain(px, "gloom")


def test_tiles_round_trip(px):
    data = px.where("v IS NOT NULL")
    for size in (4, 5, 16):
        back = raster.from_tiles(raster.to_tiles(data, size), size)
        assert plane(back, "v") == plane(data, "v")
    assert all(len(r.cells) == 16 for r in raster.to_tiles(data, 4).collect())


def test_layers(spark):
    rows = lambda *v: spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(v)], "band int, y int, x int, v int")
    both = raster.union([rows(1, None, 3), rows(10, 20, None, 40)])
    assert plane(raster.merge(both), "v") == {(0, 0): 1, (0, 1): 20, (0, 2): 3, (0, 3): 40}
    assert plane(raster.keep_first(both), "v") == {(0, 0): 1, (0, 1): None, (0, 2): 3, (0, 3): 40}
    assert plane(raster.add(both), "v") == {(0, 0): 11, (0, 1): None, (0, 2): None, (0, 3): 40}
    assert plane(raster.local(rows(1, None), rows(4, 2), lambda a, b: a + b), "v") == {(0, 0): 5, (0, 1): None}


def test_pyramid_and_empty(spark, px):
    top = raster.pyramid(px, 4).where("level = 4").collect()
    assert len(top) == 1 and top[0].v == pytest.approx(px.agg(F.avg("v")).first()[0])
    none = px.limit(0)
    assert raster.focal_mean(none, 1).count() == raster.pyramid(none, 2).count() == raster.to_tiles(none, 4).count() == 0


def test_halo_and_apply(spark, px):
    def total(pdf):
        import pandas as pd

        return pd.DataFrame({"band": pdf["band"].iloc[:1].to_numpy(), "cells": [len(pdf)]})

    got = raster.apply_tiles(px, 4, 1, total, "band int, cells long").agg(F.sum("cells")).first()[0]
    assert got == raster.halo(px, 4, 1).count() > px.count()


def test_halo_beyond_a_tile(px):
    """With a radius above the tile size every cell within it comes, from the tiles between too."""
    cells = [(r.band, r.y, r.x) for r in px.collect()]
    own = {(b, x // 3, y // 3) for b, y, x in cells}
    want = Counter()
    for b, c, r in own:
        want.update((b, c, r, y, x) for k, y, x in cells if k == b and 3 * c - 5 <= x <= 3 * c + 7 and 3 * r - 5 <= y <= 3 * r + 7)
    got = Counter((h.band, h.tile_col, h.tile_row, h.y, h.x) for h in raster.halo(px, 3, 5).collect())
    assert got == want


def test_jobs(spark, px):
    stored = spark.createDataFrame([(0, 0)], "col int, row int")
    # at zoom 2 the whole world is 4 x 4 tiles of 3 cells each
    job = incremental_job(spark, px, stored, (-179.0, -80.0, 179.0, 80.0), 2, 3).collect()
    assert len(job) == 15 and all((r.col, r.row) != (0, 0) for r in job)
    whole = plane(raster.focal_mean(px, 1), "mean")
    for r in job:
        assert r.cells == [whole[r.row * 3 + i // 3, r.col * 3 + i % 3] for i in range(9)]
    tiles = raster.to_tiles(px, 3)
    for name in OPERATORS:
        assert run_operator(name, tiles, 3, 11, **({"radius": 2} if name in RADII else {})).columns == ["band", "col", "row", "cells"]
    with pytest.raises(ValueError):
        run_operator("nothing", tiles, 3, 11)


@pytest.mark.parametrize("strip", [4, 4096])
@pytest.mark.parametrize("radius", [1, 6])
def test_strips_change_nothing(spark, monkeypatch, strip, radius):
    """Both forms of the focal mean against plain sums, with lines cut in strips shorter than the radius."""
    monkeypatch.setattr(raster, "STRIP", strip)
    rng = np.random.default_rng(4)
    px = {(int(y), int(x)): int(v) for y, x, v in rng.integers(-9, 9, (120, 3))}
    frame = spark.createDataFrame([(1, y, x, v) for (y, x), v in px.items()], "band int, y int, x int, v int")
    want = {}
    for y in range(min(y for y, _ in px), max(y for y, _ in px) + 1):
        for x in range(min(x for _, x in px), max(x for _, x in px) + 1):
            near = [px[b, a] for b in range(y - radius, y + radius + 1) for a in range(x - radius, x + radius + 1) if (b, a) in px]
            want[y, x] = int(sum(near) / len(near)) if near else None
    for f in (raster.focal_mean, raster.focal_mean_by_prefix):
        assert {(r.y, r.x): r.mean for r in f(frame, radius).collect()} == want


def test_pyramid_of_gaps_and_fractions(spark):
    rows = [(1, 0, 0, 1.5), (1, 1, 1, 2.5), (1, 5, 2, None), (2, 7, 7, 4.0)]
    got = {(r.level, r.band, r.y, r.x): r.v for r in raster.pyramid(spark.createDataFrame(rows, "band int, y int, x int, v double"), 3).collect()}
    assert got[1, 1, 0, 0] == 2.0 and got[1, 1, 2, 1] is None and got[3, 1, 0, 0] == 2.0 and got[3, 2, 0, 0] == 4.0 and len(got) == 12


def test_no_cross_joins(spark):
    px = spark.createDataFrame([(1, 0, 0, 1)], "band int, y int, x int, v int")
    for df in (raster.focal_mean(px, 2), raster.focal_mean_by_prefix(px, 2), raster.focal_mean_tiles(px, 2, 4, px.select("x", "y").toDF("col", "row"))):
        plan = df._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_in_order(spark):
    """Places by several keys, with other columns beside them, ties and nulls, over several ranges."""
    import random

    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3]), rng.randrange(40), f"r{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, name string").repartition(7)
    got = raster.in_order(df, ["a", "b"]).orderBy("place").collect()
    assert [r.place for r in got] == list(range(3000))
    key = lambda r: (r.a is not None, r.a or 0, r.b)
    assert [key(r) for r in got] == sorted(key(r) for r in got) and {r.name for r in got} == {r[2] for r in rows}
    assert raster.in_order(df.limit(0), ["a"]).count() == 0
