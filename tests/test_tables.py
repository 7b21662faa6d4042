"""Table functions from SQL."""

import numpy as np
import pytest
from cog_files import write_cog

from rasterloom.functions import tables
from rasterloom.sources import cog


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    tables.register(spark)


def test_box_tiles(spark):
    got = spark.sql("SELECT * FROM box_tiles(110D, 29D, 111D, 30D, 9)").collect()
    assert {(r.col, r.row) for r in got} == {(c, r) for c in (412, 413) for r in (211, 212)}
    assert spark.sql("SELECT * FROM box_tiles(CAST(NULL AS DOUBLE), 0D, 1D, 1D, 3)").count() == 0
    assert spark.sql("SELECT count(*) AS n FROM box_tiles(-180D, -85D, 179.9D, 85D, 4)").first().n == 256
    for bad in ("box_tiles('a', 0D, 1D, 1D, 3)", "box_tiles(0D, 0D, 1D, 1D, 21)", "box_tiles(0D, 0D, 1D, 1D, 1.5D)", "tile_cells(1, 2, 3, 4)", "cog_tiles(5)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {bad}").collect()


def test_tile_cells(spark):
    got = spark.sql("SELECT * FROM tile_cells(2, 1, array(1.5D, NULL, 3D, 4D), 2)").collect()
    assert [tuple(r) for r in got] == [(2, 4, 1.5), (3, 4, 3.0), (3, 5, 4.0)]
    assert spark.sql("SELECT * FROM tile_cells(2, 1, CAST(NULL AS ARRAY<INT>), 2)").count() == 0


def test_cog_tiles(spark, tmp_path):
    """The index through SQL is that of the data source, for each file that a table names."""
    for i in range(3):
        write_cog(str(tmp_path / f"{i}.tif"), [np.full((40, 50), i, "<u2"), np.full((20, 25), i, "<u2")], (0.0, 0.0), 1.0, tile=16)
    spark.createDataFrame([(f"{tmp_path}/{i}.tif",) for i in range(3)] + [(None,)], "path string").createOrReplaceTempView("named")
    got = spark.sql("SELECT t.* FROM named, LATERAL cog_tiles(named.path) t").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, cog.cog_index(spark, str(tmp_path)).collect())) and len(got) == 3 * (12 + 4)
