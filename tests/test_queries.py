"""Every query beside its SQL in DuckDB, on the smallest test tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op"))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    order = sorted(frame.columns)
    plain = lambda v: None if v is None or v != v else v if isinstance(v, (str, bool)) else float(v)
    return sorted((tuple(plain(v) for v in r) for r in frame[order].astype(object).where(frame[order].notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns == ["band", "y", "x", "mean"]
