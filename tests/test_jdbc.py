"""The catalog in a database (Derby, which comes with Spark, in memory)."""

from types import SimpleNamespace

import pytest

from rasterloom.sources import catalog

URL = "jdbc:derby:memory:rasterloom;create=true"


def catalog_literal(v):
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


@pytest.fixture(scope="module")
def server(spark):
    tables = {
        "image": ([(1, "im", "EPSG:4326", "/d", "POLYGON ((1 2, 3 2, 3 5.5, 1 5.5, 1 2))", "2015/10/02"), (1, "it's", "EPSG:3857", "/e", "POINT (1 1)", None), (2, "im", "EPSG:1", "/f", "POINT (2 2)", None)],
                  "product_key int, image_identification string, crs string, path string, geom string, phenomenon_time string"),
        "product": ([(1, "LC", "uint16"), (2, "XX", "int8")], "id int, name string, dtype string"),
        "product_measurement": ([(1, 7, "B1", 1, 1, 30.0), (1, 8, "B2", 2, 1, 30.0), (1, 9, "QA", 3, 0, 30.0), (1, 99, "B9", 9, 1, 30.0), (2, 7, "B1", 1, 1, 15.0)], "product_key int, measurement_key int, band_num string, band_rank int, band_train int, resolution_m double"),
        "measurement": ([(7,), (8,), (9,)], "measurement_key int"),
    }
    frames = {}
    connection = spark._jvm.java.sql.DriverManager.getConnection(URL)
    statement = connection.createStatement()
    for name, (rows, schema) in tables.items():
        frames[name] = spark.createDataFrame(rows, schema)
        statement.execute(f"CREATE TABLE {name} ({schema.replace(' string', ' VARCHAR(200)')})")
        for r in rows:
            statement.execute(f"INSERT INTO {name} VALUES ({', '.join('NULL' if v is None else catalog_literal(v) for v in r)})")
    connection.close()
    return frames


@pytest.mark.parametrize("image, product", [("im", "LC"), ("it's", "LC"), ("im", "XX"), ("none", "LC"), ("im' OR '1'='1", "LC")])
def test_joins_run_on_the_server(spark, server, image, product):
    got = catalog.server_coverages(spark, URL, image, product)
    want = catalog.coverages(*server.values(), image, product)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "JDBC" in plan and "Join" not in plan.replace("JOIN", "") and "Exchange" not in plan


def test_bands_and_single_rows(spark, server):
    names = lambda *a: sorted(r.measurement for r in catalog.server_coverages(spark, URL, *a).collect())
    assert names("im", "LC", ["B2", "B7"]) == ["B2"] and names("im", "XX", ["B7"]) == ["B1"]
    plan = catalog.server_coverages(spark, URL, "im", "LC", ["B2"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "B2" in plan.split("PushedFilters")[1]


def test_filters_and_columns_reach_the_server(spark, server):
    rows = catalog.jdbc(spark, URL, "product_measurement").where("BAND_RANK >= 2").select("BAND_NUM")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(BAND_RANK,2)" in plan.replace("`", "") and sorted(r[0] for r in rows.collect()) == ["B2", "B9", "QA"]


def test_partitioned_reads(spark, server):
    rows = catalog.jdbc(spark, URL, "product_measurement", split=("MEASUREMENT_KEY", 0, 100, 4))
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 5


def test_memo_of_a_servers_catalog(spark, server):
    tables = [catalog.jdbc(spark, URL, t).transform(lambda d: d.toDF(*[c.lower() for c in d.columns])) for t in catalog.TABLES]
    known = catalog.Catalog(*tables)
    assert [r.measurement for r in known.bands("im", "LC", ["B1"]).collect()] == ["B1"]
    with pytest.raises(ValueError):
        known.bands("gone", "LC")


def test_retries(spark, monkeypatch):
    """Connections are tried so many times, then an error names the server; one that succeeds late is used."""
    waits, calls = [], []
    monkeypatch.setattr(catalog, "time", SimpleNamespace(sleep=waits.append))
    with pytest.raises(RuntimeError, match="after 3 tries"):
        catalog.jdbc(spark, "jdbc:derby:memory:nowhere", "t", delay=0.5)
    assert waits == [0.5, 0.5]

    def late():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return spark.range(3)

    assert catalog.connected(late, "u", 4, 0.1).count() == 3 and len(calls) == 3


def test_statement():
    sql = catalog.select_sql("a", ["a.x", "b.y"], [("a.k", ">=", 3), ("b.n", "!=", "o'clock")], [("b", "a.id", "b.id")], {"b.y": "z"})
    assert sql == "SELECT a.x, b.y AS z FROM a JOIN b ON a.id = b.id WHERE a.k >= 3 AND b.n <> 'o''clock'"
    assert catalog.select_sql("a", ["x"]) == "SELECT x FROM a"
    for bad in (("a; DROP TABLE b", ["x"]), ("a", ["x--"]), ("a", ["x"], [("k", "=", "")]), ("a", ["x"], [("k", "LIKE", "v")]), ("a", ["x"], [("k", "=", [1])]), ("a", ["x"], [("k = 1 OR k", "=", 1)])):
        with pytest.raises(ValueError):
            catalog.select_sql(*bad)
