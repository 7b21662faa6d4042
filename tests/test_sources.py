"""Files, catalog, matching, store and stream."""

import datetime
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import grid, projection, scalar
from rasterloom.operators import match
from cog_files import lzw, write_cog
from rasterloom.sources import catalog, cog, files, store
from rasterloom.streaming.incremental import incremental


@pytest.mark.parametrize("deflate", [False, True])
@pytest.mark.parametrize("side", [512, 600])
def test_cog_round_trip(spark, tmp_path, deflate, side):
    rng = np.random.default_rng(1)
    levels = [rng.integers(0, 60000, (side // k, side // k)).astype("<u2") for k in (1, 2, 4)]
    write_cog(str(tmp_path / "a.tif"), levels, (300000.0, 4500000.0), 30.0, deflate=deflate)
    index = cog.cog_index(spark, str(tmp_path))
    across = [-(-(side // k) // 256) for k in (1, 2, 4)]
    assert index.groupBy("level").count().orderBy("level").collect() == [(i, n * n) for i, n in enumerate(across)]
    got = cog.read_tiles(index.where("level = 1"), "uint16").collect()
    assert len(got) == across[1] ** 2
    for r in got:
        block = np.array(r.cells).reshape(256, 256)
        part = levels[1][r.row * 256 : r.row * 256 + 256, r.col * 256 : r.col * 256 + 256]
        assert (block[: part.shape[0], : part.shape[1]] == part).all() and (r.x_min, r.y_max, r.cell_w) == (300000.0, 4500000.0, 30.0)


def test_refused_files(tmp_path):
    block = np.zeros((16, 16), "<u2")
    for name, data in (("x", b"XX\0*" + bytes(12)), ("short", b"II"), ("version", b"II\x2c\0" + bytes(12))):
        (tmp_path / f"{name}.tif").write_bytes(data)
        with pytest.raises(ValueError):
            list(cog.index_rows(str(tmp_path / f"{name}.tif")))
    for tag, value in ((259, 7), (317, 4), (324, 1), (323, 32)):
        path = tmp_path / f"{tag}.tif"
        write_cog(str(path), [block], (0, 0), 1.0, tile=16)
        data = bytearray(path.read_bytes())
        at = data.index(struct.pack("<H", tag) + b"\x03\0" if tag in (259, 317) else struct.pack("<H", tag) + b"\x04\0")
        if tag == 324:
            struct.pack_into("<H", data, at, 999)  # no tiles
        else:
            struct.pack_into("<H", data, at + 8, value)
        path.write_bytes(data)
        with pytest.raises(ValueError):
            list(cog.index_rows(str(path)))


FORMS = [
    {}, {"big": True}, {"order": ">"}, {"big": True, "order": ">", "deflate": True}, {"compression": 5}, {"predictor": 2, "deflate": True}, {"predictor": 2, "order": ">", "compression": 5},
    {"samples": 3}, {"samples": 3, "planar": 2, "deflate": True}, {"samples": 2, "predictor": 2, "compression": 5}, {"samples": 3, "order": ">", "planar": 2, "big": True},
]


@pytest.mark.parametrize("form", FORMS, ids=str)
@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int32", "float32", "float64"])
def test_tiff_forms(tmp_path, form, dtype):
    """Every form of a file gives back its cells, by index rows and byte ranges alone."""
    rng = np.random.default_rng(6)
    form = dict(form)
    samples, kind = form.pop("samples", 1), np.dtype(scalar.DTYPES[dtype][1])
    if kind.kind == "f" and form.get("predictor") == 2:
        form["predictor"] = 3
    smooth = np.cumsum(rng.integers(-3, 4, (40, 70, samples)), axis=1)
    a = smooth.astype(kind) if kind.kind != "f" else (smooth / 7).astype(kind)
    path = str(tmp_path / "a.tif")
    write_cog(path, [a, a[::2, ::2]], (5.0, 9.0), 0.5, tile=32, **form)
    rows = [r for b in cog.index_rows(path) for r in b.to_pylist()]
    assert len(rows) == samples * (2 * 3 + 1 * 2)
    data = open(path, "rb").read()
    for r in rows:
        level = a if r["level"] == 0 else a[::2, ::2]
        part = level[r["row"] * 32 : r["row"] * 32 + 32, r["col"] * 32 : r["col"] * 32 + 32, r["sample"]]
        cells = cog.tile_cells(r, data[r["offset"] : r["offset"] + r["byte_count"]], dtype).reshape(32, 32)
        assert (cells[: part.shape[0], : part.shape[1]] == part).all() and (r["x_min"], r["y_max"], r["cell_w"]) == (5.0, 9.0, 0.5)


def test_lzw_tables():
    """Long data that fill the table more than once."""
    rng = np.random.default_rng(7)
    for data in (b"", b"a", b"a" * 20000, rng.integers(0, 256, 60000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 60000, dtype=np.uint8).tobytes()):
        assert cog.unlzw(lzw(data)) == data


def test_pushed_ranges_read_less(spark, tmp_path):
    """Filters on level, row and col reach the reader: the offsets read fall to what is asked; rows stay those of a plain filter."""
    a = np.zeros((1600, 1600), "<u2")
    path = str(tmp_path / "a.tif")
    write_cog(path, [a, a[::2, ::2]], (0.0, 0.0), 1.0, tile=16)
    every = [r for b in cog.index_rows(path) for r in b.to_pylist()]
    assert len(every) == 100 * 100 + 50 * 50
    data = open(path, "rb").read()

    def read_with(*filters):
        wanted, sizes = cog.Wanted(), []
        assert all(wanted.take(f) for f in filters)
        rows = [r for b in cog.index_of(path, lambda o, n: sizes.append(n) or data[o : o + n], wanted) for r in b.to_pylist()]
        return rows, sum(sizes)

    _, full = read_with()
    cases = [
        ([cog.EqualTo(("level",), 0), cog.EqualTo(("row",), 7), cog.GreaterThanOrEqual(("col",), 5), cog.LessThan(("col",), 9)], lambda r: r["level"] == 0 and r["row"] == 7 and 5 <= r["col"] < 9),
        ([cog.In(("level",), (1,)), cog.In(("row",), (3, 4, 49)), cog.GreaterThan(("col",), 47)], lambda r: r["level"] == 1 and r["row"] in (3, 4, 49) and r["col"] > 47),
        ([cog.LessThanOrEqual(("row",), 1), cog.EqualTo(("col",), 99)], lambda r: r["row"] <= 1 and r["col"] == 99),
        ([cog.EqualTo(("row",), 5), cog.EqualTo(("row",), 6)], lambda r: False),
        ([cog.In(("col",), ())], lambda r: False),
        ([cog.EqualTo(("level",), 9)], lambda r: False),
    ]
    for filters, plain in cases:
        rows, size = read_with(*filters)
        assert rows == [r for r in every if plain(r)] and size < full / 10 if filters[0] != cases[1][0][0] else rows == [r for r in every if plain(r)]
    assert read_with(*cases[0][0])[1] < 1500 < full
    assert not cog.Wanted().take(cog.EqualTo(("path",), "x"))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = cog.cog_index(spark, path).where("level = 0 AND row BETWEEN 2 AND 3 AND col IN (1, 98)")
        assert sorted((r.row, r.col) for r in got.collect()) == [(2, 1), (2, 98), (3, 1), (3, 98)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_many_files_share_partitions(spark, tmp_path):
    for i in range(7):
        write_cog(str(tmp_path / f"{i}.tif"), [np.full((16, 16), i, "<u2")], (0.0, 0.0), 1.0, tile=16)
    index = cog.cog_index(spark, str(tmp_path), partitions=3)
    assert index.rdd.getNumPartitions() == 3 and index.count() == 7
    named = spark.createDataFrame([(f"{tmp_path}/{i}.tif",) for i in (1, 1, 5)] + [(None,)], "path string")
    assert {(r.path[-5], r.cells[0]) for r in cog.read_tiles(cog.index_of_paths(named), "uint16").collect()} == {("1", 1), ("5", 5)}


@pytest.mark.parametrize("dtype", list(scalar.DTYPES))
def test_decode(dtype):
    _, code, _ = scalar.DTYPES[dtype]
    a = np.array([0, 1, 100, 127], code)
    assert (cog.decode(a.tobytes(), dtype, 4) == a).all()
    assert (cog.decode(zlib.compress(a.tobytes()), dtype, 6, True)[4:] == 0).all()


def test_catalog(spark):
    image = spark.createDataFrame([(1, "im", "EPSG:4326", "/d", "POLYGON ((1 2, 3 2, 3 5.5, 1 5.5, 1 2))", "2015/10/02")], "product_key int, image_identification string, crs string, path string, geom string, phenomenon_time string")
    product = spark.createDataFrame([(1, "LC", "uint16"), (2, "XX", "int8")], "id int, name string, dtype string")
    bands = spark.createDataFrame([(1, 7, "B1", 1, 1, 30.0), (1, 8, "B2", 2, 1, 30.0), (1, 9, "QA", 3, 0, 30.0), (1, 99, "B9", 9, 1, 30.0)], "product_key int, measurement_key int, band_num string, band_rank int, band_train int, resolution_m double")
    measure = spark.createDataFrame([(7,), (8,), (9,)], "measurement_key int")
    rows = catalog.coverages(image, product, bands, measure, "im", "LC").orderBy("measurement_rank")
    got = rows.collect()
    assert [(r.path, r.measurement) for r in got] == [("/d/im_B1.tif", "B1"), ("/d/im_B2.tif", "B2")]
    assert got[0].extent == (1.0, 2.0, 3.0, 5.5) and got[0].time == datetime.datetime(2015, 10, 2)
    assert catalog.only_bands(rows, ["B2"]).count() == 1
    assert catalog.only_bands(rows.limit(1), ["B7"]).count() == 1 and catalog.only_bands(rows.limit(1), ["B7"], strict=True).count() == 0
    for value, op in ((None, "="), ("", "="), (1, "like")):
        with pytest.raises(ValueError):
            catalog.select(bands, ["band_num"], [("band_rank", op, value)])


def test_extent_join_is_the_inequality_join(spark):
    rng = np.random.default_rng(2)
    boxes = lambda n: [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(rng.integers(-20, 20, (n, 4)) * np.array([1, 1, 0.1, 0.2]) + np.array([0, 0, 2.5, 4.5]))]
    a, b = boxes(80), boxes(50)
    b += [(99, 0.0, 0.0, 0.0, 0.0), (98, -20.0, -20.0, 20.0, 20.0)]
    tiles = spark.createDataFrame(a, "id int, xmin double, ymin double, xmax double, ymax double")
    codes = spark.createDataFrame([(i, -i, *r) for i, *r in b], "col int, row int, xmin double, ymin double, xmax double, ymax double")
    want = {(i, j) for i, *p in a for j, *q in b if p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]}
    for strategy in ("inverted", "forward"):
        for bucket in (1.5, 4.0, 100.0):
            rows = match.visible_tiles(tiles, codes, bucket, strategy).collect()
            assert len(rows) == len(want) and {(r.id, r.col) for r in rows} == want
    assert match.visible_tiles(tiles.limit(0), codes, 4.0).count() == 0


@pytest.mark.parametrize("strategy", ["forward", "inverted"])
def test_rows_of_equal_extents_are_joined_once(spark, monkeypatch, strategy):
    """Also where an id has several extents, one of them twice, or none."""
    a = [(i, 0.0, 0.0, 1.0, 1.0) for i in range(1200)] + [(7, 0.0, 0.0, 1.0, 1.0), (7, 5.0, 5.0, 6.0, 6.0), (7, None, 5.0, 6.0, 6.0), (1300, None, 0.0, 1.0, 1.0), (1301, 9.0, 9.0, 9.0, 9.0)]
    b = [(j, -j, 1.0, 0.5, 5.0, 5.0) for j in range(15)] + [(20, 1, 6.0, 6.0, 7.0, 7.0), (20, 1, 0.0, 0.0, 0.5, 0.5), (21, 1, 70.0, 0.0, 70.5, 0.5)]
    tiles = spark.createDataFrame(a, "id int, xmin double, ymin double, xmax double, ymax double")
    codes = spark.createDataFrame(b, "col int, row int, xmin double, ymin double, xmax double, ymax double")
    want = Counter((i, j, k) for i, *p in a for j, k, *q in b if None not in p and p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3])
    joined, plain = [], match.extent_join
    monkeypatch.setattr(match, "extent_join", lambda *x: joined.append(plain(*x)) or joined[-1])
    assert Counter(map(tuple, match.visible_tiles(tiles, codes, 4.0, strategy).collect())) == want
    assert sum(j.count() for j in joined) <= 10


def test_a_task_returns_few_items_or_one_list(spark, monkeypatch):
    """Lists of many keys apart, so that a writer sees the size of its rows; long ones dealt to few keys at a time."""
    monkeypatch.setattr(match, "TASK_ITEMS", 2000, raising=False)
    monkeypatch.setattr(match, "LONG_LIST", 150, raising=False)
    wide = {g: 100 for g in range(8)} | {8: 300, 9: 2, 10: 2, 11: 3}
    a = [(g * 1000 + i, 9.0 * g, 0.0, 9.0 * g + 1, 1.0) for g, n in wide.items() for i in range(n)]
    b = [(g, i, 9.0 * g, 0.5, 9.0 * g + 2, 1.0) for g in wide for i in range(60)] + [(99, 0, 0.0, 7.0, 0.0, 7.0)]
    tiles = spark.createDataFrame(a, "id int, xmin double, ymin double, xmax double, ymax double")
    codes = spark.createDataFrame(b, "col int, row int, xmin double, ymin double, xmax double, ymax double")
    rows = match.match_forward(tiles, codes, 4.0).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.col, r.row, *r.tiles) for r in rows) == [(g, i, *range(g * 1000, g * 1000 + n)) for g, n in wide.items() for i in range(60)]
    tasks = {t: [r for r in rows if r.task == t] for t in {r.task for r in rows}}
    for own in tasks.values():
        assert len({r.col for r in own}) == 1 or sum(len(r.tiles) for r in own) <= 4000
    assert len({r.task for r in rows if r.col == 8}) > 2 and all(len({r.task for r in rows if r.col == g}) == 1 for g in range(8))


def test_scalars(spark):
    one = spark.range(1)
    forms = ["2015-10-02 03:04:05", "2015/10/02 03:04:05", "2015-10-02", "2015/10/02", "gestern", None]
    rows = spark.createDataFrame([(f,) for f in forms], "t string").select(scalar.parse_time(F.col("t"))).collect()
    full, day = datetime.datetime(2015, 10, 2, 3, 4, 5), datetime.datetime(2015, 10, 2)
    assert [r[0] for r in rows] == [full, full, day, day, None, None]
    assert one.select(scalar.little_endian(F.unhex(F.lit("00D20296")), 2, 2)).first()[0] == 0x02D2
    key = one.select(*grid.parse_tile_key(F.lit("l/11/png/3-x"))).first()
    assert (key.zoom, key.col, key.row) == (11, 3, None)
    x, y = projection.system(32649).forward(F.lit(111.5), F.lit(30.0))
    at = one.select(x.alias("x"), y.alias("y")).first()
    # a degree and a half of longitude at latitude 30 is about 48.2 km off the central meridian of 111 degrees
    assert at.x == pytest.approx(500000 + 48243, abs=60) and at.y == pytest.approx(3318785 + 105, abs=400)
    assert one.select(match.overview_level(F.lit(76.437028), F.lit(30.0), F.lit(6))).first()[0] == 2


def test_store(spark, tmp_path):
    cells = [float(i) for i in range(16)]
    tiles = spark.createDataFrame([(3, 5, cells), (4, 5, [None] * 16)], "col int, row int, cells array<double>")
    assert store.write_images(tiles, "job", 9, str(tmp_path)) == 2
    got = store.load_images(spark, str(tmp_path), "job", 9)
    assert {(r.col, r.row) for r in got.collect()} == {(3, 5), (4, 5)} and all(r.image[:4] == b"\x89PNG" for r in got.collect())
    assert [tuple(r)[:2] for r in store.load_wanted(got, tiles, tiles.where("col = 3")).collect()] == [(4, 5)]
    with pytest.raises(ValueError):
        store.write_images(tiles, "job", 9, str(tmp_path), "bmp")
    image = store.png(np.array(cells), ramp=False)
    data = zlib.decompress(image[image.index(b"IDAT") + 4 : image.index(b"IEND") - 8])
    assert [data[i * 5 + 1] for i in range(4)] == [0, 68, 136, 204]
    px = spark.createDataFrame([(1, y, x, y * 8 + x) for y in range(8) for x in range(8)], "band int, y int, x int, v int")
    for _ in range(2):
        store.write_layer(px, "a", 2, str(tmp_path / "layers"), 4)
    back = spark.read.parquet(str(tmp_path / "layers"))
    assert back.groupBy("zoom").count().orderBy("zoom").collect() == [(0, 4), (1, 16), (2, 64)]
    (tmp_path / "s.yml").write_text("env: cluster\nstore: /x\nspark.a: b\n")
    s = store.Settings.load(str(tmp_path / "s.yml"))
    assert (s.env, s.store, s.options) == ("cluster", "/x", {"spark.a": "b"})
    assert store.notify("http://127.0.0.1:9/none", b"", retries=1) == ""


def test_stream(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    kind = "layer_id string, zoom int, col int, row int"

    def compute(df):
        seen.append(sorted((r.col, r.row) for r in df.collect()))
        return df

    for batch in ([(1, 1), (1, 2), (1, 1)], [(1, 2), (2, 2)]):
        spark.createDataFrame([("a", 3, *t) for t in batch], kind).write.mode("append").json(folder)
        incremental(spark.readStream.schema(kind).json(folder), compute, str(tmp_path / "store"), str(tmp_path / "at")).awaitTermination(60)
    assert seen == [[(1, 1), (1, 2)], [(2, 2)]]
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3


def test_reads_by_uri_and_from_whole_files(spark, tmp_path):
    """The same cells from a path, a file: URI, and files that Spark reads; rows dealt by file, islands bounded."""
    rng = np.random.default_rng(3)
    for name in ("a", "b"):
        write_cog(str(tmp_path / f"{name}.tif"), [rng.integers(0, 60000, (300, 300)).astype("<u2")], (0.0, 10.0), 0.5, tile=64, deflate=name == "b")
    (tmp_path / "note.txt").write_text("no image")
    index = cog.cog_index(spark, str(tmp_path))
    by_uri = cog.cog_index(spark, f"file://{tmp_path}")
    whole = files.contents(spark, str(tmp_path))
    by_spark = cog.cog_index_of(whole)
    plain = lambda df: sorted((r.path.split("/")[-1], r.row, r.col, r.offset, r.byte_count) for r in df.collect())
    assert plain(index) == plain(by_uri) == plain(by_spark) and len(plain(index)) == 50
    cells = lambda df: sorted((r.path.split("/")[-1], r.row, r.col, tuple(r.cells)) for r in df.collect())
    want = cells(cog.read_tiles(index, "uint16"))
    assert want == cells(cog.read_tiles(by_uri, "uint16", gap=0, most=20_000)) == cells(cog.read_tiles(by_spark, "uint16", files=whole))
    assert cog.read_tiles(index.limit(0), "uint16").count() == 0
    assert {r.path.split("/")[-1] for r in files.listed(spark, str(tmp_path)).collect()} == {"a.tif", "b.tif"}


def test_islands():
    rows = [("f", 100, 10), ("f", 0, 50), ("g", 50, 10), ("f", 55, 40), ("f", 1000, 5000), ("f", 900, 10)]
    assert list(cog.islands(rows, 5, 1000)) == [(0, 110, [1, 3, 0]), (900, 910, [5]), (1000, 6000, [4]), (50, 60, [2])]
    assert list(cog.islands(rows[:4], 5, 60)) == [(0, 50, [1]), (55, 110, [3, 0]), (50, 60, [2])] and list(cog.islands([], 1, 1)) == []


def test_geometry_forms(spark):
    import struct

    ring = [(1.0, 2.0), (3.0, 2.0), (3.0, 5.5), (1.0, 2.0)]
    polygon = lambda o: struct.pack(f"{o}BIII" if o == "<" else ">BIII", 1 if o == "<" else 0, 3, 1, 4) + b"".join(struct.pack(f"{o}2d", *p) for p in ring)
    many = struct.pack("<BII", 1, 6, 2) + polygon("<") + polygon(">")
    point = struct.pack("<BII2d", 1, 1 | 0x20000000, 4326, -7.0, 8.0)
    forms = ["POLYGON ((1 2, 3 2, 3 5.5, 1 2))", polygon("<").hex(), polygon(">").hex(), many.hex(), point.hex(), None]
    rows = spark.createDataFrame([(f,) for f in forms], "g string").select(scalar.envelope(F.col("g")).alias("e")).collect()
    assert [tuple(r.e) for r in rows[:4]] == [(1.0, 2.0, 3.0, 5.5)] * 4 and tuple(rows[4].e) == (-7.0, 8.0, -7.0, 8.0)
    assert rows[5].e is None or rows[5].e.xmin is None
    assert len({r[0] for r in spark.range(5).select(scalar.new_id()).collect()}) == 5


def test_catalog_is_asked_once(spark):
    image = spark.createDataFrame([(1, "im", "EPSG:4326", "/d", "POINT (1 2)", "2015/10/02")], "product_key int, image_identification string, crs string, path string, geom string, phenomenon_time string")
    product = spark.createDataFrame([(1, "LC", "uint16")], "id int, name string, dtype string")
    bands = spark.createDataFrame([(1, 7, "B1", 1, 1, 30.0), (1, 8, "B2", 2, 1, 30.0)], "product_key int, measurement_key int, band_num string, band_rank int, band_train int, resolution_m double")
    known = catalog.Catalog(image, product, bands, spark.createDataFrame([(7,), (8,)], "measurement_key int"))
    assert known.bands("im", "LC", ["B2"]).count() == 1 and known.bands("im", "LC").count() == 2
    assert known.known.keys() == {("im", "LC")}
    with pytest.raises(ValueError):
        known.bands("im", "other")
    with pytest.raises(RuntimeError):
        catalog.jdbc(spark, "jdbc:none://x", "t", retries=2, delay=0.01)


def test_coloured_images_and_callback(spark, tmp_path):
    import http.server
    import threading

    got = []

    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            got.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode()))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"ok")

        def log_message(self, *_):
            pass

    stack = [[float(i) for i in range(4)], [3.0, 2.0, 1.0, 0.0], [1.0, 1.0, None, 1.0]]
    tiles = spark.createDataFrame([(3, 5, [1, 2, 3], stack), (4, 5, [1, 2, 3], stack)], "col int, row int, bands array<int>, stack array<array<double>>")
    assert store.write_images(tiles, "job", 9, f"file://{tmp_path}") == 2
    image = store.load_images(spark, str(tmp_path), "job", 9, wanted=tiles.where("col = 4")).collect()
    assert [(r.col, r.row) for r in image] == [(4, 5)]
    data = zlib.decompress(image[0].image[image[0].image.index(b"IDAT") + 4 : image[0].image.index(b"IEND") - 8])
    assert list(data[1:9]) == [0, 255, 0, 255, 85, 170, 0, 255]
    server = http.server.HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.handle_request, daemon=True).start()
    done = store.job_finished(f"http://127.0.0.1:{server.server_port}", "job", 9, "png", tiles)
    assert done.result(10) == "ok" and got == [("/job/finished/job/9/png", "3-5,4-5")]
    assert store.post_async("http://127.0.0.1:9/none", b"").result(10) == ""


def names_of(folder):
    return sorted(p.name for p in folder.rglob("*"))


@pytest.mark.parametrize("kind", ["png", "jpg"])
def test_images_appear_when_all_are_done(spark, tmp_path, kind):
    """A failing task leaves nothing; a rerun gives the same files; append keeps others, overwrite does not."""
    folder = tmp_path / "job" / "9" / kind
    cells = [float(i) for i in range(64)]
    tiles = spark.createDataFrame([(b, c, 5, cells[::-1] if b > 1 else cells) for b in (1, 2) for c in range(20)], "band int, col int, row int, cells array<double>").repartition(4)
    assert store.write_images(tiles, "job", 9, str(tmp_path), kind) == 20
    first = {p.name: p.read_bytes() for p in folder.iterdir()}
    assert sorted(first) == sorted(f"{c}-5.{kind}" for c in range(20)) and names_of(folder) == sorted(first)

    # a task that fails after others have written their files
    @F.udf("array<double>")
    def broken(col, cells):
        if col == 123:
            time.sleep(1)
            raise RuntimeError("broken")
        return cells

    more = tiles.withColumn("col", F.col("col") + 104).withColumn("cells", broken("col", "cells"))
    with pytest.raises(Exception):
        store.write_images(more, "job", 9, str(tmp_path), kind)
    with pytest.raises(Exception):
        store.write_images(tiles.where("band = 1").withColumn("col", F.col("col") % 7 + 300), "job", 9, str(tmp_path), kind)
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == first
    assert store.write_images(tiles, "job", 9, str(tmp_path), kind) == 20 and {p.name: p.read_bytes() for p in folder.iterdir()} == first
    assert store.write_images(tiles.withColumn("col", F.col("col") + 50), "job", 9, str(tmp_path), kind) == 20 and len(names_of(folder)) == 40
    assert store.write_images(tiles.where("col < 3"), "job", 9, str(tmp_path), kind, mode="overwrite") == 3
    assert {p.name: p.read_bytes() for p in folder.iterdir()} == {n: d for n, d in first.items() if n in (f"0-5.{kind}", f"1-5.{kind}", f"2-5.{kind}")}
    assert store.write_images(tiles.limit(0), "job", 9, str(tmp_path), kind) == 0
    got = store.load_images(spark, str(tmp_path), "job", 9, kind).collect()
    assert {(r.col, bytes(r.image[:2])) for r in got} == {(c, b"\x89P" if kind == "png" else b"\xff\xd8") for c in range(3)}


def test_images_in_a_file_system_by_uri(spark, tmp_path, monkeypatch):
    """The way of object stores, through pyarrow's file system."""
    from pyarrow import fs

    from rasterloom.sources import sink

    monkeypatch.setattr(sink, "local_path", lambda path: None)
    monkeypatch.setattr(sink, "file_system", lambda path, options=None: (fs.LocalFileSystem(), path))
    folder = str(tmp_path / "a")
    old = sink.ImageWriter({"path": folder, "kind": "png"}, False)
    old.commit([old.write(iter([{"col": 1, "row": 2, "image": b"x"}, {"col": 3, "row": 2, "image": b"y"}])), None])
    assert names_of(tmp_path / "a") == ["1-2.png", "3-2.png"]
    failed = sink.ImageWriter({"path": folder}, False)
    failed.write(iter([{"col": 9, "row": 9, "image": b"z"}]))
    failed.abort([None])
    new = sink.ImageWriter({"path": folder}, True)
    new.commit([new.write(iter([{"col": 1, "row": 2, "image": b"new"}]))])
    assert names_of(tmp_path / "a") == ["1-2.png"] and (tmp_path / "a/1-2.png").read_bytes() == b"new"


def test_images_computed_if_absent(spark, tmp_path):
    asked = []

    def compute(lacking):
        asked.append(sorted((r.col, r.row) for r in lacking.collect()))
        return lacking.select("col", "row", F.array(*[F.col("col").cast("double")] * 4).alias("cells"))

    want = lambda *cols: spark.createDataFrame([(c, 1) for c in cols], "col int, row int")
    get = lambda *cols: {r.col for r in store.ensure_images(spark, str(tmp_path), "a", 3, want(*cols), compute).collect()}
    assert get(1, 2) == {1, 2} and get(2, 3, 3) == {2, 3} and get(1, 3) == {1, 3}
    assert asked == [[(1, 1), (2, 1)], [(3, 1)]]


def test_extent_of_too_many_buckets(spark):
    one = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0)], "xmin double, ymin double, xmax double, ymax double")
    with pytest.raises(Exception, match="choose larger"):
        match.extent_join(one, one, 1e-6).collect()
    assert match.extent_join(one, one, 10.0).count() == 1
