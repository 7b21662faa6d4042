"""Cloud-optimized GeoTIFF: a PySpark data source of tile indexes, byte-range reads and decoding.

`spark.read.format("cog_index").load(path)` gives one row for each internal tile and sample: path, level, row, col, offset,
byte_count, and what decoding and placing need. Read are the header, the directories and, of the arrays of offsets, the parts
that filters on level, row and col ask for. Files lie on a local or mounted path or in an object store (`files`); `index_of_paths`
reads the indexes of files that a table names, without listing any.
Files are tiled: classic TIFF or BigTIFF, of either byte order, uncompressed, deflated or LZW, without predictor or with the
horizontal (2) or floating-point one (3), of one or several samples, interleaved or in planes. Others are refused by name.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from rasterloom.functions.scalar import DTYPES
from rasterloom.sources.files import Ranges, file_system, local_path

INDEX = (
    "path string, level int, row int, col int, offset long, byte_count long, width int, height int, tile int, "
    "bits int, format int, compression int, x_min double, y_max double, cell_w double, cell_h double, "
    "predictor int, sample int, samples int, planar int, big boolean"
)
KINDS = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k]) for n, k in (x.split() for x in INDEX.split(", "))])
#: TIFF tags, and bytes and struct code of its field types.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 277: "samples", 284: "planar", 317: "predictor", 322: "tile_w", 323: "tile_h", 324: "offsets", 325: "counts", 339: "format", 33550: "scale", 33922: "tie"}
FIELDS = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
#: Compressions by their number in a file.
NONE, LZW, DEFLATE = 1, 5, (8, 32946)
#: Columns that filters are pushed for, and what they are limited to if nothing is asked.
PUSHED = ("level", "row", "col")


class Field:
    """The values of a tag, read when asked for, and of long ones only the part that is asked for."""

    def __init__(self, read: Callable[[int, int], bytes], order: str, kind: int, count: int, inline: bytes, at: int):
        self.read, self.order, (self.size, self.code), self.count, self.inline, self.at = read, order, FIELDS[kind], count, inline, at

    def part(self, lo: int, hi: int) -> tuple:
        n, size = hi - lo, self.size
        data = self.inline[lo * size : hi * size] if size * self.count <= len(self.inline) else self.read(self.at + lo * size, n * size)
        return struct.unpack(f"{self.order}{n * len(self.code)}{self.code[0]}", data)

    def __iter__(self) -> Iterator:
        return iter(self.part(0, self.count))


def directories(read: Callable[[int, int], bytes]) -> Iterator[dict[str, Field]]:
    """Tags of each image directory. read(offset, size) gives bytes of the file."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack(f"{order}H", head[2:4])[0] if order and len(head) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF")
    # places, the number of entries, and values within an entry are of four bytes, in the big form of eight
    word, many, entry, room = ("I", "H", 12, 4) if version == 42 else ("Q", "Q", 20, 8)
    at = struct.unpack_from(f"{order}{word}", head, 4 if version == 42 else 8)[0]
    while at:
        (count,) = struct.unpack(f"{order}{many}", read(at, struct.calcsize(many)))
        body, out = read(at + struct.calcsize(many), entry * count + room), {}
        for i in range(count):
            tag, kind, n = struct.unpack_from(f"{order}HH{word}", body, entry * i)
            if tag in TAGS and kind in FIELDS:
                inline = body[entry * (i + 1) - room : entry * (i + 1)]
                out[TAGS[tag]] = Field(read, order, kind, n, inline, struct.unpack(f"{order}{word}", inline)[0])
        yield out
        (at,) = struct.unpack_from(f"{order}{word}", body, entry * count)


class Wanted:
    """What filters leave of level, row and col: a range each, and a set of values where one was given."""

    def __init__(self):
        self.low, self.high, self.some = {}, {}, {}

    def take(self, f: Filter) -> bool:
        """Adds a filter; whether it is one of those that are applied here in full."""
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in PUSHED:
            return False
        c = f.attribute[0]
        if isinstance(f, EqualTo):
            self.at_least(c, f.value), self.at_most(c, f.value)
        elif isinstance(f, In):
            values = {v for v in f.value if v is not None}
            self.some[c] = self.some.get(c, values) & values
            self.at_least(c, min(values, default=1)), self.at_most(c, max(values, default=0))
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.at_least(c, f.value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.at_most(c, f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def at_least(self, c: str, v: int) -> None:
        self.low[c] = max(self.low.get(c, 0), v)

    def at_most(self, c: str, v: int) -> None:
        self.high[c] = min(self.high.get(c, v), v)

    def span(self, c: str, count: int) -> tuple[int, int]:
        """First and last (exclusive) of count values."""
        return max(0, self.low.get(c, 0)), min(count, self.high.get(c, count) + 1)

    def among(self, c: str, values: np.ndarray) -> np.ndarray:
        return np.isin(values, list(self.some[c])) if c in self.some else np.ones(len(values), bool)


def index_of(path: str, read: Callable[[int, int], bytes], wanted: Wanted | None = None) -> Iterator[pa.RecordBatch]:
    """The index of a file that read(offset, size) gives bytes of, a batch for each level."""
    wanted, first = wanted or Wanted(), None
    for level, d in enumerate(directories(read)):
        one = lambda n, default=None, d=d: next(iter(d[n])) if n in d else default
        kind, predictor, planar = one("compression", NONE), one("predictor", 1), one("planar", 1)
        if "offsets" not in d or kind not in (NONE, LZW, *DEFLATE) or predictor not in (1, 2, 3) or planar not in (1, 2) or one("tile_w") != one("tile_h"):
            raise ValueError(f"{path}: only files of square tiles, uncompressed, deflated or LZW, with predictor 1, 2 or 3")
        first = first or {n: tuple(d[n]) for n in ("scale", "tie")}
        lo, hi = wanted.span("level", level + 1)
        if not (lo <= level < hi) or not wanted.among("level", np.array([level])).all():
            continue
        tile, width, height, samples = one("tile_w"), one("width"), one("height"), one("samples", 1)
        across, down = -(-width // tile), -(-height // tile)
        (r0, r1), (c0, c1) = wanted.span("row", down), wanted.span("col", across)
        if r0 >= r1 or c0 >= c1:
            continue
        rows, cols = (v.ravel() for v in np.mgrid[r0:r1, c0:c1])
        keep = wanted.among("row", rows) & wanted.among("col", cols)
        rows, cols = rows[keep], cols[keep]
        plane = across * down if planar == 2 else 0
        for sample in range(samples):
            # of each array one stretch, from the first wanted tile to the last
            base = sample * plane + r0 * across + c0
            stretch = [np.array(d[n].part(base, sample * plane + (r1 - 1) * across + c1), np.int64) for n in ("offsets", "counts")]
            at = sample * plane + rows * across + cols - base
            same = lambda v: np.full(len(rows), v)
            bits, form = (tuple(d[n])[0] if n in d else v for n, v in (("bits", 8), ("format", 1)))
            values = [
                np.repeat(path, len(rows)), same(level), rows, cols, stretch[0][at], stretch[1][at], same(width), same(height), same(tile), same(bits), same(form), same(kind),
                same(first["tie"][3]), same(first["tie"][4]), same(first["scale"][0]), same(first["scale"][1]), same(predictor), same(sample), same(samples), same(planar), same(d["width"].order == ">"),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, KINDS.types)], schema=KINDS)


def index_rows(path: str, options: dict | None = None, wanted: Wanted | None = None) -> Iterator[pa.RecordBatch]:
    """The index of a file, read by ranges where it lies."""
    with Ranges(path, options) as read:
        yield from index_of(path, read, wanted)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class CogReader(DataSourceReader):
    def __init__(self, options: dict):
        path, self.wanted = options["path"], Wanted()
        #: Partitions at most: more files than these share them.
        self.most = int(options.get("partitions", 1024))
        self.options = {k.lower(): v for k, v in options.items() if k not in ("path", "partitions")}
        if (local := local_path(path)) is not None:
            self.paths = sorted(glob.glob(os.path.join(local, "*.tif"))) if os.path.isdir(local) else sorted(glob.glob(local))
        else:
            from pyarrow import fs

            system, place = file_system(path, self.options)
            info = system.get_file_info(place)
            found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=False))
            root = path[: len(path) - len(place)] if path.endswith(place) else f"{path.split('://')[0]}://"
            self.paths = sorted(root + f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".tif"))

    def partitions(self):
        n = min(len(self.paths), self.most)
        return [Files(self.paths[i::n]) for i in range(n)] or [Files([])]

    def read(self, partition: Files):
        for path in partition.paths:
            yield from index_rows(path, self.options, self.wanted)


class PushedReader(CogReader):
    def pushFilters(self, filters: list[Filter]):
        """Comparisons and lists of level, row and col are applied while reading; the rest is Spark's."""
        for f in filters:
            if not self.wanted.take(f):
                yield f


class CogIndex(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cog_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema) -> DataSourceReader:
        options = dict(self.options)
        return (PushedReader if options.pop("pushdown", "") == "true" else CogReader)(options)


def cog_index(spark: SparkSession, path: str, **options) -> DataFrame:
    """The index of a file, a folder or a pattern; a local path or a URI, with the options of its store. partitions: tasks at most.

    Filters are pushed into the source where spark.sql.python.filterPushdown.enabled is set, else applied by Spark.
    """
    spark.dataSource.register(CogIndex)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("cog_index").options(pushdown=pushed, **options).load(path)


def index_of_paths(files: DataFrame, options: dict | None = None) -> DataFrame:
    """The index of the files that a table's column path names, each once; nothing is listed."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                yield from index_rows(path, options)

    return files.select("path").where("path IS NOT NULL").distinct().mapInArrow(run, INDEX)


def cog_index_of(files: DataFrame) -> DataFrame:
    """The index of whole files (path, content), for stores that only Spark reads."""

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                view = memoryview(data.as_buffer())
                yield from index_of(path, lambda offset, size, view=view: bytes(view[offset : offset + size]))

    return files.select("path", "content").mapInArrow(run, INDEX)


def unlzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, highest bit first, widened one code early; 256 clears, 257 ends."""
    out, table, before = [], [], b""
    hold = bits = 0
    width = 9
    for byte in data:
        hold, bits = (hold << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, hold = hold >> bits, hold & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, before, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not before:
            text = table[code]
        else:
            text = table[code] if code < len(table) else before + before[:1]
            table.append(before + text[:1])
        out.append(text)
        before = text
        size = len(table) + 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    return b"".join(out)


def unpredict(data: bytes, predictor: int, code: str, tile: int, samples: int) -> bytes:
    """Undoes a predictor over the lines of a tile of interleaved samples."""
    kind = np.dtype(code)
    if predictor == 2:
        whole = np.dtype(f"{kind.byteorder if kind.itemsize > 1 else '|'}u{kind.itemsize}")
        lines = np.frombuffer(data, whole).reshape(-1, tile, samples)
        return np.cumsum(lines, axis=1, dtype=whole.newbyteorder("=")).astype(whole).tobytes()
    # differences of bytes, each line's highest bytes first
    lines = np.frombuffer(data, np.uint8).reshape(-1, tile * kind.itemsize, samples)
    planes = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(-1, kind.itemsize, tile * samples)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{kind.itemsize}").astype(kind).tobytes()


def decode(data: bytes, dtype: str, cells: int, deflated: bool = False) -> np.ndarray:
    """Cells of a plain tile; short data are filled up with 0."""
    size, code, _ = DTYPES[dtype]
    data = zlib.decompress(data) if deflated else bytes(data)
    return np.frombuffer(data.ljust(size * cells, b"\0")[: size * cells], code)


def tile_cells(own: dict, data: bytes, dtype: str) -> np.ndarray:
    """The cells of one sample of a tile, from its bytes and its index row (missing columns: one plain sample)."""
    size, code, _ = DTYPES[dtype]
    if own.get("big"):
        code = code.replace("<", ">")
    kind, tile = own["compression"], own["tile"]
    samples = own.get("samples") or 1
    inside = samples if own.get("planar") != 2 else 1
    data = zlib.decompress(data) if kind in DEFLATE else unlzw(bytes(data)) if kind == LZW else bytes(data)
    data = data.ljust(size * tile * tile * inside, b"\0")[: size * tile * tile * inside]
    if (own.get("predictor") or 1) > 1:
        data = unpredict(data, own["predictor"], code, tile, inside)
    cells = np.frombuffer(data, code)
    return cells.reshape(-1, inside)[:, own["sample"]] if inside > 1 else cells


def cell_form(dtype: str) -> tuple[str, pa.DataType]:
    """Spark and Arrow type of the cells of a file's type."""
    kind = np.dtype(DTYPES[dtype][1]).kind
    return ("double", pa.float64()) if kind == "f" else ("int", pa.int32())


class Opened:
    """Byte ranges of files, of which the last one stays open."""

    def __init__(self, options: dict | None = None):
        self.options, self.path, self.file = options, None, None

    def __call__(self, path: str, start: int, size: int) -> bytes:
        if path != self.path:
            self.close()
            self.path, self.file = path, Ranges(path, self.options)
        return self.file.read(start, size)

    def close(self) -> None:
        if self.file:
            self.file.file.close()
        self.path = self.file = None


def islands(rows: list[tuple], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """(start, end, rows) of joined reads of (path, offset, byte_count): of one file, at most `gap` bytes apart and `most`
    bytes in all, unless one tile alone has more."""
    order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
    own: list[int] = []
    start = end = 0
    for i in order:
        path, offset, size = rows[i]
        if own and (path != rows[own[0]][0] or offset > end + gap or max(end, offset + size) - start > most):
            yield start, end, own
            own = []
        if not own:
            start, end = offset, offset
        own.append(i)
        end = max(end, offset + size)
    if own:
        yield start, end, own


def read_tiles(index: DataFrame, dtype: str, gap: int = 65536, most: int = 16 << 20, options: dict | None = None, files: DataFrame | None = None) -> DataFrame:
    """index rows with their cells (an array of the type's Spark form).

    Rows are dealt by file and stretches of 64 MB of it, and read in order, near ones at once: up to `most` bytes. files:
    whole files (path, content) to read from instead, for stores that only Spark reads; each is in memory once.
    """
    kind, form = cell_form(dtype)
    arrow = pa.list_(form)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields) + f", cells array<{kind}>"
    names = index.columns
    needs = [c for c in ("path", "offset", "byte_count", "tile", "compression", "predictor", "sample", "samples", "planar", "big") if c in names]

    def cells(batch, fetch):
        """The batch with its cells. fetch(path, start, size) gives bytes."""
        col = {n: batch.column(n).to_pylist() for n in needs}
        rows, out = list(zip(col["path"], col["offset"], col["byte_count"])), [None] * batch.num_rows
        for start, end, own in islands(rows, gap, most):
            data = memoryview(fetch(rows[own[0]][0], start, end - start))
            for i in own:
                _, offset, size = rows[i]
                out[i] = tile_cells({n: v[i] for n, v in col.items()}, data[offset - start : offset - start + size], dtype).astype(form.to_pandas_dtype())
        return [*(batch.column(n) for n in names), pa.array(out, arrow)]

    if files is not None:

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.combine_chunks()
            data = memoryview(right.column("content")[0].as_buffer()) if right.num_rows else memoryview(b"")
            return pa.table(cells(left, lambda path, start, size: data[start : start + size]), [*names, "cells"])

        return index.groupBy("path").cogroup(files.select("path", "content").groupBy("path")).applyInArrow(both, schema)

    def run(batches):
        fetch = Opened(options)
        for b in batches:
            # few tiles at a time, as their cells come on top
            for lo in range(0, b.num_rows, 64):
                yield pa.RecordBatch.from_arrays(cells(b.slice(lo, 64), fetch), [*names, "cells"])
        fetch.close()

    dealt = index.repartition("path", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, schema)


def cells_by_dtype(data, dtype: str):
    """Column of raw tile bytes as arrays of cells."""

    @F.pandas_udf("array<double>")
    def run(s):
        return s.map(lambda b: None if b is None else decode(b, dtype, len(b) // DTYPES[dtype][0]).astype(float))

    return run(data)
