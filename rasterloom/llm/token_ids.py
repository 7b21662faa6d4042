"""Token ids in files of directly addressable codes.

Ids are split into chunks of few bits, least significant first. Level 0 of a file holds the first chunk of every id; a
continuation bitmap tells which ids go on, and level 1 holds the next chunk of these alone, in order, and so on. A rank
directory (ones before each block of 512 bits) tells where in the next level an id goes on: any id, and any range of ids, is
read by a few byte ranges of each level, without decoding what lies before. Chunk widths are those that take the fewest
bits for the file's ids, found by dynamic programming over their bit lengths.

`write` deals documents to tasks by ranges of doc_id; a task tokenizes its documents in order and closes a file when it
holds `room` ids. Files are written to the shared folder under names of their own and count once the manifest names them:
those of failed or repeated tasks are named by none. The manifest has one row for each file, with the number of ids before
it. `documents` and `digests` read files back by ranges of ids, `lookup` reads single ids.

File, little-endian: magic and version, levels, ids, documents; for each level its width, entries and the places of its
chunks, bitmap and ranks; the documents' ids, their nulls, and the ids before each document.

Edge cases: a null or empty text has the one id `end`; null doc_ids come last; rows of one doc_id follow each other by a hash of
their texts; repeated rows are written once each; an empty table has no files and no rows; a text of any length is
tokenized in parts, cut at spaces where no token can cross; extra columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.llm import kernel as K
from rasterloom.llm.packing import Encoder
from rasterloom.llm.shared import as_parquet, batch_rows, new_folder, trimmed
from rasterloom.sources.files import Ranges, file_system, local_path

MAGIC, VERSION, BLOCK = b"DACI", 1, 512
HEAD, LEVEL = struct.Struct("<4sIIQQ"), struct.Struct("<IQQQQ")

#: A space between letters or digits: the byte-level pattern begins a token there, and word pieces hold none inside.
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


def parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in parts of at least size characters, cut before such spaces; a text without them is one part."""
    at = 0
    while len(text) - at > size:
        cut = CUT.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


# the codes


def widths_for(values: np.ndarray, most: int = 8) -> list[int]:
    """Chunk widths, at most so many, that take the fewest bits; the last level has no bitmap."""
    lengths = np.bincount(np.frexp(values.astype(np.float64))[1], minlength=1)
    top = max(int(np.flatnonzero(lengths)[-1]) if len(values) else 1, 1)
    # ids that have more than b bits; every id has a first chunk
    more = [len(values), *(int(lengths[b + 1 :].sum()) for b in range(1, top + 1))]
    best: dict[tuple[int, int], tuple[float, list[int]]] = {(top, k): (0.0, []) for k in range(most + 1)}
    for k in range(1, most + 1):
        for b in range(top - 1, -1, -1):
            options = []
            for c in range(b + 1, top + 1):
                if (c, k - 1) in best:
                    bitmap = more[b] * (1 + 32 / BLOCK) if c < top else 0
                    cost, rest = best[c, k - 1]
                    options.append((more[b] * (c - b) + bitmap + cost, [c - b, *rest]))
            if options:
                best[b, k] = min(options)
    return best[0, most][1]


def packed(values: np.ndarray, width: int) -> bytes:
    """The low `width` bits of each value, one after the other."""
    out = []
    for lo in range(0, len(values), 1 << 17):
        raw = values[lo : lo + (1 << 17)].astype("<u4").view(np.uint8).reshape(-1, 4)
        out.append(np.packbits(np.unpackbits(raw, axis=1, count=width, bitorder="little"), bitorder="little").tobytes())
    return b"".join(out)


def unpacked(data: bytes, width: int, skip: int, count: int) -> np.ndarray:
    """count values of `width` bits after `skip` bits."""
    out = np.zeros((count, 4), np.uint8)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[skip : skip + width * count]
    got = np.packbits(bits.reshape(count, width), axis=1, bitorder="little")
    out[:, : got.shape[1]] = got
    return out.view("<u4")[:, 0]


def coded(ids: np.ndarray, docs: list[int | None], starts: np.ndarray, widths: list[int] | None = None) -> list[bytes]:
    """The parts of a file of ids, with its documents' doc_ids and the number of ids before each of them."""
    widths = widths or widths_for(ids)
    at = HEAD.size + LEVEL.size * len(widths)
    heads, body, left = [], [], ids.astype(np.uint32)
    for k, width in enumerate(widths):
        chunks, bits, ranks = packed(left, width), b"", b""
        entries = len(left)
        if k + 1 < len(widths):
            on = left >= np.uint64(1) << np.uint64(width)
            bits = np.packbits(on, bitorder="little").tobytes()
            ones = np.add.reduceat(on, np.arange(0, entries, BLOCK), dtype=np.int64) if entries else np.zeros(0, np.int64)
            ranks = (np.cumsum(ones) - ones).astype("<u4").tobytes()
            left = (left[on] >> np.uint32(width)).astype(np.uint32)
        heads.append(LEVEL.pack(width, entries, at, at + len(chunks), at + len(chunks) + len(bits)))
        body += [chunks, bits, ranks]
        at += len(chunks) + len(bits) + len(ranks)
    named = np.array([0 if d is None else d for d in docs], "<i8").tobytes()
    nulls = np.array([d is None for d in docs], np.uint8).tobytes()
    return [HEAD.pack(MAGIC, VERSION, len(widths), len(ids), len(docs)), *heads, *body, named, nulls, starts.astype("<u8").tobytes()]


class Codes:
    """A file of directly addressable codes. read(offset, size) gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, version, levels, self.n_ids, self.n_docs = HEAD.unpack(read(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of token ids")
        data = read(HEAD.size, LEVEL.size * levels)
        #: (width, entries, place of chunks, of bitmap, of ranks)
        self.levels = [LEVEL.unpack_from(data, LEVEL.size * k) for k in range(levels)]
        width, entries, chunks, bits, ranks = self.levels[-1]
        self.directory = chunks + (entries * width + 7) // 8

    def chunks(self, level: int, lo: int, hi: int) -> np.ndarray:
        width, _, place, _, _ = self.levels[level]
        first, last = lo * width // 8, (hi * width + 7) // 8
        return unpacked(self.read(place + first, last - first), width, lo * width - 8 * first, hi - lo)

    def bits(self, level: int, lo: int, hi: int) -> np.ndarray:
        place = self.levels[level][3]
        data = np.frombuffer(self.read(place + lo // 8, (hi + 7) // 8 - lo // 8), np.uint8)
        return np.unpackbits(data, bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)

    def rank(self, level: int, i: int) -> int:
        """Ones before bit i: the directory's entry of its block and those of the block before i."""
        block = min(i, self.levels[level][1] - 1) // BLOCK
        (before,) = struct.unpack("<I", self.read(self.levels[level][4] + 4 * block, 4))
        return before + int(self.bits(level, BLOCK * block, i).sum())

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (exclusive)."""
        out, where, shift = np.zeros(hi - lo, np.uint32), None, 0
        for level, (width, *_) in enumerate(self.levels):
            if hi <= lo:
                break
            chunk = self.chunks(level, lo, hi) << np.uint32(shift)
            if where is None:
                out[:] = chunk
            else:
                out[where] |= chunk
            if level + 1 < len(self.levels):
                on = self.bits(level, lo, hi)
                where = np.flatnonzero(on) if where is None else where[on]
                lo = self.rank(level, lo)
                hi = lo + int(on.sum())
                shift += width
        return out

    def __getitem__(self, i: int) -> int:
        """One id, by one chunk, one bit and one rank of each level."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value, shift = 0, 0
        for level, (width, *_) in enumerate(self.levels):
            value |= int(self.chunks(level, i, i + 1)[0]) << shift
            if level + 1 == len(self.levels) or not self.bits(level, i, i + 1)[0]:
                break
            i = self.rank(level, i)
            shift += width
        return value

    def documents(self, lo: int = 0, hi: int | None = None) -> tuple[list[int | None], np.ndarray]:
        """doc_ids of documents lo to hi (exclusive), and the ids of the file before each of them and after the last."""
        n, hi = self.n_docs, self.n_docs if hi is None else hi
        named = np.frombuffer(self.read(self.directory + 8 * lo, 8 * (hi - lo)), "<i8")
        nulls = np.frombuffer(self.read(self.directory + 8 * n + lo, hi - lo), np.uint8)
        starts = np.frombuffer(self.read(self.directory + 9 * n + 8 * lo, 8 * (hi - lo + 1)), "<u8").astype(np.int64)
        return [None if x else d for d, x in zip(named.tolist(), nulls.tolist())], starts


# files


def put(path: str, data: list[bytes]) -> None:
    """A file at a local path or URI; its folder is made."""
    if (local := local_path(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "wb") as file:
            file.writelines(data)
    else:
        system, place = file_system(path)
        system.create_dir(place.rpartition("/")[0])
        with system.open_output_stream(place) as file:
            for x in data:
                file.write(x)


def write(docs: DataFrame, tokenizer_file: str, end: int = 0, folder: str | None = None, room: int = 16 << 20, share: int = 256 << 20) -> DataFrame:
    """Writes the ids of all texts, each followed by `end`, in ascending doc_id order. Returns the manifest: path, first (ids
    before the file), n_docs and n_ids of each file.

    room: ids after which a task closes a file, at a document's end. share: bytes of text that a task is dealt about; there
    are at least spark.sql.shuffle.partitions tasks. Rows alike in doc_id and text are dealt apart by their number in the input.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    content = spark.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder, task = Encoder(content.value), TaskContext.get().partitionId()
        named, sizes, data, held, files = [], [], [], 0, 0

        def close():
            nonlocal named, sizes, data, held, files
            ids = np.frombuffer(b"".join(data), "<u4")
            data = []
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            path = f"{folder}/{task:07d}-{files:05d}-{uuid.uuid4().hex}.ids"
            put(path, coded(ids, named, starts))
            row = [[task], [files], [path], [len(named)], [len(ids)]]
            named, sizes, held, files = [], [], 0, files + 1
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["task", "file", "path", "n_docs", "n_ids"])

        for b in batches:
            _, at = K.string_bytes(b.column(1))
            for lo, hi in K.chunks(np.diff(at), 1 << 21):
                part = b.slice(lo, hi - lo)
                for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    pieces = [*map(encoder, parts(text or "")), last]
                    size = sum(map(len, pieces)) // 4
                    data += pieces
                    named.append(id_)
                    sizes.append(size)
                    held += size
                    if held >= room:
                        yield close()
        if named:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / share))
    order = [F.asc_nulls_last("doc_id"), F.asc("_hash"), F.asc("_row")]
    dealt = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "text")
    with batch_rows(spark):
        files = as_parquet(dealt.mapInArrow(trimmed(run), "task long, file long, path string, n_docs long, n_ids long"), "token-id-files")
    # one row for each file, of `room` ids: few rows for one window
    before = F.sum("n_ids").over(Window.partitionBy().orderBy("task", "file")) - F.col("n_ids")
    return files.select("path", before.alias("first"), "n_docs", "n_ids")


def _read(files: DataFrame, rows: Callable, schema: str, block: int = 1 << 20) -> DataFrame:
    """Rows of all documents of the files, by rows(doc_ids, starts, ids) of some documents of about `block` ids at a time."""
    spark = files.sparkSession
    total = files.agg(F.sum("n_ids")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (64 << 20)))

    def run(batches):
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with Ranges(path) as read:
                    codes = Codes(read)
                    done = 0
                    while done < codes.n_docs:
                        # the directory by stretches, its documents by blocks of ids
                        named, starts = codes.documents(done, min(codes.n_docs, done + 65536))
                        done += len(named)
                        for lo, hi in K.chunks(np.diff(starts), block):
                            yield rows(named[lo:hi], starts[lo : hi + 1] - starts[lo], codes.ids(int(starts[lo]), int(starts[hi])), first + starts[lo])

    return files.select("path", "first").repartition(tasks, "path").mapInArrow(trimmed(run), schema)


def documents(files: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, read from the files."""

    def rows(named, starts, ids, first):
        lists = pa.LargeListArray.from_arrays(pa.array(starts), pa.array(ids.astype(np.int64))).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), lists], ["doc_id", "start", "n_tokens", "ids"])

    return _read(files, rows, "doc_id long, start long, n_tokens long, ids array<long>")


def digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document: see `queries.op11_token_ids`."""

    def rows(named, starts, ids, first):
        data = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), pa.array(starts[:-1] + first), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(files, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(files: DataFrame, positions: DataFrame, position: str = "position", stretch: int = 1 << 20) -> DataFrame:
    """position and id of single ids, by their place among all ids. Positions beyond the ids, and nulls, have no row.

    A position meets its file by stretches of ids, an equality join; a file's positions are dealt by stretch, however many.
    """
    span = F.sequence(F.floor(F.col("first") / stretch), F.floor((F.col("first") + F.col("n_ids") - 1) / stretch))
    there = files.select("path", "first", "n_ids", F.explode(span).alias("_stretch"))
    asked = positions.select(F.col(position).cast("long").alias("position")).withColumn("_stretch", F.floor(F.col("position") / stretch))
    met = asked.join(there, "_stretch").where((F.col("position") >= F.col("first")) & (F.col("position") < F.col("first") + F.col("n_ids")))
    dealt = met.select("path", "first", "position").repartition("path", F.floor(F.col("position") / 65536)).sortWithinPartitions("path", "position")

    def run(batches):
        path, file, codes = None, None, None
        for b in batches:
            ids = []
            for p, first, i in zip(*(c.to_pylist() for c in b.columns)):
                if p != path:
                    if file:
                        file.file.close()
                    path, file = p, Ranges(p)
                    codes = Codes(file.read)
                ids.append(codes[i - first])
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(ids, pa.int64())], ["position", "id"])
        if file:
            file.file.close()

    return dealt.mapInArrow(run, "position long, id long")
