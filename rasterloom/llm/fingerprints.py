"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash (48 bits) below one fixed fraction, 1 / `scale`, of the range, whatever the text, so its
size follows the text's, the union of two sketches is the sketch of both texts' shingles, and the share of one sketch found
in another estimates how much of one text the other contains, however unequal they are. With m hashes kept of two texts'
shingles together the resemblance's error is about sqrt(J (1 - J) / m). A text none of whose hashes is below the fraction
keeps its smallest one, so that only texts without words have nothing; sketches merge as before, as the smallest hash of two
texts together is the smaller of theirs.

Edge cases: a null text counts as empty; an empty or blank text has the empty fingerprint "2:" (the scale and a colon); two
empty fingerprints are alike (1), an empty and another one are not (0). Rows that share a doc_id are ordered by a hash of the text, then by text; a null
doc_id comes after all others. Other columns are ignored by `edited_pairs` except those named in it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm import kernel as K


BITS = 48


class Sketcher:
    """Sketches of texts: `scale` is the inverse of the fraction kept, `width` the words of a shingle."""

    def __init__(self, scale: int = 2, width: int = 5):
        self.scale, self.width = scale, width
        self.limit = np.uint64((1 << BITS) // scale)

    def sketch(self, texts: pa.Array) -> list[np.ndarray]:
        """The sorted distinct hashes kept of each text: those below the limit, and the smallest."""
        out = []
        for lo, hi, raw, at in K.text_chunks(texts):
            start, end, first = K.word_bounds(raw, at)
            h, rows = K.shingles(K.word_hashes(raw, start, end), first, self.width)
            h = h >> np.uint64(64 - BITS)
            least = np.full(hi - lo, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(least, rows, h)
            # the smallest is below the limit where any is, so it matters for the others only
            keep = (h < self.limit) | (h == least[rows])
            h, first = K.distinct_sorted(h[keep], rows[keep], hi - lo)
            out += [h[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        return out

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The sketch of the union of two texts' shingles."""
        both = np.union1d(a, b)
        return both[: max(1, int(np.searchsorted(both, self.limit)))]

    @staticmethod
    def compare(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
        """Estimates: resemblance (Jaccard), share of x contained in y, share of y contained in x."""
        if not len(x) and not len(y):
            return 1.0, 1.0, 1.0
        if not len(x) or not len(y):
            return 0.0, 0.0, 0.0
        at = np.searchsorted(y, x)
        at[at == len(y)] = 0
        common = int((y[at] == x).sum())
        return common / (len(x) + len(y) - common), common / len(x), common / len(y)

    def text(self, sketch: np.ndarray) -> str:
        """scale, colon, hashes in order as 12 hex digits each."""
        return f"{self.scale}:{np.ascontiguousarray(sketch.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes().hex()}"

    @staticmethod
    def parse(text: str) -> tuple[int, np.ndarray]:
        scale, _, digits = text.partition(":")
        part = np.frombuffer(bytes.fromhex(digits), np.uint8).reshape(-1, BITS // 8)
        return int(scale), np.pad(part, ((0, 0), (2, 0))).copy().view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, text: str = "text", id_: str = "doc_id", **how) -> DataFrame:
    """doc_id and fingerprint of every row of docs."""
    sketcher = Sketcher(**how)

    def run(batches):
        for b in batches:
            prints = [sketcher.text(s) for s in sketcher.sketch(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def with_successor(docs: DataFrame, size: int = 16 << 20) -> DataFrame:
    """Rows (doc_id, text, own), sorted in each partition so that each own row's successor follows it.

    The order is that of descending doc_id, then the text's hash, then text, nulls last, in a ring. Ranges of ids, cut at
    percentiles, are dealt to partitions of about `size` bytes of text; an id with more rows than a range should have (a
    null id, say) has ranges of its own, cut by the hash. The first rows of each range are also sent, not own, behind the
    range before it. Only the range limits, such ids and the ranges' first rows' keys come to the driver: some numbers for
    each `size` bytes.
    """
    # nulls count as the smallest id of all
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total.b or 0) // size))
    parts = 4 * n
    cuts = docs.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], max(10000, 20 * parts)).alias("c")).first().c or []
    cuts = np.array(cuts, np.int64)
    # an id that fills a range is cut out of the order more than once, so few ids need counting
    often = [int(k) for k in np.unique(cuts[1:][cuts[1:] == cuts[:-1]])]
    split = {r.k: -(-r.n * parts // total.n) for r in docs.where(F.col("k").isin(often)).groupBy("k").agg(F.count("*").alias("n")).collect()} if often else {}
    heavy = np.array(sorted(split), np.int64)
    pieces = np.array([split[k] for k in heavy.tolist()], np.int64)
    # ends of ranges: ids up to each cut; a heavy id is a range alone
    ends = np.unique(np.concatenate([cuts, heavy, heavy[heavy > -(1 << 63)] - 1]))
    widths = np.ones(len(ends) + 1, np.int64)
    widths[np.searchsorted(ends, heavy, "left")] = pieces
    # range 0 holds the largest ids
    first = np.concatenate([[0], np.cumsum(widths[::-1])])[:-1][::-1]

    def place(k: np.ndarray, h: np.ndarray) -> np.ndarray:
        i = np.searchsorted(ends, k, "left")
        return first[i] + ((h.view(np.uint64) >> np.uint64(33)).astype(np.int64) * widths[i] >> 31)

    @F.pandas_udf("long")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place(k.to_numpy(), h.to_numpy()))

    # hashes in the order of unsigned numbers, as `place` has them
    unsigned = F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("h")
    keyed = docs.select("k", unsigned, range_of("k", "h").alias("r")).groupBy("r").agg(F.max(F.struct("k", (-1 - F.col("h")).alias("h"))).alias("x"))
    heads = {r.r: (r.x.k, (-1 - r.x.h) ^ -(1 << 63)) for r in keyed.collect()}
    order = sorted(heads)
    before = {heads[r]: order[i - 1] for i, r in enumerate(order)}

    @F.pandas_udf("array<long>")
    def ranges_of(k: pd.Series, h: pd.Series) -> pd.Series:
        own = place(k.to_numpy(), h.to_numpy()) * 2
        return pd.Series([[o] if (b := before.get(v)) is None else [o, b * 2 + 1] for o, v in zip(own.tolist(), zip(k.tolist(), h.tolist()))])

    return (
        docs.select("doc_id", "text", "k", unsigned, F.explode(ranges_of("k", "h")).alias("r"))
        .select("doc_id", "text", "k", "h", F.shiftright("r", 1).alias("part"), (F.col("r") % 2 == 0).alias("own"))
        .repartition(n, "part")
        .sortWithinPartitions("part", F.desc("own"), F.desc("k"), "h", "text")
        .select("part", "doc_id", F.coalesce("text", F.lit("")).alias("text"), "own")
    )


def edited_pairs(docs: DataFrame, **how) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many of the next
    document (in descending doc_id; after the last, the first).
    """
    sketcher = Sketcher(**how)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_has double, next_has double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]

    def run(batches):
        last = None  # part, doc_id, text, own, sketch of the row before
        for batch in batches:
            _, at = K.string_bytes(batch.column(2))
            for lo, hi in K.chunks(np.diff(at), 1 << 21):
                piece = batch.slice(lo, hi - lo)
                rows = list(zip(*(piece.column(i).to_pylist() for i in range(4)), sketcher.sketch(piece.column(2))))
                pairs = [(a, b) for a, b in zip([last, *rows[:-1]], rows) if a and a[3] and a[0] == b[0]]
                last = rows[-1]
                edited = []
                for a, b in pairs:
                    half = len(a[2]) // 2
                    edited.append(a[2][: len(a[2]) - half] + b[2][:half])
                out = []
                for (a, b), e, s in zip(pairs, edited, sketcher.sketch(pa.array(edited, pa.large_string()))):
                    near, there, _ = sketcher.compare(a[4], s)
                    near_next, next_there, _ = sketcher.compare(a[4], b[4])
                    out.append((a[1], len(a[2]), hashlib.sha256(e.encode()).hexdigest(), sketcher.text(a[4]), sketcher.text(s), near, near_next, there, next_there))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_successor(rows).mapInArrow(run, schema)
