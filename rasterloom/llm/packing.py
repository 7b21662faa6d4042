"""Packing documents into sequences: cutting stock by column generation.

Documents are tokenized and cut into pieces of the sequence length and a shorter rest; a rest of more than half a sequence
is cut once more, at the half, since large rests leave gaps that nothing fits. The rests' lengths form a histogram of at
most half as many entries as a sequence has tokens, whatever the number of documents. A linear program over patterns (multisets of
lengths that fit a sequence) minimises the number of sequences; patterns are priced by an unbounded knapsack (dynamic
programming over the sequence length) and enter by the revised simplex method until Farley's bound is within `gap`.
Uses are rounded down, then up while a whole pattern is still wanted, and what is left (fewer pieces than patterns hold,
a number that depends on the sequence length alone) is packed best-fit by falling length. Pieces, ranked within their
length by doc_id and start, take the places of the patterns in order.

Edge cases: a null or empty text has the one token `end`; repeated rows are packed once each; an empty table gives an
empty result; a text of any length is cut; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rasterloom.llm import kernel as K
from rasterloom.llm.mixing import deal, number
from rasterloom.llm.shared import trimmed

#: White space other than ASCII's: texts with it, or with special tokens, are left to the tokenizers library.
ODD_SPACE = "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


class Encoder:
    """Ids of a text as bytes (unsigned 32-bit, little-endian), by a byte-level BPE tokenizer file's content.

    tiktoken applies the file's ranks several times faster than tokenizers, with the same ids. special: whether a special
    token's string in a text is that token, else plain text.
    """

    def __init__(self, content: str, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        data = json.loads(content)
        self.whole = Tokenizer.from_str(content)
        named = {x["content"] for x in data["added_tokens"]}
        self.whole.encode_special_tokens = not special
        # byte-level alphabets write printable bytes as themselves and the others as code points from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in data["model"]["vocab"].items() if t not in named}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile("|".join([f"[{ODD_SPACE}]", *map(re.escape, named if special else ())]))
        #: Bytes of each id but special ones.
        self.bytes_of = {i: t for t, i in ranks.items()}

    def __call__(self, text: str) -> bytes:
        ids = self.whole.encode(text, add_special_tokens=False).ids if self.odd.search(text) else self.ranks.encode_ordinary(text)
        return array("I", ids).tobytes()


def pieces(docs: DataFrame, tokenizer_file: str, length: int = 1024, end: int = 0) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece. The tokenizer's file is read by the driver."""
    content = docs.sparkSession.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(content.value)
        for b in batches:
            _, at = K.string_bytes(b.column(1))
            for lo, hi in K.chunks(np.diff(at), 1 << 21):
                part, out = b.slice(lo, hi - lo), []
                for id_, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = encoder(text or "") + last
                    n = len(data) // 4
                    cuts = [*range(0, n, length), n]
                    if cuts[-1] - cuts[-2] > length // 2:
                        cuts.insert(-1, cuts[-2] + length // 2)
                    out += [(id_, s, e - s, zlib.crc32(data[4 * s : 4 * e]), n) for s, e in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), ", ".join(f"{n} long" for n in names))


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best value of a multiset of items (sizes rising) that fits room, and how often each is in it."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c], take[c] = best[c - 1], -1
        if k := upto[c]:
            v = best[c - sizes[:k]] + values[:k]
            i = int(v.argmax())
            if v[i] > best[c] + 1e-12:
                best[c], take[c] = v[i], i
    n, c = np.zeros(len(sizes)), room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            n[take[c]] += 1
            c -= sizes[take[c]]
    return float(best[room]), n


def start(sizes: np.ndarray, wanted: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A first basis and its uses: fill a sequence from the largest length left, use that pattern till a length is out.

    Each pattern has only lengths that were left, so the basis is triangular.
    """
    left, basis, uses = wanted.astype(float), np.zeros((len(sizes), len(sizes))), np.zeros(len(sizes))
    worth = sizes * (1 + 1e-3 * sizes / room)
    while (left > 0).any():
        has = np.flatnonzero(left > 0)
        i = has[-1]
        column = np.zeros(len(sizes))
        column[has] = knapsack(sizes[has], worth[has], room - int(sizes[i]))[1]
        column[i] += 1
        share = np.full(len(sizes), np.inf)
        share[column > 0] = left[column > 0] / column[column > 0]
        r = int(share.argmin())
        basis[:, r], uses[r] = column, share[r]
        left -= share[r] * column
        left[r] = 0
        left[left < 1e-9] = 0
    for r in np.flatnonzero(basis.sum(axis=0) == 0):
        basis[r, r] = room // sizes[r]
    return basis, uses


def inverse_of(basis: np.ndarray) -> np.ndarray:
    """By Gauss-Jordan elimination with the largest pivot of a column.

    Like `times`, without the threads of a linear algebra library, which stall beside a busy JVM.
    """
    n = len(basis)
    a, out = basis.astype(float), np.eye(n)
    for i in range(n):
        p = i + int(np.abs(a[i:, i]).argmax())
        if p != i:
            a[[i, p]], out[[i, p]] = a[[p, i]], out[[p, i]]
        out[i] /= a[i, i]
        a[i] /= a[i, i]
        f = a[:, i].copy()
        f[i] = 0
        rows = np.flatnonzero(f)
        a[rows] -= f[rows, None] * a[i]
        out[rows] -= f[rows, None] * out[i]
    return out


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector, optimize=False)


def solve(sizes: np.ndarray, wanted: np.ndarray, room: int, gap: float = 0.002, steps: int = 1000) -> tuple[np.ndarray, np.ndarray, float]:
    """Patterns (columns of a matrix), their uses, and a lower bound of the number of sequences.

    Stops at Farley's bound within gap, or after so many pivots; the uses fill all wanted pieces in either case.
    """
    basis, uses = start(sizes, wanted, room)
    inverse, bound = inverse_of(basis), float((sizes * wanted).sum()) / room
    for step in range(steps):
        if uses.sum() <= bound * (1 + gap):
            break
        if step % 256 == 255:
            inverse = inverse_of(basis)
            uses = np.maximum(times(inverse, wanted), 0)
        price = np.maximum(inverse.sum(axis=0), 0)
        value, column = knapsack(sizes, price, room)
        bound = max(bound, float((price * wanted).sum()) / max(value, 1.0))
        along = times(inverse, column)
        ratio = np.full(len(sizes), np.inf)
        up = along > 1e-9
        ratio[up] = uses[up] / along[up]
        r = int(ratio.argmin())
        if value <= 1 + 1e-9 or not np.isfinite(ratio[r]):
            break
        uses -= ratio[r] * along
        np.maximum(uses, 0, out=uses)
        uses[r] = ratio[r]
        row = inverse[r] / along[r]
        inverse -= np.outer(along, row)
        inverse[r] = row
        basis[:, r] = column
    return basis, uses, bound


def plan(histogram: dict[int, int], room: int, **how) -> list[tuple[dict[int, int], int]]:
    """(pattern as length -> count, uses), which hold exactly the histogram's pieces."""
    out = [({room: 1}, histogram[room])] if histogram.get(room) else []
    sizes = np.array(sorted(s for s in histogram if 0 < s < room and histogram[s]), np.int64)
    if not len(sizes):
        return out
    left = np.array([histogram[s] for s in sizes.tolist()], np.int64)
    patterns, uses, _ = solve(sizes, left.astype(float), room, **how)
    patterns = patterns.astype(np.int64)
    counts = np.floor(uses + 1e-9).astype(np.int64)
    for j in np.argsort(-(patterns * sizes[:, None]).sum(axis=0), kind="stable"):
        # numerical error must not use more pieces than there are
        has = patterns[:, j] > 0
        counts[j] = max(0, min(counts[j], int((left[has] // patterns[has, j]).min())))
        left -= patterns[:, j] * counts[j]
    for j in np.argsort(-(uses - counts), kind="stable"):
        has = patterns[:, j] > 0
        if uses[j] - counts[j] > 1e-6 and (left[has] >= patterns[has, j]).all() and (patterns[:, j] * sizes).sum() >= 0.98 * room:
            counts[j] += 1
            left -= patterns[:, j]
    out += [({int(sizes[i]): int(patterns[i, j]) for i in np.flatnonzero(patterns[:, j])}, int(counts[j])) for j in np.flatnonzero(counts)]
    return out + [(p, 1) for p in best_fit({int(s): int(n) for s, n in zip(sizes, left) if n}, room)]


def best_fit(left: dict[int, int], room: int) -> list[dict[int, int]]:
    """Best-fit by falling length: the piece goes where it leaves the least room."""
    open_, out = {}, []
    for size in sorted(left, reverse=True):
        for _ in range(left[size]):
            fit = min((r for r in open_ if r >= size and open_[r]), default=None)
            if fit is None:
                bin_, fit = {}, room
                out.append(bin_)
            else:
                bin_ = open_[fit].pop()
            bin_[size] = bin_.get(size, 0) + 1
            open_.setdefault(fit - size, []).append(bin_)
    return out


def places(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, count in a sequence, first sequence, offset): where ranked pieces go."""
    out, rank, sequence = [], {}, 0
    for pattern, uses in patterns:
        offset = 0
        for size in sorted(pattern, reverse=True):
            n, lo = pattern[size], rank.get(size, 0)
            out.append((size, lo, lo + n * uses - 1, n, sequence, offset))
            rank[size] = lo + n * uses
            offset += n * size
        sequence += uses
    return out


def pack(docs: DataFrame, tokenizer_file: str, length: int = 1024, end: int = 0) -> DataFrame:
    """Every piece with its sequence_id and offset. The histogram (at most `length` rows) comes to the driver."""
    spark: SparkSession = docs.sparkSession
    order = [F.asc_nulls_last("doc_id"), F.asc("start"), F.asc("ids_crc32")]
    dealt = deal(pieces(docs, tokenizer_file, length, end), "length", order)
    histogram = {r.length: r.n for r in dealt.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(plan(histogram, length))
    where = spark.createDataFrame(rows, "_size long, _lo long, _hi long, _n long, _sequence long, _offset long")
    ranked = number(dealt, "length", order, "_rank").withColumn("_rank", F.col("_rank") - 1)
    # the number of places depends on the sequence length alone
    placed = ranked.join(F.broadcast(where), (F.col("length") == F.col("_size")) & F.col("_rank").between(F.col("_lo"), F.col("_hi")))
    at = F.col("_rank") - F.col("_lo")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("_sequence") + F.floor(at / F.col("_n"))).alias("sequence_id"),
        (F.col("_offset") + at % F.col("_n") * F.col("length")).alias("offset"),
    )
