"""Cross-tokenizer alignment: minimal groups of tokens of two tokenizers that cover the same bytes, and links between them.

The tokens of a text by tokenizer A (byte-level BPE, of a space and the text) and B (word pieces, which add that space) are
intervals of bytes. Where an A token and a B token overlap there is an edge; union-find over this bipartite graph gives its
connected components, which are exactly the minimal groups: a byte offset where tokens of both end has no edge across it,
and any other offset lies inside a token. Members of a component expand to its links, all overlapping pairs.

Texts are taken some at a time in a task, and union-find runs over all their tokens at once in arrays: roots of edges that
differ are hooked to the smaller one and paths are halved, until no edge has two roots.

How many documents hold a pair of ids linked is counted over the corpus: distinct pairs of each document are exploded and
counted by Spark with partial sums. The counts come back to documents by numbers of a fixed size: pairs that many documents
hold (at most `most`) as sorted arrays to all tasks, links of other pairs, each in few documents, by a join.

Edge cases: a null or empty text, or one whose A or B tokens do not give back the space and the text, has no tokens and
zeros; rows that share an id, or have none, stand for themselves and count as documents of their own; an empty table gives
an empty result; extra columns are ignored; a very long text is tokenized in parts, cut at spaces where no token can cross.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm import kernel as K
from rasterloom.llm.packing import Encoder
from rasterloom.llm.shared import as_parquet, batch_rows, trimmed
from rasterloom.llm.token_ids import parts

MARK = "▁"


class Pieces:
    """Ids of a text by a sentencepiece model's content, and the bytes of each id."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes on after a space inside it, so that texts may be cut there.
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces)

    def __call__(self, text: str) -> list[int]:
        if not self.cut or len(text) <= 1 << 20:
            return self.model.encode(text)
        # the model puts a space before each part; the one that a later part begins with is left to it
        return [i for k, p in enumerate(parts(text)) for i in self.model.encode(p[1:] if k else p)]


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component in a graph of n nodes with edges (u, v)."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        # a root is hooked to the smallest root it has an edge to; hooks only lead downwards, so there is no cycle
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups (from 0, in order) of A tokens and of B tokens that end at these bytes, and the first and last B token
    (inclusive) that each A token overlaps. Both sides cover the same bytes, no token is empty."""
    n, m = len(a_end), len(b_end)
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    first, last = np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_end, a_end, "left")
    # of two tokens that overlap, the one that starts later starts within the other: these edges are all
    u = np.concatenate([np.arange(n), np.searchsorted(a_end, b_start, "right")])
    v = np.concatenate([n + first, n + np.arange(m)])
    root = union_find(n + m, u, v)
    number = np.cumsum(root[:n] == np.arange(n)) - 1
    return number, number[root[n:]], first, last


class Aligner:
    """Groups and links of texts."""

    def __init__(self, a: str, b: bytes):
        self.a, self.b = Encoder(a, special=False), Pieces(b)
        size = 1 + max(*self.a.bytes_of, len(self.b.bytes_of))
        if size > 1 << 24:
            raise ValueError("vocabularies of at most 2**24 ids")
        self.a_size, self.b_size = np.zeros(size, np.int64), np.array([len(x) for x in self.b.bytes_of], np.int64)
        for i, x in self.a.bytes_of.items():
            self.a_size[i] = len(x)
        #: Decimal ids, each with the four marks that may follow it.
        self.written = [f"{i}{mark}" for i in range(size) for mark in (",", "|", ";", "")]

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not text:
            return none
        spaced = f" {text}"
        a, b = np.frombuffer(b"".join(map(self.a, parts(spaced))), "<u4").astype(np.int64), self.b(text)
        data = spaced.encode()
        # A's tokens are cuts of the bytes, which can only be too few; a model of pieces may have changed some
        if self.a_size[a].sum() != len(data) or b"".join(map(self.b.bytes_of.__getitem__, b)) != data:
            return none
        return a, np.array(b, np.int64)

    def __call__(self, texts: list[str | None]) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups and links of each text, of at most 32,768."""
        both = [self.tokens(t) for t in texts]
        n_a, n_b = (np.array([len(x[k]) for x in both], np.int64) for k in (0, 1))
        a, b = (np.concatenate([x[k] for x in both]) for k in (0, 1))
        rows = np.arange(len(texts))
        if not len(a):
            zero = np.zeros(len(texts), np.int64)
            return [*map(pa.array, (zero, zero, zero, zero)), pa.array([""] * len(texts)), self.lists(zero, zero[:0], zero[:0], zero[:0])]
        # one after the other; texts end where tokens of both end, so no group goes beyond one
        group_a, group_b, first, last = groups_of(np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]))
        doc_a = np.repeat(rows, n_a)
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        doc_of = doc_a[np.cumsum(in_a) - 1]
        n_groups = np.bincount(doc_of, minlength=len(texts))
        # links: each member of a component on side A with the members on side B from first to last
        count = last - first + 1
        to = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        n_links = np.bincount(doc_a, count, minlength=len(texts)).astype(np.int64)
        # text and both ids in one number, so that one sort brings equal pairs of a text together
        code = np.sort((np.repeat((doc_a << 48) | (a << 24), count) | b[to]).astype(np.uint64))
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        times, code = np.diff(np.append(new, len(code))), code[new].astype(np.int64)
        links = self.lists(np.bincount(code >> 48, minlength=len(texts)), (code >> 24) & 0xFFFFFF, code & 0xFFFFFF, times)
        # written: each group's A ids, then its B ids
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[np.cumsum(in_a) - 1] = 1
        end_b[np.cumsum(in_b) - 1] = 2
        end_b[np.cumsum(n_b)[n_b > 0] - 1] = 3
        text = np.zeros(len(a) + len(b), np.int64)
        text[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 4 * a + end_a
        text[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 4 * b + end_b
        at = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        written = self.written.__getitem__
        groups = pa.array(["".join(map(written, text[lo:hi].tolist())) for lo, hi in zip(at, at[1:])])
        return [*map(pa.array, (n_a, n_b, n_groups, n_links)), groups, links]

    @staticmethod
    def lists(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> pa.Array:
        values = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (a, b, times)], ["a", "b", "n"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"]


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Groups and links of every text, by a tokenizers file (a) and a sentencepiece model (b), both read by the driver.

    Returns doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`: ids of A and B in order) and links: the
    distinct pairs (a, b) of ids with how often (n) the text holds each.
    """
    shared = docs.sparkSession.sparkContext.broadcast((open(a, encoding="utf-8").read(), open(b, "rb").read()))

    def run(batches):
        aligner = Aligner(*shared.value)
        for batch in batches:
            _, at = K.string_bytes(batch.column(1))
            for lo, hi in K.chunks(np.diff(at), 1 << 20):
                for start in range(lo, hi, 1 << 15):
                    part = batch.slice(start, min(1 << 15, hi - start))
                    yield pa.RecordBatch.from_arrays([part.column(0), *aligner(part.column(1).to_pylist())], NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(trimmed(run), "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, links array<struct<a:int,b:int,n:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, docs (how many rows hold the pair linked) and best (whether no pair of the id a has more)."""
    pairs = aligned.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("docs"))
    pairs = as_parquet(pairs, "pairs")
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def bound(pairs: DataFrame, most: int) -> int:
    """The least number of documents such that at most `most` pairs have as many; by a histogram of few classes."""
    step = F.floor(F.log2("docs") * 4)
    rows = sorted(pairs.groupBy(step.alias("k")).agg(F.count("*").alias("n"), F.min("docs").alias("least")).collect(), reverse=True)
    least, total = 1 << 62, 0
    for _, n, low in rows:
        total += n
        if total > most:
            break
        least = low
    return least


def counted(aligned: DataFrame, most: int = 1 << 20) -> DataFrame:
    """aligned (written and read once again here), without links, with n_best (links whose pair is the best of its id a) and count_sum (sum of the
    pairs' docs over links)."""
    spark = aligned.sparkSession
    with batch_rows(spark):
        aligned = as_parquet(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    pairs = as_parquet(pair_counts(aligned), "pair-counts")
    least = bound(pairs, most)
    # at most `most` pairs come to the driver and go to the tasks
    frequent = pairs.where(F.col("docs") >= least).toArrow()
    code = (frequent.column("a").to_numpy().astype(np.int64) << 32) | frequent.column("b").to_numpy().astype(np.int64)
    order = np.argsort(code)
    shared = spark.sparkContext.broadcast((code[order], frequent.column("docs").to_numpy()[order], frequent.column("best").to_numpy()[order]))
    names = [c for c in aligned.columns if c != "links"]

    def run(batches):
        known, docs, best = shared.value
        for batch in batches:
            links = batch.column(batch.schema.names.index("links"))
            cells = links.flatten()
            a, b, n = (cells.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            first = np.concatenate([[0], np.cumsum(links.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            code = (a << 32) | b
            at = np.searchsorted(known, code)
            found = at < len(known)
            found[found] = known[at[found]] == code[found]
            add = np.zeros((2, len(code) + 1), np.int64)
            np.cumsum(np.where(found, n * np.append(best, False)[at], 0), out=add[0, 1:])
            np.cumsum(np.where(found, n * np.append(docs, 0)[at], 0), out=add[1, 1:])
            left = np.concatenate([[0], np.cumsum(~found)])[first]
            rest = pa.StructArray.from_arrays([pa.array(x[~found].astype(np.int32)) for x in (a, b, n)], ["a", "b", "n"])
            sums = [pa.array(x[first[1:]] - x[first[:-1]]) for x in add]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in names), *sums, pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), rest)], [*names, "n_best", "count_sum", "rest"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in aligned.schema.fields if f.name != "links")
    with batch_rows(spark):
        out = as_parquet(aligned.mapInArrow(trimmed(run), f"{schema}, n_best long, count_sum long, rest array<struct<a:int,b:int,n:int>>"), "counted")
    # each of these pairs is in fewer than `least` rows: no hot key
    rest = out.select("_row", F.explode("rest").alias("l")).select("_row", "l.*").join(pairs.where(F.col("docs") < least), ["a", "b"])
    rest = rest.groupBy("_row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("_best"), F.sum(F.col("n") * F.col("docs")).alias("_sum"))
    more = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return out.join(rest, "_row", "left").select(*(c for c in names if c != "_row"), more("n_best", "_best"), more("count_sum", "_sum"))
