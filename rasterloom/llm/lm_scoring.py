"""Language-model scoring: prediction by partial matching over a pretrained byte-context trie.

A text is coded as its lower-cased (A-Z) words, each after one space, and an end symbol. Counts of every `order + 1`
bytes in a row, and of every word, are gathered from all training documents: added up in each task, then by a shuffle.
The model is made of all contexts of up to `order` bytes. The broadcast trie holds those that are seen often enough that
at most `most_nodes` qualify; as a context is never seen more often than its own beginnings and endings, these form a trie
closed under both. It bounds memory only, not the model: a symbol whose whole context is not in the trie is looked up.

In a context a symbol seen c times out of n, q of them different, has probability (2 c - 1) / 2 n, and q / 2 n escapes to
the context without its first byte, where the symbols of the longer context are excluded; below the empty context all
bytes left are alike. These sums depend on the context alone, so they are worked out once for every node and symbol, and
with the node that each symbol leads to the trie becomes an automaton that scores one byte a step. Many segments of text
are scored in step, each after a lead of `order` bytes, which determine the node.

Symbols beyond the trie are looked up with their context as one integer: the `most_grams` most frequent such pairs in a
bounded broadcast table, all others, seen in training or not, by a join. Their probabilities come from all counts, dealt to
tasks by the last three bytes of the context: all longer contexts of a symbol meet there, the shorter ones are broadcast.

Beside it stands an add-0.1 word unigram: frequent words' counts (a bounded table) are broadcast, the others are joined.

Edge cases: a null or blank text is its end symbol alone; without training text the unigram is uniform over one unseen
token, the trie over bytes; repeated rows are scored alike; rows are told apart by their place in the input, not by id;
a null id is scored (in the query its held_out is null, and it is not learned from); extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rasterloom.llm import kernel as K
from rasterloom.llm.shared import saved

#: Bytes that no word holds, so that a text cannot hold them as symbols of its own.
SPACE, END, PAD = 0x20, 0x0A, 0x09
#: The word hash that stands for the end of a text.
END_WORD = -(1 << 63)


def coded(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes to code and the place of each text's first symbol (n+1): before each text stand `order` pads and an end."""
    n = len(at) - 1
    lead = np.array([PAD] * order + [END, SPACE], np.uint8)
    # each text becomes: lead, its bytes, an end
    size = np.diff(at)
    out = np.empty(len(raw) + n * (len(lead) + 1), np.uint8)
    first = at[:-1] + np.arange(n) * (len(lead) + 1)
    fixed = np.zeros(len(out), bool)
    for i, b in enumerate(lead):
        out[first + i] = b
        fixed[first + i] = i <= order
    last = first + len(lead) + size
    out[last] = END
    fixed[last] = True
    body = np.ones(len(out), bool)
    for i in range(len(lead)):
        body[first + i] = False
    body[last] = False
    out[body] = K.LOWER[raw]
    inside = K.IS_WORD[out] & ~fixed
    keep = inside | fixed
    # the space-like byte before a word stays, as a space; others go
    before = np.zeros(len(out), bool)
    before[:-1] = inside[1:] & ~inside[:-1] & ~fixed[:-1]
    out[before] = SPACE
    keep |= before
    place = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], np.concatenate([place[first], place[-1:]])


def grams(data: np.ndarray, first: np.ndarray, order: int) -> np.ndarray:
    """Every symbol to code with the `order` bytes before it, packed into integers (the symbol lowest)."""
    x = data.astype(np.int64)
    g = x.copy()
    for k in range(1, order + 1):
        g[k:] |= x[:-k] << (8 * k)
    coded_ = np.ones(len(data), bool)
    for i in range(order + 1):
        coded_[first[:-1] + i] = False
    return g[coded_]


def tops(keys: np.ndarray, order: int) -> np.ndarray:
    """The id (see `build`) of the longest context that each packed symbol has, which ends at the beginning of its text."""
    context, depth = keys >> 8, np.full(len(keys), order, np.int64)
    for k in range(order, 0, -1):
        depth[(context >> 8 * (k - 1)) & 255 == PAD] = k - 1
    return depth << 56 | context & ((1 << 8 * depth) - 1)


def place(table: np.ndarray, want: np.ndarray) -> np.ndarray:
    """The place of each wanted value in a sorted table, -1 if it is not there."""
    if len(table) == 0:
        return np.full(len(want), -1)
    i = np.minimum(np.searchsorted(table, want), len(table) - 1)
    return np.where(table[i] == want, i, -1)


class Tally:
    """Counts of integers, merged when many have come together."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.parts, self.size = limit, [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.parts.append((k, n))
        self.size += len(k)
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k, n = (np.concatenate(c) for c in zip(*self.parts))
        order = np.argsort(k, kind="stable")
        k, n = k[order], n[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        self.parts = [(k[new], np.add.reduceat(n, new))]
        self.size = len(new)
        return self.parts[0]


def words_of(raw, at) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = K.word_bounds(raw, at)
    return K.word_hashes(raw, start, end).view(np.int64), first


def counts(docs: DataFrame, order: int) -> DataFrame:
    """kind (0 word, 1 gram), key and n over all of docs (text)."""

    def run(batches):
        tally = {0: Tally(), 1: Tally()}
        texts = 0
        for b in batches:
            for lo, hi, raw, at in K.text_chunks(b.column(0)):
                texts += hi - lo
                tally[0].add(words_of(raw, at)[0])
                tally[1].add(grams(*coded(raw, at, order), order))
        if texts:
            tally[0].add(np.array([END_WORD], np.int64))
            for kind, t in tally.items():
                k, n = t.merge()
                if kind == 0:
                    n = np.where(k == END_WORD, n - 1 + texts, n)
                for i in range(0, len(k), 50_000):
                    part = k[i : i + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[i : i + 50_000])], ["kind", "key", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """The automaton: symbol of each byte, next node and log10 probability of each node and symbol, flattened."""

    symbol: np.ndarray
    step: np.ndarray
    logp: np.ndarray
    symbols: int
    order: int

    def scores(self, data: np.ndarray, first: np.ndarray, length: int = 256) -> np.ndarray:
        """Log10 probability of each text in coded data."""
        return self.sums(self.each(data, length), first)

    def sums(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sums of p over the coded bytes of each text."""
        total = np.concatenate([[0], np.cumsum(p)])
        return total[first[1:]] - total[first[:-1] + self.order + 1]  # the pads and the end before a text are not coded

    def each(self, data: np.ndarray, length: int = 256) -> np.ndarray:
        """Log10 probability of each byte of coded data."""
        m, lead, width = len(data), self.order + 1, self.symbols
        if m == 0:
            return np.zeros(0)
        s = self.symbol[data].astype(np.int32)
        n = -(-m // length)
        pad = np.full(lead + n * length, self.symbol[PAD], np.int32)
        pad[lead : lead + m] = s
        at = np.arange(n) * length
        node, out = np.zeros(n, np.int32), np.zeros((length, n), np.float32)
        for t in range(-lead, length):
            i = node * width + pad[at + (lead + t)]
            if t >= 0:
                np.take(self.logp, i, out=out[t])
            node = np.take(self.step, i)
        return np.ascontiguousarray(out.T).reshape(-1)[:m].astype(np.float64)

    def without_short(self, nodes: np.ndarray) -> Trie:
        """The automaton with NaN where a byte's whole context, up to the beginning of its text, is not among nodes."""
        depth = nodes >> 56
        whole = (depth == self.order) | ((nodes >> 8 * np.maximum(depth - 1, 0)) & 255 == END) & (depth > 0)
        logp = self.logp.reshape(-1, self.symbols).copy()
        logp[~whole, : self.symbols - 1] = np.nan
        return Trie(self.symbol, self.step, logp.reshape(-1), self.symbols, self.order)

    def split(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log10 probability of each text without the symbols beyond the trie, and these, packed, with their texts."""
        p = self.each(data)
        beyond = np.isnan(p)
        p[beyond] = 0
        for i in range(self.order + 1):
            beyond[first[:-1] + i] = False
        at = np.flatnonzero(beyond)
        keys = np.zeros(len(at), np.int64)
        for k in range(self.order + 1):
            keys |= data[at - k].astype(np.int64) << 8 * k
        return self.sums(p, first), keys, np.searchsorted(first, at, "right") - 1


def build(ids: np.ndarray, symbols: np.ndarray, n: np.ndarray, order: int) -> Trie:
    """The automaton from counts n of symbol bytes after contexts. ids: length << 56 | context bytes, the last lowest."""
    seen = np.unique(symbols)
    a = len(seen) + 2  # the bytes seen, all others, and the pad
    symbol = np.full(256, len(seen), np.uint8)
    symbol[seen] = np.arange(len(seen))
    symbol[PAD] = a - 1
    nodes = np.unique(np.concatenate([ids, np.zeros(1, np.int64)]))  # by length, the empty context first
    depth = nodes >> 56
    context = nodes & ((1 << 56) - 1)
    count = np.zeros((len(nodes), a - 1), np.float32)
    count[np.searchsorted(nodes, ids), symbol[symbols]] = n
    find = lambda want: np.where(nodes[i := np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)] == want, i, -1)
    # without its first byte a context is as frequent at least, so it is there
    short = np.maximum(find(np.where(depth > 0, (depth - 1) << 56 | context & ((1 << 8 * np.maximum(depth - 1, 0)) - 1), 0)), 0)
    unseen = 256 - len(seen)
    logp = np.empty((len(nodes), a), np.float32)
    for lo in range(0, len(nodes), 4096):
        at = np.arange(lo, min(lo + 4096, len(nodes)))
        p, out, carry, here, live = np.zeros((len(at), a - 1)), np.zeros((len(at), a - 1), bool), np.ones(len(at)), at.copy(), np.ones(len(at), bool)
        for _ in range(order + 1):
            c = np.where(out, 0, count[here]) * live[:, None]
            total, kinds = c.sum(axis=1), (c > 0).sum(axis=1)
            has = total > 0
            p[has] += carry[has, None] * np.where(c[has] > 0, 2 * c[has] - 1, 0) / (2 * total[has, None])
            carry[has] *= kinds[has] / (2 * total[has])
            out |= c > 0
            live &= depth[here] > 0
            here = short[here]
        # all bytes left are alike; the last column stands for all bytes never seen
        left = ~out * np.where(np.arange(a - 1) == a - 2, unseen, 1)
        p += carry[:, None] * left / np.maximum(left.sum(axis=1), 1)[:, None]
        p[:, a - 2] /= unseen
        logp[at, : a - 1] = np.log10(np.maximum(p, 1e-30))
        logp[at, a - 1] = 0
    step = np.zeros((len(nodes), a), np.int32)
    for s, b in enumerate(seen.tolist()):
        # the longest ending of context and symbol that is a node
        best, long = np.zeros(len(nodes), np.int64), np.minimum(depth + 1, order)
        full = context << 8 | b
        for k in range(order, 0, -1):
            i = find(np.where(long >= k, k << 56 | full & ((1 << 8 * k) - 1), -1))
            best = np.where((best == 0) & (i > 0), i, best)
        step[:, s] = best
    return Trie(symbol, step.reshape(-1), logp.reshape(-1), a, order)


def short(order: int) -> int:
    """By so many last bytes of the context are counts dealt to tasks; contexts of fewer bytes are broadcast."""
    return min(max(order, 1), 3)


def exact(wanted: np.ndarray, heads: tuple[np.ndarray, np.ndarray], keys: np.ndarray, n: np.ndarray, order: int) -> np.ndarray:
    """Log10 probabilities of packed symbols by counts n of all packed symbols whose contexts end alike.

    heads: all packed symbols with contexts of less than `short` bytes, and counts. What is seen after a context is seen
    after its endings, so the symbols excluded in a context are those of the context one byte longer.
    """
    levels = []
    for k in range(order + 1):
        own, m = heads if k < short(order) else (keys, n)
        inside = (own >> 8 * k) & 255 != PAD if k else np.ones(len(own), bool)
        edge, i = np.unique(own[inside] & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
        m = np.bincount(i, m[inside], len(edge))
        context, i = np.unique(edge >> 8, return_inverse=True)
        again = levels[-1][1][place(levels[-1][0], edge & ((1 << 8 * k) - 1))] if k and len(edge) else np.zeros(len(edge))
        levels.append((edge, m, context, *(np.bincount(i, w, len(context)) for w in (m, np.ones(len(edge)), again))))
    p, carry, live = np.zeros(len(wanted)), np.ones(len(wanted)), np.ones(len(wanted), bool)
    out_n, out_kinds = np.zeros(len(wanted)), np.zeros(len(wanted))
    for k in range(order, -1, -1):
        edge, m, context, total, kinds, again = levels[k]
        if len(edge) == 0:
            continue
        i = place(context, (wanted >> 8) & ((1 << 8 * k) - 1))
        has = live & (i >= 0)
        if k:
            has &= (wanted >> 8 * k) & 255 != PAD
        e = place(edge, wanted & ((1 << 8 * (k + 1)) - 1))
        left, other = total[i] - out_n, kinds[i] - out_kinds
        hit, gone = has & (e >= 0), has & (e < 0) & (left > 0)
        p[hit] = carry[hit] * (2 * m[e[hit]] - 1) / (2 * left[hit])
        carry[gone] *= other[gone] / (2 * left[gone])
        live &= ~hit
        out_n, out_kinds = np.where(has, again[i], 0), np.where(has, kinds[i], 0)
    p[live] = carry[live] / max(256 - len(levels[0][0]), 1)
    return np.log10(np.maximum(p, 1e-30))


def probabilities(wanted: DataFrame, table: DataFrame, order: int) -> DataFrame:
    """key and logp of every row of wanted (key), by the counts of table (key, n)."""
    tail = short(order)
    heads = arrays(table.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * tail) - 1)).alias("key")).agg(F.sum("n").alias("n")))
    heads = table.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        key, n = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0, np.int64)), *((b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches)))
        ask = key[n == 0]
        for i in range(0, len(ask), 50_000) if len(ask) else ():
            part = ask[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(exact(part, heads.value, key[n > 0], n[n > 0], order))], ["key", "logp"])

    rows = table.select("key", "n").union(wanted.select("key", F.lit(0).cast("long")))
    # as many tasks as shuffles have, which follows the size of the data
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * tail) - 1))
    return rows.repartition(parts, by).mapInArrow(run, "key long, logp double")


def threshold(table: DataFrame, most: int) -> int:
    """The least n so that at most `most` rows of table have n or more."""
    sizes = table.groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(most + 1).collect()
    total, least = 0, (sizes[0].n + 1 if sizes else 1)
    for r in sizes:
        total += r.rows
        if total > most:
            break
        least = r.n
    return least


def arrays(df: DataFrame) -> list[np.ndarray]:
    return [c.to_numpy() for c in df.toArrow().columns]


def score(docs: DataFrame, training: DataFrame, order: int = 5, most_nodes: int = 100_000, most_words: int = 500_000, most_grams: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of docs, by a model of training."""
    spark = docs.sparkSession
    table = counts(training, order).transform(saved)
    words = table.where("kind = 0").select("key", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()

    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    mask = F.expr("shiftleft(1L, 8 * k) - 1L")
    own = F.shiftright("key", 8).bitwiseAND(mask)
    edges = table.where("kind = 1").select(level, "key", "n")
    # a context that would reach over the beginning of a text is not one
    starts = (F.col("k") == 0) | (F.expr("shiftright(key, 8 * k) & 255") != PAD)
    edges = edges.where(starts).select((own + F.col("k").cast("long") * (1 << 56)).alias("id"), F.col("key").bitwiseAND(F.lit(255)).cast("int").alias("symbol"), "n")
    edges = edges.groupBy("id", "symbol").agg(F.sum("n").alias("n")).transform(saved)
    contexts = edges.groupBy("id").agg(F.sum("n").alias("n"))
    chosen = contexts.where(F.col("n") >= threshold(contexts, most_nodes)).select("id")
    ids, symbols, n = arrays(edges.join(chosen, "id").select("id", "symbol", "n"))
    nodes = np.unique(np.concatenate([ids, np.zeros(1, np.int64)]))
    trie = build(ids, symbols, n, order).without_short(nodes)

    grams_ = table.where("kind = 1").select("key", "n")

    def beyond_trie(batches):
        for b in batches:
            yield b.filter(pa.array(place(nodes, tops(b.column(0).to_numpy(), order)) < 0))

    beyond = grams_.mapInArrow(beyond_trie, "key long, n long").transform(saved)
    often = beyond.where(F.col("n") >= threshold(beyond, most_grams))
    gram, logp = arrays(probabilities(often, grams_, order))
    by = np.argsort(gram)
    looked_up = gram[by], logp[by]

    least = threshold(words, most_words)
    keys, n = arrays(words.where(F.col("n") >= least))
    by = np.argsort(keys)
    shared = spark.sparkContext.broadcast((trie, keys[by], n[by], *looked_up))
    names = ["row", "doc_id", "n_tokens", "n_known", "logs", "score", "rare", "rest"]

    def run(batches):
        trie, keys, n, gram, logp = shared.value
        logs, row = np.log10(n + 0.1), TaskContext.get().partitionId() << 40
        for b in batches:
            for lo, hi, raw, at in K.text_chunks(b.column(1)):
                w, first = words_of(raw, at)
                # every text ends with the end token
                w, first = np.insert(w, first[1:], END_WORD), first + np.arange(len(first))
                i = np.minimum(np.searchsorted(keys, w), max(len(keys) - 1, 0))
                known = keys[i] == w if len(keys) else np.zeros(len(w), bool)
                sums = np.concatenate([[0], np.cumsum(np.where(known, logs[i], 0) if len(keys) else np.zeros(len(w)))])
                have = np.concatenate([[0], np.cumsum(known)])
                rare = np.concatenate([[0], np.cumsum(~known)])
                score, asked, of = trie.split(*coded(raw, at, trie.order))
                i = place(gram, asked)
                there, to = i >= 0, np.arange(hi - lo + 1)
                score += np.bincount(of[there], logp[i[there]], hi - lo)
                rest = np.searchsorted(of[~there], to)
                col = [
                    pa.array(row + np.arange(hi - lo)), b.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.diff(have[first])),
                    pa.array(np.diff(sums[first])), pa.array(score),
                    pa.ListArray.from_arrays(pa.array(rare[first], pa.int32()), pa.array(w[~known])),
                    pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(asked[~there])),
                ]
                row += hi - lo
                yield pa.RecordBatch.from_arrays(col, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, logs double, score double, rare array<long>, rest array<long>").transform(saved)
    rare = scored.select("row", F.explode("rare").alias("key")).join(words.where(F.col("n") < least), "key", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("_known"), F.sum(F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.1)).alias("_logs"))
    rest = scored.select("row", F.explode("rest").alias("key"))
    rest = rest.join(probabilities(rest.select("key").distinct(), grams_, order), "key").groupBy("row").agg(F.sum("logp").alias("_rest"))
    every = float(np.log10(total + 0.1 * (kinds + 1)))
    return scored.drop("rare", "rest").join(rare, "row", "left").join(rest, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(every)).alias("base_score"),
        (F.col("score") + F.coalesce("_rest", F.lit(0.0))).alias("score"),
    )
