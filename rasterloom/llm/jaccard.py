"""N-gram Jaccard join in the metric space of shingle sets, exact, and its connected components.

d(x, y) = 1 - |x & y| / |x | y| is a metric; equal sets are one point of the space. Nearly all documents are at distance 1
from nearly all others, so whole documents as first pivots would part nothing: the first pivots are single shingles, and the
region of one has the documents within distance 1 of it (those that hold it). Of a document's shingles, the
|x| - ceil(0.75 |x|) + k first in one order of all shingles are enough: two linked documents share k of them, a tenth of
their shingles (see `needed`). The order puts shingles that are frequent in a bounded sample last, which keeps regions
small; any order finds all links.

Two sets are tied if they are together in as many regions as linked sets of their sizes must be. That is counted pair by
pair in regions of up to `few` sets; larger ones may all be common to both. Sets that share a larger region are tied if both
are in as many larger regions as a linked set of their size must be. So passages that many documents share tie few of them.
Ties mostly hold groups of copies: sets tied directly or through others are a cell while they have `room` shingles at most,
and each set moves once; in a larger component of ties, the larger regions of each least set are a cell and every tied pair
is one, or the whole component is one if that is less to send (`large_cells`). Regions that share their least set are alike
(the chance is their sets' Jaccard similarity), or have it as a common member.
A cell is joined in one task by recursive Voronoi regions of whole documents (`voronoi`): nearest pivots, window copies by
the triangle inequality, exact distances. A cell beyond `room` is first split by the same rules over many tasks: its sets are dealt in chunks that measure their distances to `pivots` sets of the cell, links to pivots become
components, and each set goes to its nearest pivot's cell and, as a window copy, to others. Cells that hold one component
are done. One that pivots do not part (a dense group with links that no pivot has) is dealt in blocks, pairs of blocks
being cells, where the largest component meets all other sets but not itself. Only links that join components (fewer than
sets) leave a task.

Shingles and sets are told apart by 64-bit hashes.

Edge cases: a null or blank text has no shingle, no link and its own id as its component; a text of one to four words is
one shingle; rows that share an id, or a text, are points that coincide (a null id is never the smallest); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rasterloom.llm import kernel as K
from rasterloom.llm.components import components
from rasterloom.llm.lm_scoring import Tally, threshold
from rasterloom.llm.shared import as_parquet, batch_rows, free, release, saved, trimmed
from rasterloom.llm.voronoi import Space

ENTRY = np.dtype([("key", "<u4"), ("n", "<u4"), ("set", "<i8")])
SHARE = np.dtype([("least", "<i8"), ("set", "<i8"), ("n", "<u4"), ("m", "<u4")])
TIES = "kind int, u long, v long, m long, n_u long, n_v long"
PAIR, LIST = range(2)


def shingle_sets(col: pa.Array, width: int):
    """(lo, hi, shingles by row in order, number before each row, set ids) for some rows at a time."""
    for lo, hi, raw, at in K.text_chunks(col):
        start, end, first = K.word_bounds(raw, at)
        h, rows = K.shingles(K.word_hashes(raw, start, end), first, width)
        h, first = K.distinct_sorted(h, rows, hi - lo)
        yield lo, hi, h, first, K.set_hash(h, first).view(np.int64)


def prefix_size(n, percent: int):
    """How many of n shingles, first in the order, are taken: those beyond any overlap with a linked set, and a tenth more."""
    return (n + (-percent * n // 100) + least_common(n)) * (n > 0)


def least_common(n):
    """How many prefix shingles at least a set of n shingles shares with a linked one that is no larger."""
    few = n // 10
    return few + (few < 1)


def new_sets(seen: set, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of sets not empty and not seen by this task."""
    _, at = np.unique(ids, return_index=True)
    own = [i for i in at.tolist() if n[i] and int(ids[i]) not in seen]
    if len(seen) > 1_000_000:
        seen.clear()  # only saves work: a set told twice is told once later
    seen.update(ids[own].tolist())
    return np.array(sorted(own), np.int64)


def sets_and_sample(docs: DataFrame, width: int, rate: float) -> DataFrame:
    """kind 0: id, h, set, n of each row (id, text, h); kind 1: shingle (as set) and its count in a share of the sets, by task."""
    names, room = ["kind", "id", "h", "set", "n"], int(rate * (1 << 63))

    def run(batches):
        tally, seen = Tally(), set()
        for b in batches:
            ids, hashes = b.column(0), b.column(2)
            for lo, hi, h, first, sets in shingle_sets(b.column(1), width):
                n = np.diff(first)
                pick = new_sets(seen, sets, np.where(K.mix(sets.view(np.uint64)) >> np.uint64(1) <= np.uint64(room), n, 0))
                for i in pick:
                    tally.add(h[first[i] : first[i + 1]].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(hi - lo, np.int32)), ids.slice(lo, hi - lo), hashes.slice(lo, hi - lo), pa.array(sets), pa.array(n)], names)
        key, count = tally.merge()
        for i in range(0, len(key), 50_000):
            k = key[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int32)), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(k), pa.array(count[i : i + 50_000])], names)

    return docs.mapInArrow(trimmed(run), "kind int, id long, h long, set long, n long")


def regions(docs: DataFrame, width: int, percent: int, frequent, count: int, few: int) -> DataFrame:
    """Of the regions (shingles) that have two sets or more, kind, u, v, m, n_u and n_v.

    PAIR: two sets, the number of regions of up to `few` sets they share, by task, and their sizes. LIST: a set that is the
    least of larger regions, each set of these, the number of such regions, and the set's size.

    Near copies are together in most of their regions, so a region's sets are sent once more, to where its least set's
    regions are: there equal regions are one, and pairs are counted for a group, not for each of its regions. A set is
    the least of no more regions than it has shingles. Of larger regions, each set is counted where its least set and
    itself lead, so that no task has a whole group. Sets that are in no region with another are not sent again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def dealt(e, at, kind):
        """Rows (kind, bucket, entries) of entries e for buckets `at`."""
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        cut = np.flatnonzero(np.diff(at)) + 1
        blobs = [x.tobytes() for x in np.split(e, cut)] if len(e) else []
        return pa.table([pa.array(np.full(len(blobs), kind, np.int32)), pa.array(at[np.concatenate([[0], cut])] if len(e) else at), pa.array(blobs, pa.binary())], ["kind", "bucket", "entries"])

    def summed(e):
        """One entry for each least and set, with the sum of m."""
        e = e[np.lexsort((e["set"], e["least"]))]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(e["least"]) != 0) | (np.diff(e["set"]) != 0)])) if len(e) else np.zeros(0, np.int64)
        out = e[new]
        if len(e):
            out["m"] = np.add.reduceat(e["m"], new)
        return out

    def emit(parts):
        e = np.concatenate(parts)
        at = (K.mix(np.ascontiguousarray(e["key"])) % np.uint64(count)).astype(np.int64)
        order = np.argsort(at, kind="stable")
        e, at = e[order], at[order]
        cut = np.flatnonzero(np.diff(at)) + 1
        blobs = [x.tobytes() for x in np.split(e["entry"], cut)]
        return pa.RecordBatch.from_arrays([pa.array(at[np.concatenate([[0], cut])]), pa.array(blobs, pa.binary())], ["region", "entries"])

    def run(batches):
        keys, classes = shared.value
        seen, parts, size = set(), [], 0
        for b in batches:
            for _, _, h, first, sets in shingle_sets(b.column(0), width):
                n = np.diff(first)
                pick = new_sets(seen, sets, n)
                take = np.zeros(len(n), bool)
                take[pick] = True
                rows = np.repeat(np.arange(len(n)), n)
                if len(keys) and len(h):
                    k = h.view(np.int64)
                    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                    order = np.argsort(rows * 64 + np.where(keys[at] == k, classes[at], 0), kind="stable")
                    h = h[order]
                own = take[rows] & (np.arange(len(h)) - first[rows] < prefix_size(n, percent)[rows])
                e = np.empty(int(own.sum()), [("key", "<u8"), ("entry", ENTRY)])
                # a region's number within its task: two of one number only add candidates
                e["key"], e["entry"]["key"], e["entry"]["n"], e["entry"]["set"] = h[own], K.mix(h[own]) >> np.uint64(32), n[rows[own]], sets[rows[own]]
                parts.append(e)
                size += len(e)
                if size > 250_000:
                    yield emit(parts)
                    parts, size = [], 0
        if size:
            yield emit(parts)

    def meet(table: pa.Table) -> pa.Table:
        e = np.concatenate([np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("entries")])
        e = e[np.lexsort((e["set"], e["key"]))]
        e = e[np.concatenate([[True], (e["key"][1:] != e["key"][:-1]) | (e["set"][1:] != e["set"][:-1])])]
        cut = np.flatnonzero(np.concatenate([[True], e["key"][1:] != e["key"][:-1]]))
        size = np.diff(np.append(cut, len(e)))
        least = np.repeat(e["set"][cut], size)
        e["key"] = np.repeat(np.arange(len(cut)), size)
        size = np.repeat(size, size)
        small, wide = (size > 1) & (size <= few), size > few
        more = np.empty(int(wide.sum()), SHARE)
        more["least"], more["set"], more["n"], more["m"] = least[wide], e["set"][wide], e["n"][wide], 1
        more = summed(more)
        spread = K.mix(K.mix(np.ascontiguousarray(more["set"]).view(np.uint64)) ^ np.ascontiguousarray(more["least"]).view(np.uint64))
        both = (e[small], K.mix(least[small].view(np.uint64)), PAIR), (more, spread, LIST)
        return pa.concat_tables([dealt(x, (h % np.uint64(count)).astype(np.int64), kind) for x, h, kind in both])

    def gather(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_numpy(), [x.as_buffer() for x in table.column("entries")]
        out = []

        def add(kind, u, v, m, n_u, n_v):
            out.append(pa.table([pa.array(np.full(len(u), kind, np.int32)), *(pa.array(np.ascontiguousarray(x, np.int64)) for x in (u, v, m, n_u, n_v))], names))

        more = summed(np.concatenate([np.zeros(0, SHARE), *(np.frombuffer(x, SHARE) for x, k in zip(blobs, kinds) if k == LIST)]))
        add(LIST, more["least"], more["set"], more["m"], more["n"], more["n"])
        some = [np.frombuffer(x, ENTRY) for x, k in zip(blobs, kinds) if k == PAIR]
        if not some:
            return pa.concat_tables(out)
        e = np.concatenate(some)
        sets, n = np.ascontiguousarray(e["set"]), e["n"].astype(np.int64)
        # a task numbers its regions, and has sent one blob
        begins = np.concatenate([[True], e["key"][1:] != e["key"][:-1]])
        begins[np.cumsum([0] + [len(x) for x in some[:-1]])] = True
        cut = np.flatnonzero(begins)
        size = np.diff(np.append(cut, len(e)))
        mass = np.add.reduceat(K.mix(sets.view(np.uint64)), cut)
        _, one, often = np.unique(mass, return_index=True, return_counts=True)
        by = np.argsort(sets[cut[one]], kind="stable")
        cut, size, often = cut[one][by], size[one][by], often[by]
        # regions by their least set, about a million pairs at a time
        step = np.cumsum(size * (size - 1) // 2) // 1_000_000
        for part in np.split(np.arange(len(cut)), np.flatnonzero(np.diff(step)) + 1):
            a, b, m = [], [], []
            for r in np.unique(size[part]).tolist():
                at = part[size[part] == r]
                left, right = np.triu_indices(r, 1)
                a.append((cut[at, None] + left).reshape(-1))
                b.append((cut[at, None] + right).reshape(-1))
                m.append(np.repeat(often[at], len(left)))
            a, b, m = map(np.concatenate, (a, b, m))
            fit = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b, m = a[fit], b[fit], m[fit]
            if len(a):
                order = np.lexsort((sets[b], sets[a]))
                a, b, m = a[order], b[order], m[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(sets[a]) != 0) | (np.diff(sets[b]) != 0)]))
                add(PAIR, sets[a[new]], sets[b[new]], np.add.reduceat(m, new), n[a[new]], n[b[new]])
        return pa.concat_tables(out)

    names = [x.split()[0] for x in TIES.split(", ")]
    met = docs.select("text").mapInArrow(trimmed(run), "region long, entries binary").groupBy("region").applyInArrow(meet, "kind int, bucket long, entries binary")
    return met.groupBy("bucket").applyInArrow(gather, TIES)


def needed(n_u: str, n_v: str, percent: int):
    """How many regions two linked sets of these sizes are together in, at least.

    Linked sets have o = ceil(p (n_u + n_v) / (1 + p)) shingles or more together. The j-th of them in the order stands at
    place n - o + j of a set at the latest, and so in the prefixes of both for all j up to the least of prefix - n + o.
    """
    together = F.ceil((F.col(n_u) + F.col(n_v)) * percent / (100.0 + percent) - 1e-9)
    return together + F.least(*[prefix_column(F.col(n), percent) - F.col(n) for n in (n_u, n_v)])


def prefix_column(n, percent: int):
    """`prefix_size` of a column."""
    return n - F.ceil(n * percent / 100.0 - 1e-9) + F.greatest(F.lit(1), F.floor(n / 10.0 + 1e-9))


def ties(found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """u and v of tied pairs, and cell and set of the larger regions' sets that may be linked there."""
    lists = found.where(f"kind = {LIST}")
    large = lists.groupBy(F.col("v").alias("set")).agg(F.sum("m").alias("g"), F.max("n_v").alias("n")).transform(saved)
    pairs = found.where(f"kind = {PAIR}").groupBy("u", "v").agg(F.sum("m").alias("m"), F.max("n_u").alias("n_u"), F.max("n_v").alias("n_v"))
    for x in "uv":
        pairs = pairs.join(large.select(F.col("set").alias(x), F.col("g").alias(f"g_{x}")), x, "left")
    spare = F.least(F.coalesce("g_u", F.lit(0)), F.coalesce("g_v", F.lit(0)))
    pairs = pairs.where(F.col("m") + spare >= needed("n_u", "n_v", percent)).select("u", "v")
    # the least that a set can share with a linked one of any size
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100.0 - 1e-9) / 10.0 + 1e-9))
    wide = lists.select(F.col("u").alias("cell"), F.col("v").alias("set")).join(large.where(F.col("g") >= least).select("set"), "set", "left_semi")
    return pairs, wide.select("cell", "set")


def bitmap(hashes: DataFrame, bits: int = 25) -> np.ndarray:
    """Bits of the hashes (column `set`), 4 MB for 25 whatever their number: thins a shuffle while they are few, else lets all pass."""
    at = F.col("set").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("m")).collect()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts:
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.m, np.uint8)
    return out


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the hashes' bits."""
    at = hashes & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def shapes(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted rows (set and more) with a text of their set, packed; more than once if several tasks read the set.

    Packed texts are a third as long as their shingles, and are turned into these again where they meet.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(wanted))

    def run(batches):
        seen, bits, codec = set(), shared.value, pa.Codec("zstd", compression_level=1)
        for b in batches:
            raw, at = K.string_bytes(b.column(0))
            for lo, _, _, first, sets in shingle_sets(b.column(0), width):
                own = new_sets(seen, sets, np.where(marked(bits, sets), np.diff(first), 0))
                if len(own):
                    texts = [raw[at[i] : at[i + 1]].tobytes() for i in (lo + own).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(sets[own]), pa.array([len(x).to_bytes(4, "little") + codec.compress(x, asbytes=True) for x in texts], pa.binary())], ["set", "body"])

    return docs.select("text").mapInArrow(trimmed(run), "set long, body binary").join(wanted.hint("shuffle_hash"), "set")


def unpacked(bodies: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of packed texts, one after another, and where each begins."""
    texts = pa.array([pa.decompress(b[4:], int.from_bytes(b[:4], "little"), codec="zstd", asbytes=True) for b in bodies], pa.large_binary())
    h, n = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, _, x, first, _ in shingle_sets(texts, width):
        h.append(x)
        n.append(np.diff(first))
    return np.concatenate(h), np.cumsum(np.concatenate(n))


def joined(members: DataFrame, percent: int, width: int, tasks: int) -> DataFrame:
    """u and v, v the least set of u's component within a cell, of members (cell, set, own, c, body)."""

    def run(table: pa.Table) -> pa.Table:
        cell, sets, own, c = (table.column(x).to_numpy(zero_copy_only=False) for x in ("cell", "set", "own", "c"))
        order = np.lexsort((sets, cell))
        new = np.concatenate([[True], (np.diff(cell[order]) != 0) | (np.diff(sets[order]) != 0)])
        order = order[new]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(cell[order])) + 1, [len(order)]])
        bodies, u, v = table.column("body"), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in (order[a:b] for a, b in zip(cut, cut[1:]) if b - a > 1):
            space = Space(*unpacked([bodies[i].as_py() for i in at.tolist()], width), percent, np.unique(c[at], return_inverse=True)[1])
            label = space.join(own[at])
            # rows stand by set, so a component's first row has its least set
            _, first, part = np.unique(label, return_index=True, return_inverse=True)
            u.append(sets[at])
            v.append(sets[at][first[part]])
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.table({"u": u[u != v], "v": v[u != v]})

    part = F.pmod(F.xxhash64("cell"), F.lit(tasks))
    return members.withColumn("part", part).groupBy("part").applyInArrow(run, "u long, v long")


def measured(members: DataFrame, pivots: DataFrame, percent: int, width: int, chunk: int = 1024) -> DataFrame:
    """cell, set, n, own, d (distances to the cell's pivots) and hits (the pivots it is linked with).

    members: cell, set, n, own, size (of the cell), body; pivots: cell, set, size, body. Both are dealt in chunks.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["cell", "set", "n", "own"]
        if not left.num_rows or not right.num_rows:
            return pa.table({x: left.column(x).slice(0, 0) for x in names} | {"d": pa.array([], pa.list_(pa.float64())), "hits": pa.array([], pa.list_(pa.int64()))})
        _, first = np.unique(left.column("set").to_numpy(), return_index=True)
        left = left.take(pa.array(first))
        _, first = np.unique(right.column("set").to_numpy(), return_index=True)
        right = right.take(pa.array(first))
        m, ids = left.num_rows, right.column("set").to_numpy()
        space = Space(*unpacked(left.column("body").to_pylist() + right.column("body").to_pylist(), width), percent)
        rows = np.arange(m)
        d = np.array([space.distances(m + i, rows) for i in range(len(ids))])
        hit = d <= space.r + 1e-12
        return pa.table({x: left.column(x) for x in names} | {"d": pa.array(list(d.T), pa.list_(pa.float64())), "hits": pa.array([ids[h].tolist() for h in hit.T], pa.list_(pa.int64()))})

    chunks = F.ceil(F.col("size") / chunk).cast("int")
    left = members.withColumn("chunk", F.pmod(F.xxhash64("set"), chunks).cast("int"))
    right = pivots.toDF(*pivots.columns).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
    both = left.groupBy("cell", "chunk").cogroup(right.groupBy("cell", "chunk"))
    return both.applyInArrow(run, "cell long, set long, n long, own boolean, d array<double>, hits array<long>")


def parted(rows: DataFrame, percent: int) -> DataFrame:
    """cell, old (the cell before), set, n, own: the Voronoi cells of measured rows, by the rules of `voronoi.regions`."""
    r, slack = 1 - percent / 100, 1e-9
    rows = rows.withColumn("least", F.array_min("d")).withColumn("k", F.size("d"))
    home = F.when(F.col("own") & (F.col("least") <= 2 * r + slack), F.array_position("d", F.col("least")).cast("int") - 1).otherwise(F.col("k"))
    rows = rows.withColumn("home", home)
    reach = rows.where("own AND home < k").groupBy("cell", "home").agg(F.max(F.element_at("d", F.col("home") + 1)).alias("reach"))
    reach = reach.select("cell", F.col("home").alias("p"), "reach").unionByName(rows.select("cell", F.col("k").alias("p"), F.lit(None).cast("double").alias("reach")).distinct())
    at = F.element_at("d", F.col("p") + 1)
    inner = F.col("own") & (F.col("home") == F.col("p"))
    last = F.col("p") == F.col("k")
    window = F.when(last, ~F.col("own") & (F.col("least") > r - slack)).otherwise(
        (~F.col("own") | (F.col("home") > F.col("p"))) & (at <= F.col("reach") + r + slack) & (at - F.col("least") <= 2 * r + slack)
    )
    # a cell has few pivots, so a row meets few reaches
    both = rows.join(reach, "cell").where(inner | window)
    return both.select(F.xxhash64("cell", "p").alias("cell"), F.col("cell").alias("old"), "set", "n", inner.alias("own"))


def blocks(cells: DataFrame, room: int) -> DataFrame:
    """cell, set, n, own, c: cells (cell, set, n, own, c) dealt in pairs of blocks of half a room, but for pairs of blocks of
    the largest component."""
    sums = cells.groupBy("cell", "c").agg(F.sum("n").alias("w"))
    main = sums.groupBy("cell").agg(F.max_by("c", "w").alias("main"), F.max("w").alias("a"), (F.sum("w") - F.max("w")).alias("b"))
    many = lambda x: F.ceil(2 * F.col(x) / room).cast("int")
    rows = cells.join(main.select("cell", "main", many("a").alias("a"), many("b").alias("b")), "cell").where("b > 0")
    most = F.col("c") == F.col("main")
    hashed = F.xxhash64(F.lit(7), "set")
    rows = rows.withColumn("most", most).withColumn("i", F.when(most, F.col("b") + F.pmod(hashed, "a")).otherwise(F.pmod(hashed, "b")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(F.col("most"), F.col("b") - 1).otherwise(F.col("a") + F.col("b") - 1))))
    pair = F.xxhash64("cell", F.least("i", "j"), F.greatest("i", "j"))
    return rows.select(pair.alias("cell"), "set", "n", (F.col("i") <= F.col("j")).alias("own"), "c")


def large_cells(large: DataFrame, wide: DataFrame, pairs: DataFrame, room: int) -> DataFrame:
    """cell, set, n: the cells of components of ties (whole, set, n, w) beyond room.

    One cell for the larger regions of each least set and one for each tied pair, or the whole component where its blocks, each
    with each, are less to send: the sets of a large group of near copies are all together in most of their regions.
    """
    both = pairs.select(F.xxhash64("u", "v").alias("cell"), F.explode(F.array("u", "v")).alias("set"))
    single = wide.unionByName(both).join(large, "set").transform(saved)
    in_blocks = lambda w: w * F.when(w > room, F.ceil(2 * w / room)).otherwise(1)
    sent = single.groupBy("whole", "cell").agg(F.sum("n").alias("x"), F.max("w").alias("w")).groupBy("whole").agg(F.sum(in_blocks(F.col("x"))).alias("sent"), F.max("w").alias("w"))
    kept = sent.select("whole", (in_blocks(F.col("w")) <= F.col("sent")).alias("kept")).transform(saved)
    single = single.join(kept.where("NOT kept"), "whole", "left_semi").select("cell", "set", "n")
    return single.unionByName(large.join(kept.where("kept"), "whole", "left_semi").select(F.col("whole").alias("cell"), "set", "n"))


def cell_links(forms: DataFrame, cells: DataFrame, edges: list[DataFrame], percent: int, width: int, room: int, pivots: int, parts: int) -> list[DataFrame]:
    """Links (u, v) of all cells (cell, old, set, n, own), of any size, besides those known. forms: set, body."""
    while True:
        tree = components(_union(edges)) if edges else None
        if tree is not None:
            cells = cells.join(tree.select(F.col("node").alias("set"), "least"), "set", "left").select("cell", "old", "set", "n", "own", F.coalesce("least", "set").alias("c"))
        else:
            cells = cells.select("cell", "old", "set", "n", "own", F.col("set").alias("c"))
        sums = cells.groupBy("cell").agg(F.sum("n").alias("w"), F.count("*").alias("size"), F.max("old").alias("old"), (F.min("c") != F.max("c")).alias("open")).where("open").transform(saved)
        if sums.isEmpty():
            return edges
        cells = cells.join(sums.select("cell", "w", "size"), "cell").transform(saved)
        stuck = cells.where("w > {0} AND old IS NOT NULL AND 10 * w > 8 * old".format(room))
        here = cells.where(F.col("w") <= room).select("cell", "set", "n", "own", "c").unionByName(blocks(stuck.select("cell", "set", "n", "own", "c"), room)).transform(saved)
        tasks = max(parts, math.ceil((here.agg(F.sum("n")).first()[0] or 0) / room))
        edges = [*edges, joined(forms.join(here, "set"), percent, width, tasks).transform(saved)]
        big = cells.where("w > {0} AND (old IS NULL OR 10 * w <= 8 * old)".format(room))
        if big.isEmpty():
            return edges
        some = [F.min_by("set", F.xxhash64("set", F.lit(i))).alias(f"p{i}") for i in range(pivots)]
        chosen = big.where("own").groupBy("cell", "size").agg(*some).select("cell", "size", F.explode(F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)]))).alias("set")).transform(saved)
        rows = measured(forms.join(big.select("cell", "set", "n", "own", "size"), "set"), forms.join(chosen, "set"), percent, width).transform(saved)
        edges = [*edges, rows.select(F.col("set").alias("u"), F.explode("hits").alias("v")).where("u <> v").distinct()]
        weight = big.select(F.col("cell").alias("old"), F.col("w").alias("old_w")).distinct()
        split = parted(rows, percent).join(weight, "old").transform(saved)
        # where most sets would move with window copies, the cell stays whole and is dealt in blocks
        stays = split.groupBy("old", "old_w").agg(F.sum("n").alias("w")).where("w > 2 * old_w").select("old").transform(saved)
        cells = split.join(stays, "old", "left_anti").select("cell", F.col("old_w").alias("old"), "set", "n", "own")
        cells = cells.unionByName(big.join(stays.withColumnRenamed("old", "cell"), "cell", "left_semi").select("cell", F.col("w").alias("old"), "set", "n", "own"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def classes(docs: DataFrame, percent: int = 75, width: int = 5, few: int = 16, room: int = 1 << 22, pivots: int = 16, sample: int = 10_000, most_frequent: int = 500_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs.

    few: sets of a region whose pairs are counted; room: shingles (8 bytes each) of a cell that one task joins; pivots: of
    a cell beyond that. None of them changes the result.
    """
    with batch_rows(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        points, tree = set_classes(rows, percent, width, few, room, pivots, sample, most_frequent)
        points = points.select("id", "set", "n")
    labelled = points.join(tree, "set", "left").select("id", "n", F.coalesce("c", "set").alias("c"), (F.col("n") > 0).alias("full"))
    least = labelled.where("full").groupBy("c").agg(F.min("id").alias("least"))
    joined_ = labelled.join(least, "c", "left")
    return joined_.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("full"), F.col("least")).otherwise(F.col("id")).alias("component_id"))


def stay_or_go(full: DataFrame, first: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the hashes of the keys that stay, and of those that go or are of many rows; a key that is in one only is told by it.

    full: all keys; first: the keys that stay, and whether they are of many rows. 16 MB each at most.
    """
    bits = min(27, max(16, (8 * rows).bit_length()))
    hashed = F.xxhash64("key.a", "key.b", "key.c").alias("set")
    goes = full.select("key").join(first.select("key").hint("shuffle_hash"), "key", "left_anti").select(hashed)
    return bitmap(first.select(hashed), bits), bitmap(goes.unionByName(first.where("many").select(hashed)), bits)


GO, STAY, UNSURE = range(3)


def one_of_each(docs: DataFrame, percent: int = 75, width: int = 5, few: int = 16, room: int = 1 << 22, pivots: int = 16, sample: int = 10_000, most_frequent: int = 500_000) -> DataFrame:
    """The row of each class of linked documents that has the smallest doc_id (a null one last), and all rows without words.

    Rows are told apart by their id and a hash of their text: of rows that share an id, each stays or goes with its own class.
    Of rows of one id and text that differ elsewhere, one is kept by a hash of the row.
    """
    taken = list(docs.columns)
    key, row = (free(x, taken) for x in ("_key", "_row"))
    named = lambda id_, h: F.struct(id_.isNull().alias("a"), F.coalesce(id_, F.lit(0)).alias("b"), h.alias("c"))
    with batch_rows(docs.sparkSession):
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
        points, tree = set_classes(rows, percent, width, few, room, pivots, sample, most_frequent)
        full = points.where("n > 0").withColumn("key", named(F.col("id"), F.col("h")))
        # of equal keys the texts are equal, and so are the sets
        first = full.join(tree, "set", "left").groupBy(F.coalesce("c", "set").alias("c")).agg(F.min("key").alias("key")).select("key")
        first = first.join(full.groupBy("key").agg((F.count("*") > 1).alias("many")), "key").transform(saved)
        total = rows.count()
        shared = docs.sparkSession.sparkContext.broadcast(stay_or_go(full, first, total))
        release(docs.sparkSession)
    first = first.select(F.col("key").alias(key), F.col("many").alias(row))

    @F.pandas_udf("int")
    def told(hashes: pd.Series) -> pd.Series:
        stays, goes = (marked(x, hashes.to_numpy()) for x in shared.value)
        return pd.Series(np.where(stays, np.where(goes, UNSURE, STAY), GO).astype(np.int32))

    # as `kernel.word_bounds` has it: a text with a byte that is no white space has a shingle
    has = F.coalesce(F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    ours = docs.withColumn(key, named(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    ours = ours.withColumn(row, F.when(~has, F.lit(STAY)).otherwise(told(F.xxhash64(F.col(key)["a"], F.col(key)["b"], F.col(key)["c"]))))
    # texts move only where the bitmaps leave it open
    kept = ours.where(F.col(row) == STAY).select(taken)
    found = ours.where(F.col(row) == UNSURE).drop(row).join(first.hint("shuffle_hash"), key)
    kept = kept.unionByName(found.where(~F.col(row)).select(taken))
    if not first.where(F.col(row)).isEmpty():
        hashed = F.xxhash64(*[F.col(f.name) for f in docs.schema.fields if not _has_map(f.dataType)])
        some = found.where(F.col(row)).groupBy(key).agg(F.min_by(F.struct(*taken), hashed).alias(row))
        kept = kept.unionByName(some.select(*[F.col(row)[c].alias(c) for c in taken]))
    return kept


def _has_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString()


def set_classes(rows: DataFrame, percent: int, width: int, few: int, room: int, pivots: int, sample: int, most_frequent: int) -> tuple[DataFrame, DataFrame]:
    """id, h, set and n of each row of rows (id, text), h a hash of the text; set and c: the least set of its class, but for that set."""
    rows = rows.withColumn("h", F.xxhash64("text"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = sets_and_sample(rows, width, min(1.0, sample / max(1, rows.count()))).transform(as_parquet, "sets", "kind")
    points = told.where("kind = 0").select("id", "h", "set", "n")

    counts = told.where("kind = 1").groupBy("set").agg(F.sum("n").alias("n")).where("n >= 3").transform(saved)
    keys, n = (c.to_numpy() for c in counts.where(F.col("n") >= threshold(counts, most_frequent)).toArrow().columns)
    by = np.argsort(keys)
    frequent = keys[by], np.minimum(np.log2(n[by]) * 4, 63).astype(np.int64)
    total = points.agg(F.sum("n")).first()[0] or 0
    how = rows, width, percent, frequent, max(4 * parts, math.ceil(total / 1_500_000)), few

    found = regions(*how).transform(as_parquet, "ties")
    pairs, wide = (t.transform(saved) for t in ties(found, percent))
    release(rows.sparkSession)
    first = wide.join(wide.groupBy("cell").agg(F.min("set").alias("least")), "cell").select(F.col("set").alias("u"), F.col("least").alias("v"))
    tied = components(first.unionByName(pairs))
    sets = points.where("n > 0").groupBy("set").agg(F.max("n").alias("n"))
    tied = tied.select(F.col("node").alias("set"), F.col("least").alias("cell")).unionByName(tied.select(F.col("least").alias("set"), F.col("least").alias("cell")).distinct()).join(sets, "set")
    tied = tied.join(tied.groupBy("cell").agg(F.sum("n").alias("w")), "cell").transform(saved)
    release(rows.sparkSession)
    whole = tied.where(F.col("w") <= room).select("cell", "set", "n", F.lit(True).alias("own"), F.col("set").alias("c"))
    tasks = max(parts, math.ceil((whole.agg(F.sum("n")).first()[0] or 0) / room))
    # a component of ties that is one cell has its links' components at once
    links = joined(shapes(rows, whole, width), percent, width, tasks).transform(saved)
    release(rows.sparkSession)
    tree = links.select(F.col("u").alias("set"), F.col("v").alias("c"))
    large = tied.where(F.col("w") > room).select(F.col("cell").alias("whole"), "set", "n", "w").transform(saved)
    if not large.isEmpty():
        cells = large_cells(large, wide, pairs, room).select("cell", F.lit(None).cast("long").alias("old"), "set", "n", F.lit(True).alias("own"))
        few_forms = shapes(rows, large.select("set"), width).transform(saved)
        more = components(_union(cell_links(few_forms, cells, [], percent, width, room, pivots, parts)))
        tree = tree.unionByName(more.select(F.col("node").alias("set"), F.col("least").alias("c")))
    return points, tree


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS shingle FROM p),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
c AS (SELECT a.r AS a, b.r AS b, count(*) AS m FROM s a JOIN s b ON a.shingle = b.shingle AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN d ON d.r = reach.a JOIN d o ON o.r = reach.b LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id, n.n
"""
