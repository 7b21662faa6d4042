"""Exact top-k search by inner product over a pivot-distance index.

The greatest inner product is the least distance once every candidate x gets one more coordinate, sqrt(M - |x|^2), with M
the largest squared norm, and every query a 0 there: |q' - x'|^2 = |q|^2 + M - 2 q.x. Vectors are keyed by their nearest
pivot and their distance to it. The distances of a pivot's vectors are counted in `rings` rings (a table of bounded size);
neighbouring rings join into groups of about `group` vectors, and a ring with more is split by a hash of the id, so that
equal vectors cannot fill one task. By the triangle inequality a group can hold nothing nearer than the gap between a
query's distance to the pivot and the group's rings; a query goes to those groups only that its k-th best score in a
bounded sample does not rule out. Within a group annuli are expanded outwards, and a query stops at those that its k-th
best score so far rules out. Scores are whole numbers, exact in double precision up to 2**53.

Edge cases: vectors that are null, or hold null or not finite components, take no part, nor do null ids; shorter (and empty)
vectors count as filled up with 0; rows that share an id count as one query (the least vector) but as several candidates,
and none is a candidate for its own id; ties go to the smaller id; fewer candidates than k give fewer rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.llm.shared import saved

SLACK = 1e-6  # rounding in bounds; scores themselves are exact


def quantized(rows: DataFrame, id_: str, vector: str, factor: float) -> DataFrame:
    """id and q (array<double> of whole numbers) of the rows that take part."""
    v = F.col(vector)
    q = F.transform(v, lambda x: F.floor(F.lit(factor) * x.cast("double")).cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    fit = F.col(id_).isNotNull() & v.isNotNull() & finite
    return rows.where(F.coalesce(fit, F.lit(False))).select(F.col(id_).cast("long").alias("id"), q.alias("q"))


def matrix(col: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, filled up with 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    if len(n) and (n == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.concatenate([np.arange(k) for k in n]) if len(n) else []] = flat
    return out


class Index:
    """Pivots with their added coordinate, M, and the groups: pivot, ring range, number of splits."""

    def __init__(self, sample: np.ndarray, most: float, pivots: int):
        self.most = most
        # farthest-first traversal
        chosen, far = [], None
        for _ in range(min(pivots, len(sample))):
            i = 0 if far is None else int(far.argmax())
            if far is not None and far[i] <= 0:
                break
            chosen.append(i)
            d = ((sample - sample[i]) ** 2).sum(axis=1)
            far = d if far is None else np.minimum(far, d)
        self.pivots = sample[chosen]
        self.norms = (self.pivots**2).sum(axis=1)
        self.extra = np.sqrt(np.maximum(most - self.norms, 0))
        self.scale, self.groups = 1.0, np.zeros((0, 5))

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Distance of each row to each pivot, with the added coordinate."""
        norm = (x**2).sum(axis=1)
        e = 0.0 if query else np.sqrt(np.maximum(self.most - norm, 0))[:, None]
        return np.sqrt(np.maximum(norm[:, None] + self.norms - 2 * x @ self.pivots.T + (e - self.extra) ** 2, 0))

    def keys(self, x: np.ndarray, rings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, distance to it and ring of each row."""
        d = self.distances(x, False)
        p = d.argmin(axis=1)
        d = d[np.arange(len(x)), p]
        return p, d, np.minimum((d / self.scale * rings).astype(np.int64), rings - 1)


def topk(vectors: DataFrame, is_query, k: int = 5, id_: str = "vec_id", vector: str = "embedding", factor: float = 256.0, pivots: int = 16, sample: int = 1024, rings: int = 64, group: int = 16384, queries: int = 16384) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query. is_query: a condition on the column id."""
    spark = vectors.sparkSession
    rows = quantized(vectors, id_, vector, factor)
    norm = F.aggregate("q", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.max(F.size("q")).alias("width"), F.max(norm).alias("most")).first()
    schema = "query_id long, vec_id long, score long"
    width, asked = stats.width or 1, rows.where(is_query).groupBy("id").agg(F.min("q").alias("q"))
    taken = rows.orderBy(F.xxhash64("id", "q"), "id").limit(sample).toArrow()
    index = Index(matrix(taken.column("q"), width), stats.most or 0.0, pivots)
    sample_ids, sample_x = taken.column("id").to_numpy(), matrix(taken.column("q"), width)
    if not len(sample_x):
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    # no distance is larger than this
    index.scale = 2 * np.sqrt(index.most) + 1

    def cells(batches):
        for b in batches:
            p, _, r = index.keys(matrix(b.column(0), width), rings)
            both, n = np.unique(p * rings + r, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both), pa.array(n)], ["cell", "n"])

    # at most pivots * rings rows
    counted = rows.select("q").mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").collect()
    groups: list[list[int]] = []  # pivot, first ring, last ring, rows
    for c in counted:
        p, r = divmod(c.cell, rings)
        if groups and groups[-1][0] == p and groups[-1][3] + c.n <= group:
            groups[-1][2], groups[-1][3] = r, groups[-1][3] + c.n
        else:
            groups.append([p, r, r, c.n])
    pivot, low, high, size = np.array(groups, np.int64).T
    splits = -(-size // group)
    first = np.concatenate([[0], np.cumsum(splits)])
    group_of = np.zeros(pivots * rings, np.int64)
    for i, (p, a, b) in enumerate(zip(pivot, low, high)):
        group_of[p * rings + a : p * rings + b + 1] = i
    lo, hi = low / rings * index.scale, (high + 1) / rings * index.scale
    parts = max(1, -(-asked.count() // queries))
    names = ["key", "query", "id", "d", "limit", "x"]
    kind = pa.list_(pa.float64())

    def record(key, query, ids, d, limit, x):
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), query)), pa.array(ids), pa.array(d), pa.array(limit), flat.cast(kind)], names)

    def place_candidates(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), width)
            p, d, r = index.keys(x, rings)
            g = group_of[p * rings + r]
            split = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % splits[g]
            yield record(first[g] + split, False, ids, d, np.zeros(len(ids)), x)

    def place_queries(batches):
        for b in batches:
            ids, x = b.column(0).to_numpy(), matrix(b.column(1), width)
            s = x @ sample_x.T
            s[ids[:, None] == sample_ids] = -np.inf
            limit = np.sort(s, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(x), -np.inf)
            d = index.distances(x, True)
            part = ids % parts
            for g in range(len(pivot)):
                own = d[:, pivot[g]]
                gap = np.maximum(np.maximum(lo[g] - own, own - hi[g]), 0)
                best = ((x**2).sum(axis=1) + index.most - gap**2) / 2
                go = np.flatnonzero(best * (1 + SLACK) + 1 >= limit)
                if len(go):
                    for s_ in range(int(splits[g])):
                        yield record((first[g] + s_) * parts + part[go], True, ids[go], own[go], limit[go], x[go])

    def search(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        ids, d, x = table.column("id").to_numpy(), table.column("d").to_numpy(), matrix(table.column("x"), width)
        limit = table.column("limit").to_numpy()[query]
        at = np.flatnonzero(~query)
        at = at[np.lexsort((ids[at], d[at]))]
        ids_q, d_q, x_q, ids, d, x = ids[query], d[query], x[query], ids[at], d[at], x[at]
        room = (x_q**2).sum(axis=1) + index.most
        found = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]  # query number, score, candidate's id
        step = 512
        annuli = [(a, min(a + step, len(ids))) for a in range(0, len(ids), step)]
        middle = np.median(d_q) if len(d_q) else 0
        for a, b in sorted(annuli, key=lambda s: max(d[s[0]] - middle, middle - d[s[1] - 1], 0)):
            gap = np.maximum(np.maximum(d[a] - d_q, d_q - d[b - 1]), 0)
            go = np.flatnonzero((room - gap**2) / 2 * (1 + SLACK) + 1 >= limit)
            if not len(go):
                continue
            s = x_q[go] @ x[a:b].T
            s[ids_q[go][:, None] == ids[a:b]] = -np.inf
            i, j = np.nonzero((s >= limit[go][:, None]) & np.isfinite(s))
            found = [np.concatenate(c) for c in zip(found, (go[i], s[i, j], ids[a:b][j]))]
            order = np.lexsort((found[2], -found[1], found[0]))
            n = found[0][order]
            rank = np.arange(len(n)) - np.searchsorted(n, n)
            order = order[rank < k]
            found = [c[order] for c in found]
            last = np.flatnonzero(rank[rank < k] == k - 1)
            limit[found[0][last]] = np.maximum(limit[found[0][last]], found[1][last])
        return pa.table({"query_id": ids_q[found[0]], "vec_id": found[2], "score": found[1].astype(np.int64)})

    shape = "key long, query boolean, id long, d double, limit double, x array<double>"
    placed = asked.mapInArrow(place_queries, shape)
    # a group of candidates goes to the parts of the queries that reach it, and nowhere if none does
    reached = placed.select(F.floor(F.col("key") / parts).alias("part"), F.col("key").alias("to")).distinct().transform(saved)
    candidates = rows.mapInArrow(place_candidates, shape).join(reached, F.col("key") == F.col("part")).drop("key", "part").withColumnRenamed("to", "key")
    dealt = candidates.select(*names).unionByName(placed)
    best = dealt.groupBy("key").applyInArrow(search, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda t: coalesce(t[1], 0) * coalesce(t[2], 0))), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
