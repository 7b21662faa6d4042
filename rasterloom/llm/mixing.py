"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. Within a source every document is expected r = target / size times; the
expected copies are added up along the source's documents, one random offset (drawn by a seed for each source) is added, and a document is emitted once for
each whole number that its step crosses. So a document gets floor(r) or ceil(r) copies, and a source's total differs from
its target by little. Documents stand by falling size, which stratifies the sample: copies differ by at most one between
neighbours, so the words taken differ from the target by less than the largest document.

The running number of a document within its source needs no group in one task: rows are dealt by ranges of (source,
size, id), counted by range and source, and numbered within a range.

Edge cases: a null text has no words; a null source is a source, the last one; sources without words have target 0 and
keep their documents (rate 1: they change no word count); rows that are alike in source, size and id (repeated rows, null
ids) share their copies evenly; an empty table gives an empty result; extra columns, whatever their names, are kept by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.llm.shared import free, saved

WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def capped_targets(sizes: dict, weights=(5, 2, 1), most: int = 3) -> dict:
    """Target of each source: shares by weight of all sizes, at most `most` times its own, the excess shared again.

    The sources that reach their limit are those with the smallest limit per weight; with these full, the rest share
    what is left by weight.
    """
    # code-point order equals UTF-8 byte order
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    rows = sorted((most * sizes[s] / weights[i % len(weights)], i, s, most * sizes[s], weights[i % len(weights)]) for i, s in enumerate(order) if sizes[s])
    left, weight, out = sum(sizes.values()), sum(r[4] for r in rows), {s: 0.0 for s in sizes}
    for ratio, _, s, limit, w in rows:
        if ratio <= left / weight:
            out[s] = float(limit)
            left, weight = left - limit, weight - w
        else:
            out[s] = w * (left / weight)
    return out


def deal(rows: DataFrame, group: str, order: list) -> DataFrame:
    """rows, written to the checkpoint folder, dealt by ranges of (group, order), with their range in _part.

    Two checkpoints: the deal reads its input twice (to find the ranges), and a later read must find the same ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.transform(saved).repartitionByRange(n, F.col(group).asc_nulls_last(), *order).withColumn("_part", F.spark_partition_id()).transform(saved)


def number(dealt: DataFrame, group: str, order: list, name: str = "number") -> DataFrame:
    """Dealt rows with their running number (from 1) within group, in order; no group meets in one task."""
    w = Window.partitionBy("_g").orderBy("_p")
    # one row for each range and group that meet: at most as many as ranges and groups together
    before = dealt.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    before = before.select("_p", "_g", (F.sum("_n").over(w) - F.col("_n")).alias("_before"))
    inside = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)))
    joined = inside.join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(name, F.col("_before") + F.col("_i")).drop("_part", "_p", "_g", "_before", "_i")


def offset_of(source: Column, seed: str) -> Column:
    """A number in [0, 1) drawn for a source: the first 32 bits of a digest of the seed and the source."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")), F.when(source.isNull(), "null").otherwise("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def alike(id_: Column, source: Column, size: Column) -> Column:
    """What rows alike in source, size and doc_id have in common, without nulls."""
    parts = [F.coalesce(id_, F.lit(0)), F.coalesce(source, F.lit("")), size, id_.isNull(), source.isNull()]
    return F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])


def copies(docs: DataFrame, weights=(5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and copies of every row of docs. seed: for the sources' random offsets.

    One row for each source comes to the driver.
    """
    order = [F.desc("size"), F.asc_nulls_last("doc_id")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size"))
    dealt = deal(rows, "source", order)
    sizes = {r.source: r.s for r in dealt.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    targets = capped_targets(sizes, weights, most)
    rates = docs.sparkSession.createDataFrame([(s, n, targets[s]) for s, n in sizes.items()], "_s string, source_size long, target double")
    rates = rates.withColumn("_offset", offset_of(F.col("_s"), seed))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    step = lambda k: F.floor(k * rate + F.col("_offset"))
    rows = number(dealt, "source", order).join(rates, F.col("source").eqNullSafe(F.col("_s")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (step(F.col("number")) - step(F.col("number") - 1)).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs, each row as often as it has copies. Rows alike in source, size and doc_id share their copies evenly."""
    names = list(docs.columns)
    key, got, part, again = (free(x, names) for x in ("_key", "_got", "_part_of", "_again"))
    taken = copies(docs, **how).groupBy(alike(F.col("doc_id"), F.col("source"), F.col("size")).alias(key))
    taken = taken.agg(F.struct(F.sum("copies").alias("copies"), F.count("*").alias("rows")).alias(got)).transform(saved)
    rows = docs.withColumn(key, alike(F.col("doc_id").cast("long"), F.col("source").cast("string"), n_words("text"))).join(taken, key)
    one = rows.where(F.col(f"{got}.rows") == 1).select(*names, F.col(f"{got}.copies").alias(got))
    some = rows.where(F.col(f"{got}.rows") > 1)
    if not taken.where(F.col(f"{got}.rows") > 1).isEmpty():
        # numbered by ranges, so that rows that are alike need not meet in one task
        plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
        whole = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("row")
        tied = deal(some.select(F.to_json(key).alias("key"), F.col(got).alias("got"), F.xxhash64(*plain).alias("h"), whole), "key", [F.asc("h")])
        tied = number(tied, "key", [F.asc("h")], part)
        share = lambda i: F.floor(i * F.col("got.copies") / F.col("got.rows"))
        tied = tied.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], (share(F.col(part)) - share(F.col(part) - 1)).alias(got))
        one = one.unionByName(tied)
    return one.where(F.col(got) > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(got).cast("int")))).select(names)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS pos
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap,
         (sum(source_size) OVER ())::BIGINT - coalesce((sum(3 * source_size) OVER before)::BIGINT, 0) AS rest,
         (sum(w) OVER ())::BIGINT - coalesce((sum(w) OVER before)::BIGINT, 0) AS rest_w
  FROM s WHERE source_size > 0
  WINDOW before AS (ORDER BY 3 * source_size / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), c AS (SELECT *, cap / w <= rest / rest_w AS is_full FROM o),
f AS (SELECT arg_min(rest / rest_w, cap / w) AS level FROM c WHERE NOT is_full),
t AS (
  SELECT s.source, s.source_size, CASE WHEN c.source_size IS NULL THEN 0.0::DOUBLE WHEN c.is_full THEN c.cap::DOUBLE ELSE s.w * f.level END AS target
  FROM s LEFT JOIN c ON s.source IS NOT DISTINCT FROM c.source CROSS JOIN f
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
         ('0x' || substr(md5('mix' || coalesce(d.source, 'null')), 1, 8))::BIGINT / 4294967296::DOUBLE AS shift,
         row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) AS number
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       ((floor(number * rate + shift) - floor((number - 1) * rate + shift))::BIGINT * size)::BIGINT AS taken
FROM r
"""
