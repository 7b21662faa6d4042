"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.shared import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's larger neighbours are tied to the least of its neighbourhood. Small: the others and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = near.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """node and least, the least node of its component, for each node of an edge but the least ones themselves.

    Stars are formed in rounds, of which there are about as many as the logarithm of a component's size, until the sums
    over all edges no longer change. Edges never come to the driver nor into one task.
    """
    edges = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().transform(saved)
    mark = None
    while True:
        edges = _star(_star(edges, True).where("u <> v"), False).transform(saved)
        now = edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("least"))
        mark = now
