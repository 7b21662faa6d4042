"""Requests as a stream: each batch computes only the tiles that the store does not have yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.operators.match import missing

KEY = ["layer_id", "zoom", "col", "row"]


def incremental(requests: DataFrame, compute: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts a query that appends compute(missing requests) to the store, a Parquet table with the KEY columns that is
    partitioned by layer_id and zoom: a batch reads only the partitions that it asks about."""

    def batch(df: DataFrame, _: int) -> None:
        wanted = df.select(*KEY).distinct().persist()
        try:
            stored = df.sparkSession.read.schema(", ".join(f"{n} {k}" for n, k in wanted.dtypes)).parquet(store)
            # few layers and zooms in a batch; as a join, Spark prunes the store's partitions by them
            stored = stored.join(F.broadcast(wanted.select(*KEY[:2]).distinct()), KEY[:2], "left_semi")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            stored = wanted.limit(0)
        compute(missing(wanted, stored, KEY)).write.mode("append").partitionBy(*KEY[:2]).parquet(store)
        wanted.unpersist()

    writer = requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
