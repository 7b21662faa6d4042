"""The folder that driver and executors share, for tables between steps."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a temporary one in local mode, as in tests, else an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rasterloom-"))
    return context.getCheckpointDir()


def free(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it, so that no column in taken is called so, whatever its case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int = 2000):
    """Fewer rows of text at once between Spark and Python, for the memory of executors, in plans made inside.

    Never more than before; the session's setting is restored.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, rows if before <= 0 else min(before, rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trimmed(run):
    """run, a function of batches, that gives the memory it no longer uses back when a task ends: workers live on."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return wrapped


def saved(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut from its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that are done; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_written: list[str] = []


def clear(spark: SparkSession) -> None:
    """Deletes what `as_parquet` has written; to be called once results that are read from it have been stored."""
    jvm = spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder, which `clear` deletes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def as_parquet(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder (in a part for each value of `by`) and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)
