"""Byte ranges of files, local or in an object store, from any task.

Paths without a scheme and file: URIs are opened as local files; s3:, hdfs:, gs: and what else pyarrow knows through its
file systems. Options of a store (endpoint, access_key, secret_key, region, timeout in seconds) are for s3-like ones. A file
in a store that only Spark reads comes through `contents`, whole.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, functions as F

LOCAL = ("", "file")
S3 = ("s3", "s3a", "s3n")


def local_path(path: str) -> str | None:
    """The local path that a path or URI names; None if it is not local."""
    parts = urlparse(path)
    return None if parts.scheme not in LOCAL else unquote(parts.path) if parts.scheme else path


def store(options: dict | None = None):
    """A client of an S3-like object store: endpoint, access_key, secret_key, region and timeout, each with a default."""
    from pyarrow import fs

    options = options or {}
    scheme, _, host = options.get("endpoint", "").rpartition("://")
    wait = float(options.get("timeout", 600))
    given = {"endpoint_override": host or None, "scheme": scheme or None, "access_key": options.get("access_key"), "secret_key": options.get("secret_key"), "region": options.get("region")}
    return fs.S3FileSystem(request_timeout=wait, connect_timeout=wait, **{k: v for k, v in given.items() if v})


def file_system(path: str, options: dict | None = None):
    """(file system, path in it) of a URI that is not local."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in S3:
        return store(options), f"{parts.netloc}{parts.path}"
    return fs.FileSystem.from_uri(path)


class Ranges:
    """read(offset, size) of one file; closed at the end of a with block."""

    def __init__(self, path: str, options: dict | None = None):
        if (local := local_path(path)) is not None:
            self.file = open(local, "rb")
        else:
            system, place = file_system(path, options)
            self.file = system.open_input_file(place)

    def __enter__(self) -> Callable[[int, int], bytes]:
        return self.read

    def __exit__(self, *_) -> None:
        self.file.close()

    def read(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)


def contents(spark: SparkSession, paths: str | list[str], pattern: str = "*.tif") -> DataFrame:
    """path and content of whole files, read by Spark's own file systems, for stores that nothing else reads."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", "content")


def listed(spark: SparkSession, folder: str, pattern: str = "*.tif") -> DataFrame:
    """path and size of the files of a folder, without their content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", F.col("length").alias("size"))
