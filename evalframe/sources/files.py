"""Files of any size, opened by tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemes under which Spark and Arrow know the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}
CHUNK = 8 << 20


def arrow_uri(path: str) -> str:
    """A path of Spark's as a URI of Arrow's: s3a becomes s3, a path without a scheme is local."""
    scheme = urlparse(path).scheme
    if not scheme:
        return f"file://{path}"
    return f"{SCHEMES[scheme]}{path[len(scheme):]}" if scheme in SCHEMES else path


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) for a path of Spark's, local, on S3, HDFS, GCS or ABFS; ValueError for any other scheme."""
    uri = arrow_uri(path)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as error:
        raise ValueError(f"tasks cannot open {urlparse(path).scheme} files: {path}") from error


def sha256_of(path: str, chunk: int = CHUNK) -> str:
    """Lowercase hex SHA-256 of a file, read in chunks."""
    store, at = open_store(path)
    digest = hashlib.sha256()
    with store.open_input_stream(at) as stream:
        while data := stream.read(chunk):
            digest.update(data)
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([sha256_of(path)])], names=["path", "bytes", "sha256"])


def file_digests(spark: SparkSession, path: str, large: int = 1 << 30) -> DataFrame:
    """(path, bytes, sha256) of every file below path, of any size.

    Files up to large bytes are read by Spark, on any file system that it knows; larger ones are streamed through tasks in
    chunks, one file a task at a time, from the stores of open_store. An empty folder has no rows.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = every.where(F.col("length") <= large).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    big = every.where(F.col("length") > large).select("path", "length").repartition("path")
    return small.unionByName(big.mapInArrow(_digests, "path string, bytes bigint, sha256 string"))
