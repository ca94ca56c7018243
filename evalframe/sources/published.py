"""Tables that are published whole and once: a Python data source writer with verified files and a commit record."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructField, StructType

from ..functions.text import canonical_json
from .files import open_store, sha256_of

RECORD = "_published.json"
HALVES = ("__published_high", "__published_low")
MODULUS = 1 << 120


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file with size and digest, and the sum of its rows' digests."""

    name: str
    bytes: int
    sha256: str
    rows: int
    content: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, run: str, schema: str) -> None:
        self.path, self.run, self.schema = path.rstrip("/"), run, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        name = f"{self.run}/part-{uuid.uuid4().hex}.parquet"
        store, at = open_store(f"{self.path}/{name}")
        store.create_dir(posixpath.dirname(at), recursive=True)
        rows = content = 0
        writer = None
        try:
            for batch in iterator:
                high, low = (batch.column(batch.schema.get_field_index(h)).to_pylist() for h in HALVES)
                content = (content + (sum(high) << 60) + sum(low)) % MODULUS
                rows += batch.num_rows
                bare = batch.select([n for n in batch.schema.names if n not in HALVES])
                if writer is None:
                    writer = pq.ParquetWriter(at, bare.schema, filesystem=store)
                writer.write_batch(bare)
        finally:
            if writer is not None:
                writer.close()
        if writer is None:  # a task without rows writes no file
            return Part("", 0, "", 0, 0)
        table = pq.ParquetFile(at, filesystem=store)
        if table.metadata.num_rows != rows:
            raise OSError(f"{name} holds {table.metadata.num_rows} of {rows} rows")
        return Part(name, store.get_file_info(at).size, sha256_of(f"{self.path}/{name}"), rows, content)

    def commit(self, messages: list[Part | None]) -> None:
        parts = [m for m in messages if m is not None]
        content, rows = sum(p.content for p in parts) % MODULUS, sum(p.rows for p in parts)
        old = published_record(self.path)
        if old is not None:
            self.abort(messages)
            if (old["content"], old["rows"], old["schema"]) != (f"{content:030x}", rows, self.schema):
                raise FileExistsError(f"{self.path} holds other rows")
            return
        files = [{"name": p.name, "bytes": p.bytes, "sha256": p.sha256, "rows": p.rows} for p in sorted(parts, key=lambda p: p.name) if p.rows]
        record = {"content": f"{content:030x}", "rows": rows, "schema": self.schema, "parts": files}
        store, at = open_store(f"{self.path}/{self.run}.record")
        store.create_dir(posixpath.dirname(at), recursive=True)
        with store.open_output_stream(at) as stream:
            stream.write(json.dumps(record, sort_keys=True).encode())
        store.move(at, posixpath.join(posixpath.dirname(at), RECORD))  # from here on the table is there, whole

    def abort(self, messages: list[Part | None]) -> None:
        store, at = open_store(f"{self.path}/{self.run}")
        if store.get_file_info(at).type == fs.FileType.Directory:
            store.delete_dir(at)
        top = posixpath.dirname(at)
        if store.get_file_info(top).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(top)):
            store.delete_dir(top)


class _Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "evalframe_published"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["run"], self.options["content"])


def published_record(path: str) -> dict | None:
    """The commit record of a published table; None where nothing is published."""
    store, at = open_store(f"{path.rstrip('/')}/{RECORD}")
    if store.get_file_info(at).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(at) as stream:
        return json.loads(stream.read())


def publish(df: DataFrame, path: str) -> str:
    """Write a table once: published, unchanged if the same rows are there, else FileExistsError. df is evaluated once.

    Every task writes one file of a new folder, reads back its row count and digest, and reports these with the sum of its
    rows' digests (so the order and the split into files do not matter, repeated rows do). The commit compares that sum
    with what is published and moves one small record into place; readers follow the record, so they see a whole table or none.
    If a task or the commit fails, the folder goes. A table without rows can be published too.
    """
    spark = df.sparkSession
    spark.dataSource.register(_Published)
    before = published_record(path)
    row = F.md5(canonical_json(**{c: c for c in df.columns}).cast("binary"))
    halves = [F.conv(F.substring(row, begin, 15), 16, 10).cast("long").alias(h) for begin, h in zip((1, 16), HALVES, strict=True)]
    nullable = StructType([StructField(f.name, f.dataType) for f in df.schema.fields])
    writer = df.select("*", *halves).write.format("evalframe_published").option("path", path).option("run", f"v-{uuid.uuid4().hex}").option("content", nullable.json())
    try:
        writer.mode("append").save()
    except Exception as error:
        if "FileExistsError" in str(error):
            raise FileExistsError(f"{path} holds other rows") from error
        raise
    return "published" if before is None else "unchanged"


def _files(path: str, record: dict) -> list[str]:
    return [f"{path.rstrip('/')}/{p['name']}" for p in record["parts"]]


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a published table; FileNotFoundError where nothing is published."""
    record = published_record(path)
    if record is None:
        raise FileNotFoundError(path)
    schema = StructType.fromJson(json.loads(record["schema"]))
    return spark.read.schema(schema).parquet(*_files(path, record)) if record["parts"] else spark.createDataFrame([], schema)


def changed_parts(spark: SparkSession, path: str) -> DataFrame:
    """(name, declared, actual) of the files of a published table that are missing or whose digest is not the recorded one."""
    record = published_record(path)
    if record is None:
        raise FileNotFoundError(path)
    parts = spark.createDataFrame([(p["name"], p["sha256"]) for p in record["parts"]], "name string, declared string")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                try:
                    found.append(sha256_of(f"{path.rstrip('/')}/{name}"))
                except FileNotFoundError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["name", "declared", "actual"])

    return parts.repartition("name").mapInArrow(check, "name string, declared string, actual string").where("NOT declared <=> actual")
