"""WARC archives: written by Spark's text writer, read by a Python data source.

A record is its header lines, an empty line and Content-Length bytes of payload, ended by two line ends. That end is
the text writer's line separator, so archives are written in the JVM to any file system that Spark knows; they are read
from the stores that open_store knows (local, S3 as s3 or s3a, HDFS, GCS, ABFS). The reader
plans one partition for a run of files, takes predicates on the record type, target and other headers, parses headers
first, and seeks past payloads of records that do not match or whose payload no column needs (in a compressed file,
seeking inflates the bytes but neither copies nor decodes them).
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..sources.files import open_store

END = "\r\n\r\n"
#: Columns of the source and the headers that they come from.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Bytes", "refers_to": "WARC-Refers-To", "content_length": "Content-Length"}
NUMBERS = ("payload_bytes", "content_length")
#: What a compressed file counts as, against plain bytes, when files are dealt into partitions.
INFLATED = 8


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest, record_type, refers_to) for every row of pages.

    Among rows with equal payloads of at least min_bytes bytes, those with the smallest id are responses, the others
    revisits of it; shorter ones are responses. A null payload is empty. Rows that repeat the smallest id are responses
    too; a null id with a repeated payload is a revisit of the smallest. Only digests and ids are shuffled to find out;
    extra columns are not looked at.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)}
    )
    long_ones = rows.where(F.col("payload_bytes") >= min_bytes).select("id", "payload_digest")
    first = long_ones.groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").select("payload_digest", "first")
    again = long_ones.join(first, "payload_digest").where("NOT (id <=> first)").select(F.col("id").alias("again"), F.col("payload_digest").alias("digest"), "first").distinct()
    out = rows.join(again, rows["id"].eqNullSafe(again["again"]) & (rows["payload_digest"] == again["digest"]), "left")
    return out.select("id", "url", "payload", "payload_bytes", "payload_digest", F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("first").alias("refers_to"))


def _clean(value) -> F.Column:
    """A header value stays on its line."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1F\x7F]+", " ")


def write_warc(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", records_per_file: int = 50_000, bytes_per_file: int = 256 << 20, compression: str = "gzip") -> None:
    """Write planned records as WARC/1.0 files under path, compressed unless compression is none. Revisits carry headers only.

    A file holds records_per_file records at most, and either bytes_per_file bytes of payloads at most or one record: records
    are graded by size, each grade with payloads up to twice as long as the one before and half as many to a run. A task
    cuts its rows into such runs by counting them, so no row moves to another task, and each run and grade is a folder.

    Header values stay on one line: control characters become spaces. A null id or url is an empty value; no records
    give a folder without any; repeated records are written as often as they come.
    """
    body = F.when(F.col("record_type") == "revisit", "").otherwise(F.col("payload"))
    lines = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), "record_type"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), _clean(F.col("id")), F.lit(">")),
        F.concat(F.lit(f"WARC-Date: {date}")),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), _clean(F.col("refers_to")), F.lit(">"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), body)
    grade = F.greatest(F.lit(0), F.ceil(F.log2(F.octet_length(body) / (bytes_per_file / records_per_file)))).cast("int")  # log2 of 0 is null
    run = F.greatest(F.lit(1), F.floor(F.lit(records_per_file) / F.pow(F.lit(2), grade)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    cut = F.concat(grade.cast("string"), F.lit("-"), F.floor(place / run).cast("string"))
    records.select(record.alias("value"), cut.alias("run")).write.option("lineSep", END).option("compression", compression).partitionBy("run").text(path)


class _Files(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(0)
        self.files = files


def parse_headers(block: bytes) -> dict[str, str]:
    """Header names in lower case to values; the version line is skipped."""
    pairs = (line.split(b":", 1) for line in block.split(b"\r\n")[1:] if b":" in line)
    return {name.strip().lower().decode(): value.strip().decode("utf-8", "replace") for name, value in pairs}


def read_records(stream, wanted: dict[str, set[str]], payload: bool) -> Iterator[tuple]:
    """Rows of one open file: the HEADERS columns, then the payload or null. wanted: header columns to allowed values."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        block = [line]
        while line.strip():
            line = stream.readline()
            block.append(line)
            if not line:
                raise ValueError("the file ends inside a record's headers")
        found = parse_headers(b"".join(block))
        values = {c: found.get(h.lower()) for c, h in HEADERS.items()}
        length = int(values["content_length"] or 0)
        if any(values[c] not in allowed for c, allowed in wanted.items()):
            stream.seek(stream.tell() + length)  # neither read nor decoded
            continue
        if payload:
            body = stream.read(length)
            if len(body) < length:
                raise ValueError("the file ends inside a payload")
        else:
            stream.seek(stream.tell() + length)
            body = None
        yield (*(None if v is None else int(v) if c in NUMBERS else v for c, v in values.items()), body)


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.schema, self.path, self.target = schema, options["path"], int(options.get("partition_bytes", 128 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.wanted: dict[str, list[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership on header text columns are handled here; the rest is Spark's."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS and name not in NUMBERS:
                allowed = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = sorted(allowed & set(self.wanted.get(name, allowed)))
            else:
                yield f

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        system, top = open_store(self.path)
        found = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and not f.base_name.startswith(("_", ".")))
        parts, size = [[]], 0
        for path, n in found:
            n *= INFLATED if path.endswith(".gz") else 1
            if parts[-1] and size + n > self.target:
                parts.append([])
                size = 0
            parts[-1].append(path)
            size += n
        return [_Files(p) for p in parts if p]

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        if partition is None:  # Spark's call for a folder without files
            return
        system, _ = open_store(self.path)
        wanted = {c: set(v) for c, v in self.wanted.items()}
        for path in partition.files:
            with system.open_input_file(path) as stream:
                plain = gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream
                yield from read_records(io.BufferedReader(plain, 1 << 20), wanted, self.payload)


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); option payload=false leaves payloads out."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ", ".join(f"{c} {'long' if c in NUMBERS else 'string'}" for c in HEADERS) + ", payload binary"

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records under path. Turns on the session's filter pushdown to Python sources, so that later filters reach the reader.

    payload is null with payload=False and empty bytes where a record has none. Headers that a record lacks are null.
    A file that ends within a record or does not start with one raises an error.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
