"""Strict JSON lines and JSON artifacts, canonical sinks, evidence indexes and locks."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import canonical_json
from ..operators.contracts import strict_json
from ..operators.dataset import full_diff
from .files import file_digests
from .lines import file_sizes, numbered_lines

MAX_LINE, MAX_FILE = 64 << 10, 64 << 20


def read_strict_jsonl(spark: SparkSession, path: str, schema: StructType | str, max_line: int = MAX_LINE, max_file: int | None = None, blank_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good rows with file and line_no, problems as file, line_no, reason).

    A file must be UTF-8, not empty, ended by LF and, with max_file, at most so large; a line at most max_line bytes and exactly
    one JSON object without repeated or unknown keys. Nothing of a file that breaks a file's rule is good. Files are read in
    splits, so one of any size is read in parallel, and lines still carry their numbers.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines, sizes = numbered_lines(spark, path), file_sizes(spark, path)
    facts = lines.groupBy("file").agg(F.sum(F.octet_length("value") + 1).alias("bytes"), F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    large = F.lit(False) if max_file is None else F.col("length") > max_file
    whole = sizes.join(facts, "file", "left").select("file", F.when(large, "file too large").when(F.col("length") == 0, "empty file").when(~F.col("valid"), "not UTF-8").when(F.col("bytes") != F.col("length"), "no line end at the end").alias("reason"))
    bad_files = whole.where("reason IS NOT NULL").select("file", F.lit(None).cast("long").alias("line_no"), "reason")
    lines = lines.withColumnRenamed("value", "line").join(bad_files.select("file"), "file", "left_anti")
    if blank_lines:
        lines = lines.where(F.btrim("line") != "")
    value = strict_json("line")
    unknown = F.size(F.array_except(F.map_keys(F.col("v").cast("map<string,variant>")), F.array(*map(F.lit, kind.fieldNames())))) > 0
    read = lines.withColumn("v", value).withColumn("reason", F.when(F.octet_length("line") > max_line, "line too long").when(F.btrim("line") == "", "blank line").when(F.col("v").isNull(), "not one JSON object").when(unknown, "unknown key"))
    good = read.where("reason IS NULL").select("file", "line_no", F.from_json("line", kind).alias("r")).select("file", "line_no", "r.*")
    return good, bad_files.unionByName(read.where("reason IS NOT NULL").select("file", "line_no", "reason"))


def read_json_object(spark: SparkSession, path: str, schema: StructType | str, max_file: int = MAX_FILE) -> DataFrame:
    """One JSON object from each file; fails on anything else. Larger files are refused before they are read."""
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > max_file).select("path").limit(1).collect()
    if large:
        raise ValueError(f"{large[0][0]} is above {max_file} bytes")
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def write_canonical_jsonl(df: DataFrame, path: str, order_by: str | None = None) -> None:
    """One canonical object a line: sorted keys, no spaces, nulls kept. Refuses to write nothing or over something."""
    if df.isEmpty():
        raise ValueError("no rows to write")
    out = df.orderBy(order_by) if order_by else df
    out.select(canonical_json(**{c: c for c in df.columns}).alias("value")).write.mode("errorifexists").text(path)


def _below(path: str):
    """A file's path below a folder, from Spark's full path of the file."""
    root = (urlparse(path).path or path).rstrip("/")
    return F.split("path", rf"\Q{root}/\E", 2)[1]


def write_evidence_index(spark: SparkSession, path: str, index: str) -> None:
    """Lines of digest, two spaces and the path below the folder, by path."""
    found = file_digests(spark, path).select(_below(path).alias("name"), "sha256")
    found.orderBy("name").select(F.concat("sha256", F.lit("  "), "name").alias("value")).write.mode("errorifexists").text(index)


def verify_evidence_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Files that are missing, extra or changed against an index: (name, status, declared, actual)."""
    declared = spark.read.text(index).select(F.substring("value", 67, 1_000_000).alias("name"), F.substring("value", 1, 64).alias("sha256"))
    return full_diff(declared, file_digests(spark, path).select(_below(path).alias("name"), "sha256"), ["name"], "sha256")


def manifest_splits(manifest: DataFrame) -> DataFrame:
    """One row for each split of a manifest read as one object."""
    return manifest.select("dataset_name", "dataset_version", F.explode("splits").alias("s")).select("dataset_name", "dataset_version", "s.*")


def lock_differences(manifest: DataFrame, lock: DataFrame, fields: tuple[str, ...] = ("file", "count", "sha256", "fingerprint_sha256")) -> DataFrame:
    """(field, declared, actual) where the lock of a split differs from the manifest."""
    long = lambda d: d.select("split", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields))).alias("x")).select("split", "x.*")
    return full_diff(long(lock), long(manifest.join(lock.select("split"), "split", "left_semi")), ["split", "field"], "value")
