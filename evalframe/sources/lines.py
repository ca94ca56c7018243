"""Lines of text files with their numbers, whatever the size of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """(file, line_no, value) of lines (value, file, block), read by located_lines or from a stream's batch.

    Large files are read in splits. A split's rows have ascending row ids, so a line's number is its distance from the
    split's first row plus the lines of the splits before it: one small row a split is summed, no file passes one task.
    """
    rows = lines.withColumn("__row", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "block").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "block", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__start"))
    return rows.join(starts, ["file", "block"]).select("file", (F.col("__row") + F.col("__start")).alias("line_no"), *(c for c in lines.columns if c not in ("file", "block")))


def located_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(value, file, block): every line that LF ends, unchanged, its file and the first byte of its split."""
    reader = (spark.readStream if stream else spark.read).format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    return reader.load(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of every line of the files below path. An empty file has no lines."""
    return with_line_numbers(located_lines(spark, path))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files below path, empty ones too; contents are not read.

    Spark's scans leave out empty files, so these come from its listing, which the driver has for any scan.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    sizes = found.select(F.col("_metadata.file_path").alias("file"), "length")
    names = [f"file:/{f.removeprefix('file:///')}" if f.startswith("file:///") else f for f in found.inputFiles()]  # as file_path spells it
    listed = spark.createDataFrame([(f,) for f in names], "file string")
    return listed.join(sizes, "file", "left").select("file", F.coalesce("length", F.lit(0)).alias("length"))
