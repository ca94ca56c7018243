"""Telemetry lines from a stream to two tables: what can be used, and what cannot with its file, line and reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import located_lines, with_line_numbers
from .telemetry import EVENT, parsed_events

QUARANTINE = "file string, line_no long, line string, reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_batch(df: DataFrame, sink: str, batch: int) -> bool:
    """Write df as the folder of one batch, once: a batch that was committed before stays as it is. Whether it was written now."""
    target = f"{sink.rstrip('/')}/batch={batch}"
    if _exists(df.sparkSession, f"{target}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(target)
    return True


def committed(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """The rows of all committed batches of a sink, with their batch; none if nothing is written yet."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sink)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath().toString() for s in files.listStatus(root) if s.isDirectory()] if files.exists(root) else []
    done = [f for f in folders if "/batch=" in f and _exists(spark, f"{f}/_SUCCESS")]
    if not done:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").option("basePath", sink).parquet(*done)


def _to_both(good: str, quarantine: str, late: str) -> Callable[[DataFrame, int], None]:
    def write(lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        marks = f"{good.rstrip('/')}/_marks"
        seen = committed(spark, marks, "latest timestamp").where(F.col("batch") < batch).agg(F.max("latest")).first()[0]  # one value
        rows = parsed_events(with_line_numbers(lines)).persist()
        try:
            if seen is None:
                reason = F.col("reason")
            else:
                behind = F.col("e.timestamp") < F.lit(seen) - F.expr(f"INTERVAL {late}")
                reason = F.coalesce("reason", F.when(behind, F.lit("late")))
            rows_ = rows.withColumn("why", reason)
            write_batch(rows_.where("why IS NULL").select("e.*").select(*EVENT.fieldNames()), good, batch)
            write_batch(rows_.where("why IS NOT NULL").select("file", "line_no", F.col("value").alias("line"), F.col("why").alias("reason")), quarantine, batch)
            write_batch(rows.where("reason IS NULL").agg(F.max("e.timestamp").alias("latest")), marks, batch)
        finally:
            rows.unpersist()

    return write


def ingest(spark: SparkSession, path: str, good: str, quarantine: str, checkpoint: str, late: str = "10 minutes") -> StreamingQuery:
    """Read telemetry lines from new files below path, to the end of the input, into good and quarantine (QUARANTINE).

    A line goes to quarantine if it is not valid JSON for an event, lacks timestamp or request_id, or is late: its time is
    more than late before the latest event of earlier batches. A file is read whole in one batch, so line numbers are exact.

    Both sinks hold one folder for each batch. After a failure the same batch comes again with the same lines, and a folder
    that was committed is left alone, so no row is lost or there twice: read both with committed(). What is late depends on
    earlier batches alone, and their latest times are kept beside the good rows.
    """
    lines = located_lines(spark, path, stream=True)
    return lines.writeStream.foreachBatch(_to_both(good, quarantine, late)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
