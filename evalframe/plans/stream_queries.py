"""Registered queries of streams in event time and of numbered lines, each with the SQL that checks it.

Each stream runs three times over one checkpoint: events of the first half of the time, of the second, and then every
fiftieth event, which is late by then unless it belongs to the last hour.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.lines import numbered_lines
from ..sources.shared import new_folder
from ..streaming import ingest, retention, telemetry
from . import derived
from .queries import QUERIES, query  # noqa: F401  (adds to them)

DELAY = "1 hour"
#: The same in SQL: on-time events, and the watermark after them.
ARRIVED = "o AS (SELECT * FROM events WHERE event_id % 50 <> 7), w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM o)"


def _in_parts(rows: DataFrame, write: Callable[[DataFrame], None], start: Callable[[], StreamingQuery]) -> None:
    number = F.col("request_id").cast("long")
    first, last = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    middle = first + (last - first) / 2 if first is not None else None
    for part in (rows.where((number % 50 != 7) & (F.col("timestamp") < F.lit(middle))), rows.where((number % 50 != 7) & (F.col("timestamp") >= F.lit(middle))), rows.where(number % 50 == 7)):
        write(part)
        start().awaitTermination()


def _to_table(stream: DataFrame, out: str, state: str) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()


@query(f"""WITH {ARRIVED}, e AS (SELECT event_type AS key, ts, event_id::VARCHAR AS request_id, date_trunc('day', ts) + INTERVAL 1 DAY AS until FROM o),
d AS (SELECT DISTINCT key, until FROM e, w WHERE until <= mark),
r AS (SELECT d.key, d.until, row_number() OVER (PARTITION BY d.key, d.until ORDER BY ts DESC, request_id DESC) AS rank, request_id FROM d JOIN e ON e.key = d.key AND e.ts < d.until)
SELECT key, until, rank::INT AS rank, request_id FROM r WHERE rank <= 20""")
def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty events of each type at the end of each day, kept by a stream in bounded state."""
    source, out, state = (new_folder(spark, n) for n in ("arrivals", "snapshots", "state"))
    rows = derived.events(spark, sf_dir).select("timestamp", "request_id", "model_selected")

    def start() -> StreamingQuery:
        return _to_table(retention.retained(spark.readStream.schema(rows.schema).parquet(source), 20, every_seconds=86_400, late=DELAY, salts=2), out, state)

    _in_parts(rows, lambda part: part.write.mode("append").parquet(source), start)
    found = retention.last_of(spark.read.schema(retention.SNAPSHOT).parquet(out), 20)
    return found.select("key", F.col("until").cast("timestamp_ntz").alias("until"), "rank", "request_id")


@query(f"""WITH {ARRIVED}, e AS (SELECT *, date_trunc('day', ts) AS day FROM o),
t AS (SELECT day, event_type, count(*) AS events, avg((event_type = 'error')::INT) AS error_rate, avg((event_id % 4 = 0)::INT) AS fallback_rate, avg(value) AS avg_latency_ms FROM e, w WHERE day + INTERVAL 1 DAY <= mark GROUP BY ALL)
SELECT day AS window_start, event_type AS model_selected, events, round(error_rate, 6) AS error_rate, round(fallback_rate, 6) AS fallback_rate, round(avg_latency_ms, 6) AS avg_latency_ms, true AS p50_within, true AS p95_within FROM t""")
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup in append mode: each day once its watermark has passed, without late events; percentiles within 1 % of rank."""
    source, out, state = (new_folder(spark, n) for n in ("arrivals", "windows", "state"))
    rows = derived.events(spark, sf_dir)
    schema = telemetry.rollup(rows, "1 day").schema

    def start() -> StreamingQuery:
        return _to_table(telemetry.rollup(spark.readStream.schema(rows.schema).parquet(source), "1 day", DELAY), out, state)

    _in_parts(rows, lambda part: part.write.mode("append").parquet(source), start)
    windows = spark.read.schema(schema).parquet(out)
    exact = rows.where("CAST(request_id AS BIGINT) % 50 <> 7").select(F.date_trunc("day", "timestamp").alias("window_start"), "model_selected", "latency_ms")
    ranks = exact.join(windows.select("window_start", "model_selected", "p50_latency_ms", "p95_latency_ms"), ["window_start", "model_selected"]).groupBy("window_start", "model_selected").agg(*(
        ((F.avg((F.col("latency_ms") < F.col(f"{p}_latency_ms")).cast("double")) <= s + 0.01) & (F.avg((F.col("latency_ms") <= F.col(f"{p}_latency_ms")).cast("double")) >= s - 0.01)).alias(f"{p}_within") for p, s in (("p50", 0.5), ("p95", 0.95))))
    kept = windows.select("window_start", "model_selected", "events", "error_rate", "fallback_rate", "avg_latency_ms")
    return kept.join(ranks, ["window_start", "model_selected"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT date_trunc('month', ts) AS month, event_type AS model_selected, count(*) AS events, round(avg((event_type = 'error')::INT), 6) AS error_rate, round(avg(value), 6) AS avg_latency_ms, true AS p50_within FROM events GROUP BY 1, 2""")
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows and their sketches merged to months, against exact ranks."""
    rows = derived.events(spark, sf_dir)
    month = F.date_trunc("month", "window_start").alias("month")
    months = telemetry.merged(telemetry.rollup(rows, "1 hour"), [month, "model_selected"])
    exact = rows.select(F.date_trunc("month", "timestamp").alias("month"), "model_selected", "latency_ms").join(months.select("month", "model_selected", "p50_latency_ms"), ["month", "model_selected"])
    below = exact.groupBy("month", "model_selected").agg(F.avg((F.col("latency_ms") < F.col("p50_latency_ms")).cast("double")).alias("below"), F.avg((F.col("latency_ms") <= F.col("p50_latency_ms")).cast("double")).alias("upto"))
    out = months.join(below, ["month", "model_selected"]).withColumn("p50_within", (F.col("below") <= 0.51) & (F.col("upto") >= 0.49))
    return out.select(F.col("month").cast("timestamp_ntz").alias("month"), "model_selected", "events", "error_rate", "avg_latency_ms", "p50_within")


def _numbered(rows: DataFrame, line) -> DataFrame:
    """Lines that begin with their own number in their file, as each task writes one file."""
    return rows.select(F.concat(((F.monotonically_increasing_id() % (1 << 33)) + 1).cast("string"), F.lit(" "), line).alias("value"))


@query("SELECT event_id, true AS right_number FROM events")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files that say their own number, read back in splits."""
    path = new_folder(spark, "lines")
    _numbered(derived.table(spark, sf_dir, "events").repartition(3), F.col("event_id").cast("string")).write.text(path)
    parts = F.split("value", " ")
    return numbered_lines(spark, path).select(parts[1].cast("long").alias("event_id"), (parts[0].cast("long") == F.col("line_no")).alias("right_number"))


@query(f"""WITH {ARRIVED}, e AS (SELECT event_id, CASE WHEN event_id % 7 = 1 THEN 'not valid JSON for an event' WHEN event_id % 7 = 2 THEN 'timestamp or request_id is missing' WHEN event_id % 50 = 7 AND ts < m.mark THEN 'late' END AS reason
  FROM events, (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM o WHERE event_id % 7 NOT IN (1, 2)) m)
SELECT event_id, coalesce(reason, 'good') AS outcome, CASE WHEN reason IS NOT NULL THEN true END AS right_number FROM e WHERE coalesce(reason, '') <> 'timestamp or request_id is missing'
UNION ALL SELECT NULL, reason, true FROM e WHERE reason = 'timestamp or request_id is missing'""")
def quarantined_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry lines streamed to two tables: good events; broken, incomplete and late ones with reason and line number."""
    source, good, bad, state = (new_folder(spark, n) for n in ("telemetry", "good", "quarantine", "state"))
    number = F.col("request_id").cast("long")

    def write(part: DataFrame) -> None:
        whole = F.to_json(F.struct(*telemetry.EVENT.fieldNames()), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        place = F.concat(F.lit(',"at":'), ((F.monotonically_increasing_id() % (1 << 33)) + 1).cast("string"), F.lit("}"))
        text = F.when(number % 7 == 1, F.concat(F.lit('{"request_id":"'), "request_id", F.lit('","timestamp":{'))).when(number % 7 == 2, F.lit('{"status":"ok"')).otherwise(F.substring(whole, F.lit(1), F.length(whole) - 1))
        part.repartition(2).select(F.concat(text, place).alias("value")).write.mode("append").text(source)

    _in_parts(derived.events(spark, sf_dir), write, lambda: ingest.ingest(spark, source, good, bad, state, DELAY))
    fine = ingest.committed(spark, good, telemetry.EVENT.toDDL()).select(F.col("request_id").cast("long").alias("event_id"), F.lit("good").alias("outcome"), F.lit(None).cast("boolean").alias("right_number"))
    said = F.regexp_extract("line", '"at":([0-9]+)', 1).try_cast("long")
    rest = ingest.committed(spark, bad, ingest.QUARANTINE).select(F.regexp_extract("line", '"request_id":"([0-9]+)"', 1).try_cast("long").alias("event_id"), F.col("reason").alias("outcome"), (said == F.col("line_no")).alias("right_number"))
    return fine.unionByName(rest)
