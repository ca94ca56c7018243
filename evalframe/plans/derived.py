"""Evaluation tables derived from the driver's tables by plain arithmetic, alike in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scoring import score_items

SPLIT = "CASE WHEN {k} % 9 < 5 THEN 'train' WHEN {k} % 9 = 5 THEN 'validation' WHEN {k} % 9 < 8 THEN 'test' ELSE 'adversarial' END"
LABELS = ["0", "1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule's prediction; every 20th row is an error, the next one invalid."""
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang AS slice", "CAST(n_chars >= 300 AS INT) AS predicted_quality",
        "CAST(contains(lower(text), 'idiot') OR contains(lower(text), 'moron') OR contains(lower(text), 'scum') AS INT) AS predicted_toxic",
    )
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS expected_quality", "toxic AS expected_toxic")
    return docs.join(labels, "doc_id").selectExpr(
        "*", SPLIT.format(k="doc_id") + " AS split", "doc_id % 20 = 0 AS is_error", "doc_id % 20 = 1 AS is_invalid",
        "CAST((doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS confidence", "CAST((doc_id * 37) % 500 + 10 AS DOUBLE) AS latency_ms",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_items(cases(spark, sf_dir), ["quality", "toxic"], F.col("is_error"), F.col("is_invalid"))


ITEMS_SQL = """
cases AS (SELECT d.doc_id, d.lang AS slice, l.quality AS expected_quality, l.toxic AS expected_toxic, (n_chars >= 300)::INT AS predicted_quality,
  (contains(lower(text), 'idiot') OR contains(lower(text), 'moron') OR contains(lower(text), 'scum'))::INT AS predicted_toxic,
  """ + SPLIT.format(k="d.doc_id") + """ AS split, d.doc_id % 20 = 0 AS is_error, d.doc_id % 20 = 1 AS is_invalid,
  ((d.doc_id * 7919) % 1000)::DOUBLE / 1000 AS confidence, ((d.doc_id * 37) % 500 + 10)::DOUBLE AS latency_ms FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
items AS (SELECT *, CASE WHEN is_error THEN 'error' WHEN is_invalid THEN 'schema_invalid' ELSE 'scored' END AS status,
  CASE WHEN NOT is_error AND NOT is_invalid THEN expected_quality = predicted_quality END AS match_quality,
  CASE WHEN NOT is_error AND NOT is_invalid THEN expected_toxic = predicted_toxic END AS match_toxic,
  CASE WHEN is_error THEN NULL WHEN is_invalid THEN false ELSE expected_quality = predicted_quality AND expected_toxic = predicted_toxic END AS exact_match FROM cases)"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as routing cases with a small and a large model's cached facts."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS case_id", "o_orderpriority AS slice", "CAST(1 + o_orderkey % 5 AS DOUBLE) AS weight", "CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS student_score",
        "o_orderkey % 20 <> 1 AS student_usable", "o_orderkey % 20 = 1 AS student_error", "o_orderkey % 20 <> 1 AS student_valid", "o_orderkey % 4 <> 0 AND o_orderkey % 20 <> 1 AS student_exact",
        "CAST(20 + o_orderkey % 50 AS DOUBLE) AS student_latency_ms", "0.0001D AS student_cost_usd", "o_orderkey % 50 = 7 AS frontier_error", "o_orderkey % 50 <> 7 AS frontier_valid",
        "o_orderkey % 10 <> 3 AND o_orderkey % 50 <> 7 AS frontier_exact", "CAST(200 + o_orderkey % 300 AS DOUBLE) AS frontier_latency_ms", "0.002D AS frontier_cost_usd",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as telemetry: its type stands for the model, error events for failures, value for latency."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(ts AS TIMESTAMP) AS timestamp", "CAST(event_id AS STRING) AS request_id", "event_type AS model_selected", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status",
        "event_id % 4 = 0 AS fallback", "CASE WHEN event_id % 4 = 0 THEN 'low_confidence' ELSE 'small_confident' END AS route_reason", "CAST(event_id % 100 AS DOUBLE) / 100 AS routing_confidence",
        "event_id % 1000 AS input_tokens", "event_id % 100 AS output_tokens", "value AS latency_ms", "CAST(event_id % 1000 AS DOUBLE) / 1000000 AS estimated_cost_usd", "event_id % 50 = 0 AS schema_failure",
        "CASE WHEN event_type = 'error' THEN 'model_error' END AS error_code",
    )
