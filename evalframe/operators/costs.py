"""Token prices, hybrid costs and operational summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scoring import ratio
from .stats import percentile


def with_prices(usage: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Usage rows with their price and cost_usd; prices are a small dimension, joined as Spark sees fit."""
    return usage.join(prices, keys, "left").withColumn("cost_usd", token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_usd_per_million"), F.col("output_usd_per_million")))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column, digits: int = 10) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.round((zero(input_tokens) * input_price + zero(output_tokens) * output_price) / 1e6, digits)


def hybrid_cost(small: Column, frontier: Column, escalation_rate: Column) -> Column:
    return small + escalation_rate * frontier


def monthly_cost(per_request: Column, requests: Column) -> Column:
    return F.round(per_request * requests, 2)


def operational_summary(calls: DataFrame, needs_tokens: bool = True) -> DataFrame:
    """One row: calls, errors, latency average and percentiles, tokens, cost, and what is not accounted for.

    A call without tokens is unaccounted only where tokens make its cost. The average divides the whole cost by the
    accounted calls; lower_bound says that some are missing.
    """
    known = F.col("cost_usd").isNotNull() & ((F.col("input_tokens").isNotNull() & F.col("output_tokens").isNotNull()) if needs_tokens else F.lit(True))
    one = calls.agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") == "error").alias("errors"), F.avg("latency_ms").alias("avg_latency_ms"),
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.count_if(known).alias("accounted"), F.count_if(~known).alias("unaccounted"), F.array_sort(F.collect_set("model_version")).alias("model_versions"),
    ).withColumns({"avg_cost_usd": ratio(F.col("cost_usd"), F.col("accounted")), "lower_bound": F.col("unaccounted") > 0})
    return one.crossJoin(percentile(calls, "latency_ms", [0.5, 0.95]).agg(F.max("p50").alias("p50_latency_ms"), F.max("p95").alias("p95_latency_ms")))  # one row each


def token_summary(rows: DataFrame, tokens: str) -> DataFrame:
    return rows.agg(F.count(tokens).alias("rows"), F.min(tokens).alias("min"), F.max(tokens).alias("max"), F.sum(tokens).alias("total"), F.avg(tokens).alias("mean"))


def loss_history(points: DataFrame, run: str = "run", series: str = "series", position: str = "step", value: str = "value") -> DataFrame:
    """(run, overfitting, first and last training loss, best and last validation loss).

    Overfitting: training loss fell while the last validation loss lies above its best.
    """
    train, valid = F.col(series) == "train", F.col(series) == "validation"
    at = lambda f, side: f(F.when(side, F.col(value)), F.when(side, F.col(position)))
    return points.groupBy(run).agg(
        at(F.min_by, train).alias("train_first"), at(F.max_by, train).alias("train_last"), F.min(F.when(valid, F.col(value))).alias("validation_best"), at(F.max_by, valid).alias("validation_last"),
    ).withColumn("overfitting", (F.col("train_last") < F.col("train_first")) & (F.col("validation_last") > F.col("validation_best")))
