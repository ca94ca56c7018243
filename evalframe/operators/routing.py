"""Sweep routing thresholds over cached predictions of a small and a large model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ratio
from .stats import weighted_percentile


def pair_runs(gold: DataFrame, student: DataFrame, frontier: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Inner join of three tables with equal populations, and (side, id) of what is not in all."""
    sides = {"gold": gold, "student": student, "frontier": frontier}
    marks = [d.select(F.col(id_col).alias("id")).distinct().withColumn(n, F.lit(1)) for n, d in sides.items()]
    every = marks[0].join(marks[1], "id", "full").join(marks[2], "id", "full")
    gaps = every.select("id", F.explode(F.array_compact(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in sides)))).alias("missing_in"))
    return gold.join(student, id_col).join(frontier, id_col), gaps


def check_thresholds(thresholds: list[float]) -> list[float]:
    if not thresholds or len(set(thresholds)) != len(thresholds) or any(not 0 <= t <= 1 for t in thresholds):
        raise ValueError("thresholds must be distinct and within [0, 1]")
    return sorted(thresholds)


def routed(cases: DataFrame, thresholds: list[float], score: str = "student_score", usable: str = "student_usable", sides: tuple[str, str] = ("student", "frontier"), facts: tuple[str, ...] = ("error", "valid", "exact", "latency_ms", "cost_usd")) -> DataFrame:
    """Each case at each threshold with the facts of the branch it takes; escalation pays for both branches.

    Branch facts (<side>_<fact>) are scored once, before thresholds multiply the rows.
    """
    levels = cases.sparkSession.createDataFrame([(t,) for t in check_thresholds(thresholds)], "threshold double")
    s, f = sides
    crossed = cases.crossJoin(F.broadcast(levels))  # a short list of thresholds
    up = F.coalesce(~F.col(usable), F.lit(True)) | F.col(score).isNull() | (F.col(score) < F.col("threshold"))
    crossed = crossed.withColumn("escalated", up)
    paid = lambda x: F.col(f"{s}_{x}") + F.when(F.col("escalated"), F.col(f"{f}_{x}")).otherwise(0.0)
    return crossed.withColumns({x: paid(x) if x in ("latency_ms", "cost_usd") else F.when(F.col("escalated"), F.col(f"{f}_{x}")).otherwise(F.col(f"{s}_{x}")) for x in facts})


def sweep(decided: DataFrame, slice_col: str | None = None, weight: str = "weight") -> DataFrame:
    """Population-weighted metrics for each threshold, overall (scope ALL) and by slice.

    overconfident: kept on the small model and not exact, for each 100 of weight.
    """
    w = F.col(weight)
    flag = lambda c: F.sum(w * c.cast("double"))
    returned = ~F.col("error")
    measures = [
        F.sum(w).alias("weight"), flag(F.col("escalated")).alias("up"), flag(F.col("error")).alias("err"), flag(returned).alias("ret"),
        flag(returned & F.coalesce("valid", F.lit(False))).alias("ok"), flag(returned & F.coalesce("exact", F.lit(False))).alias("hit"),
        F.sum(w * F.col("latency_ms")).alias("lat"), F.sum(w * F.col("cost_usd")).alias("cost"), flag(~F.col("escalated") & ~F.coalesce("exact", F.lit(False))).alias("over"),
    ]
    if slice_col:
        named = decided.withColumn("scope", F.col(slice_col))
        out = named.groupingSets([["threshold"], ["threshold", "scope"]], "threshold", "scope").agg(*measures, F.grouping("scope").alias("g"))
        out = out.withColumn("scope", F.when(F.col("g") == 1, "ALL").otherwise(F.col("scope")))
    else:
        out = decided.groupBy("threshold").agg(*measures).withColumn("scope", F.lit("ALL"))
    return out.select(
        "threshold", "scope", "weight", ratio(F.col("up"), F.col("weight")).alias("frontier_share"), ratio(F.col("err"), F.col("weight")).alias("error_rate"),
        ratio(F.col("ok"), F.col("ret")).alias("schema_validity_rate"), ratio(F.col("hit"), F.col("ret")).alias("exact_match_rate"),
        ratio(F.col("lat"), F.col("weight")).alias("avg_latency_ms"), ratio(F.col("cost"), F.col("weight")).alias("avg_cost_usd"),
        (100 * ratio(F.col("over"), F.col("weight"))).alias("overconfident_per_100"),
    )


def quality_cost(swept: DataFrame) -> DataFrame:
    """(threshold, quality, avg_cost_usd, frontier_share); quality counts errors as misses."""
    return swept.where("scope = 'ALL'").select("threshold", (F.col("exact_match_rate") * (1 - F.col("error_rate"))).alias("quality"), "avg_cost_usd", "frontier_share")


def latency_tail(decided: DataFrame, slice_col: str | None = None, share: float = 0.95, weight: str = "weight") -> DataFrame:
    """(threshold, scope, p<share>): the weighted percentile of latency beside sweep's averages."""
    scopes = F.array(F.lit("ALL"), *([F.col(slice_col).cast("string")] if slice_col else []))
    rows = decided.select("threshold", "latency_ms", weight, F.explode(scopes).alias("scope"))
    return weighted_percentile(rows, "latency_ms", weight, [share], ["threshold", "scope"])


def source_differences(sources: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """(field, sources, values) of facts that the runs behind a sweep do not share; null is a value of its own."""
    long = sources.select(name, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("null")).alias("value")) for f in fields))).alias("x")).select(name, "x.*")
    return long.groupBy("field").agg(F.countDistinct(name).alias("sources"), F.array_sort(F.collect_set("value")).alias("values")).where(F.size("values") > 1)


def best_point(points: DataFrame, budget: float | None = None) -> DataFrame:
    """The threshold of highest quality (cheapest on ties) within a budget."""
    kept = points if budget is None else points.where(F.col("avg_cost_usd") <= budget)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("quality"), "avg_cost_usd", "threshold"))).where("place = 1").drop("place")
