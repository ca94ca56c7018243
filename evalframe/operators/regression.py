"""Compare two runs: identity first, then floors, ceilings and allowed drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Identity fields that must agree.
FIELDS = ["dataset_name", "dataset_version", "dataset_sha256", "split", "case_ids_sha256", "case_count", "evaluator_version", "schema_version", "judge_identity"]


def long_metrics(wide: DataFrame, metrics: list[str], scope: str = "scope") -> DataFrame:
    """(scope, metric, value) of a wide report."""
    return wide.select(F.col(scope).alias("scope"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select("scope", "x.*")


def compare_identities(a: DataFrame, b: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """(field, left, right) of the identity fields that differ; null equals null. One row on each side."""
    fields = fields or FIELDS
    long = lambda d, name: d.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select("x.*")
    return long(a, "left").join(long(b, "right"), "field", "full").where(~F.col("left").eqNullSafe(F.col("right")))


def apply_policy(metrics: DataFrame, policy: DataFrame, missing_fails: bool = True) -> DataFrame:
    """Violations of a long policy (scope, metric, op: min or max, threshold): (code, scope, metric, actual, threshold).

    A scope of the policy without any metric is one slice_missing row. Comparisons are strict.
    """
    scopes = metrics.select("scope").distinct()
    absent = policy.join(scopes, "scope", "left_anti").select("scope").distinct().select(F.lit("slice_missing").alias("code"), "scope", F.lit("slice").alias("metric"), F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("threshold"))
    joined = policy.join(scopes, "scope", "left_semi").join(metrics, ["scope", "metric"], "left")
    value, limit = F.col("value"), F.col("threshold")
    code = F.when(value.isNull(), F.lit("metric_missing") if missing_fails else F.lit(None)).when((F.col("op") == "min") & (value < limit), "floor_failed").when((F.col("op") == "max") & (value > limit), "ceiling_failed")
    return joined.select(code.alias("code"), "scope", "metric", value.alias("actual"), limit.alias("threshold")).where("code IS NOT NULL").unionByName(absent)


def relative_drops(baseline: DataFrame, candidate: DataFrame, allowed: DataFrame, missing_fails: bool = True) -> DataFrame:
    """Violations of allowed drops (metric, max_drop) between overall metrics of two runs."""
    b, c = baseline.where("scope = 'ALL'").select("metric", F.col("value").alias("before")), candidate.where("scope = 'ALL'").select("metric", F.col("value").alias("after"))
    joined = b.join(c, "metric", "full").join(allowed, "metric")
    drop = F.col("before") - F.col("after")
    code = F.when(drop.isNull(), F.lit("metric_missing") if missing_fails else F.lit(None)).when(drop > F.col("max_drop"), "regression")
    return joined.select(code.alias("code"), F.lit("ALL").alias("scope"), "metric", drop.alias("actual"), F.col("max_drop").alias("threshold")).where("code IS NOT NULL")


def per_class_drops(before: DataFrame, after: DataFrame, max_drop: float) -> DataFrame:
    """Labels whose F1 falls by more than max_drop, or which only one run has."""
    joined = before.select("label", F.col("f1").alias("f1_before")).join(after.select("label", F.col("f1").alias("f1_after")), "label", "full")
    drop = F.col("f1_before") - F.col("f1_after")
    code = F.when(drop.isNull(), "metric_missing").when(drop > max_drop, "regression")
    return joined.select(code.alias("code"), F.lit("ALL").alias("scope"), F.concat(F.lit("issue_f1."), "label").alias("metric"), drop.alias("actual"), F.lit(float(max_drop)).alias("threshold")).where("code IS NOT NULL")


def verdict(identity: DataFrame, violations: DataFrame) -> DataFrame:
    """One row: incomparable if identities differ (metrics are then not judged), else fail or pass."""
    i, v = identity.agg(F.count(F.lit(1)).alias("differences")), violations.agg(F.count(F.lit(1)).alias("violations"))
    both = i.crossJoin(v)  # one row each
    status = F.when(F.col("differences") > 0, "incomparable").when(F.col("violations") > 0, "fail").otherwise("pass")
    return both.select(status.alias("status"), "differences", F.when(F.col("differences") == 0, F.col("violations")).otherwise(0).alias("violations"))


def gate_stored_runs(spark: SparkSession, baseline: str, candidate: str, policy: DataFrame, metrics: list[str], allowed: DataFrame | None = None, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(verdict, violations) over two stored runs, which are read, never evaluated again.

    A stored run is a folder with the tables identity (one row) and report (scope and metrics in columns), as store_run
    writes them. One folder cannot be compared with itself.
    """
    if baseline.rstrip("/") == candidate.rstrip("/"):
        raise ValueError("baseline and candidate must be two runs")
    b, c = ({t: spark.read.parquet(f"{path.rstrip('/')}/{t}") for t in ("identity", "report")} for path in (baseline, candidate))
    found = apply_policy(long_metrics(c["report"], metrics), policy)
    if allowed is not None:
        found = found.unionByName(relative_drops(long_metrics(b["report"], metrics), long_metrics(c["report"], metrics), allowed))
    return verdict(compare_identities(b["identity"], c["identity"], fields), found), found


def store_run(identity: DataFrame, report: DataFrame, path: str) -> None:
    """Write a run's identity and report once."""
    for name, df in (("identity", identity), ("report", report)):
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")
