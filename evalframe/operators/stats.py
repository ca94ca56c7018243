"""Calibration, rank statistics and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder
from .scoring import ratio

#: Distinct values that one task sorts for a percentile.
PER_RANGE = 20_000


def calibration_input(items: DataFrame, score: str = "confidence") -> DataFrame:
    """Returned rows with a score: (score, correct); invalid rows are incorrect."""
    return items.where((F.col("status") != "error") & F.col(score).isNotNull()).select(F.col(score).alias("score"), F.coalesce("exact_match", F.lit(False)).alias("correct"))


def missing_scores(items: DataFrame, score: str = "confidence") -> DataFrame:
    return items.where("status <> 'error'").agg(F.count_if(F.col(score).isNull()).alias("missing_scores"))


def calibration_bins(obs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, lower, upper, n, mean_score, accuracy), empty bins included; a score of 1 falls in the last."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    sums = obs.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    frame = obs.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("lower"), ((F.col("id") + 1) / bins).alias("upper"))
    return frame.join(sums, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    total = F.sum("n")
    return bins.agg(ratio(F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("accuracy"))), total).alias("ece"), total.alias("n"))


def running_sums(points: DataFrame, value: str, columns: list[str], descending: bool = False) -> DataFrame:
    """points plus before_<c> and all_<c>: the sum of c over rows with a smaller (descending: larger) value, and over all.

    One row a value. Values are dealt into ranges of about PER_RANGE; ranges' totals give each its offset, so no task
    sorts more than a range. There are at most 1,001 ranges, which is what is broadcast.
    """
    points = _stored(points)
    edges = _range_edges(points, value)
    way = (lambda c: F.desc(c)) if descending else F.asc
    if not edges:  # no more rows than one range has
        before = Window.orderBy(way(value)).rowsBetween(Window.unboundedPreceding, -1)
        return points.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in columns), *(F.sum(c).over(Window.partitionBy()).alias(f"all_{c}") for c in columns))
    dealt = points.withColumn("__ef_part", _range_of(edges, value))
    totals = dealt.groupBy("__ef_part").agg(*(F.sum(c).alias(f"__ef_{c}") for c in columns))
    up_to, every = Window.orderBy(way("__ef_part")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = totals.select("__ef_part", *(F.coalesce(F.sum(f"__ef_{c}").over(up_to), F.lit(0)).alias(f"__ef_before_{c}") for c in columns), *(F.sum(f"__ef_{c}").over(every).alias(f"all_{c}") for c in columns))
    inside = Window.partitionBy("__ef_part").orderBy(way(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(totals), "__ef_part")
    return out.select(*points.columns, *((F.col(f"__ef_before_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in columns), *(f"all_{c}" for c in columns))


def risk_coverage(obs: DataFrame, digits: int | None = None) -> DataFrame:
    """(score, accepted, coverage, risk) for falling thresholds; equal scores are one point. digits rounds scores first."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    points = obs.groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("good"))
    accepted = F.col("before_n") + F.col("n")
    return running_sums(points, "score", ["n", "good"], descending=True).select(
        "score", accepted.alias("accepted"), (accepted / F.col("all_n")).alias("coverage"), (1 - (F.col("before_good") + F.col("good")) / accepted).alias("risk")
    )


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Kappa of two boolean columns over rows with both; 1 or 0 where chance agreement is 1; null without rows."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreed"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(F.col("n") == 0, None).when(chance >= 1.0, F.when(F.col("agreed") >= 1.0, 1.0).otherwise(0.0)).otherwise((F.col("agreed") - chance) / (1 - chance))
    return s.select("n", "agreed", kappa.alias("kappa"))


def average_ranks(df: DataFrame, value: str, rank_col: str) -> DataFrame:
    """df plus the average rank of value (a number), from running sums of the counts of distinct values."""
    counts = running_sums(df.groupBy(value).agg(F.count(F.lit(1)).alias("n")), value, ["n"])
    return df.join(counts.select(value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(rank_col)), value)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation over rows with both values; null below two rows or where a side is constant."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    ranked = average_ranks(average_ranks(rows, a, "ra"), b, "rb")
    m = ranked.agg(F.count(F.lit(1)).alias("n"), *(F.avg(e).alias(k) for k, e in (("x", F.col("ra")), ("y", F.col("rb")), ("xy", F.col("ra") * F.col("rb")), ("xx", F.col("ra") ** 2), ("yy", F.col("rb") ** 2))))
    spread = (F.col("xx") - F.col("x") ** 2) * (F.col("yy") - F.col("y") ** 2)
    return m.select("n", F.when((F.col("n") >= 2) & (spread > 1e-12), (F.col("xy") - F.col("x") * F.col("y")) / F.sqrt(spread)).alias("spearman"))


def percentile(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, empty: float | None = None) -> DataFrame:
    """Nearest-rank percentiles p<share>, from counts of distinct values; empty replaces null."""
    return weighted_percentile(df.withColumn("__ef_w", F.lit(1).cast("long")), value, "__ef_w", shares, by, empty)


def weighted_percentile(df: DataFrame, value: str, weight: str, shares: list[float], by: list[str] | None = None, empty: float | None = None) -> DataFrame:
    """The smallest value whose running weight reaches the share of all weight. Null values and weights of 0 play no part.

    Values are dealt into ranges of about PER_RANGE; totals of ranges tell which one holds a share, and only those are sorted.
    """
    by = by or []
    points = _stored(df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("w")))
    edges = _range_edges(points, value)
    if not edges:  # no more rows than one range has
        way = Window.partitionBy(*by)
        held = points.withColumns({"cum": F.sum("w").over(way.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(way)})
        reached = [F.coalesce(F.min(F.when(F.col("cum") >= s * F.col("all"), F.col(value))), F.max(value)) for s in shares]
        return held.groupBy(*by).agg(*((F.coalesce(p, F.lit(empty)) if empty is not None else p).alias(f"p{round(s * 100)}") for p, s in zip(reached, shares, strict=True)))
    points = points.withColumn("part", _range_of(edges, value))
    group = Window.partitionBy(*by)
    ends = F.sum("all").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    totals = points.groupBy(*by, "part").agg(F.sum("w").alias("all")).withColumn("end", ends)  # a row for each group and range
    totals = totals.withColumns({"before": F.coalesce(F.lag("end").over(group.orderBy("part")), F.lit(0)), "all": F.max("end").over(group)})
    holds = [(F.col("end") >= s * F.col("all")) & ((F.col("before") < s * F.col("all")) | (F.col("before") <= 0)) for s in shares]
    held = totals.select(F.struct(*(F.col(c) for c in [*by, "part"])).alias("__ef_key"), "before", "all", F.array(*holds).alias("holds")).where(F.exists("holds", lambda h: h))
    near = points.join(held, F.struct(*(F.col(c) for c in [*by, "part"])).eqNullSafe(F.col("__ef_key")))
    cum = F.col("before") + F.sum("w").over(Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    cumulated = near.withColumn("cum", cum)
    # Sums in another order may round below the range's total; its last value holds the share then.
    pick = [F.coalesce(F.min(F.when(F.col("holds")[n] & (F.col("cum") >= s * F.col("all")), F.col(value))), F.max(F.when(F.col("holds")[n], F.col(value)))) for n, s in enumerate(shares)]
    return cumulated.groupBy(*by).agg(*((F.coalesce(p, F.lit(empty)) if empty is not None else p).alias(f"p{round(s * 100)}") for p, s in zip(pick, shares, strict=True)))


def _stored(points: DataFrame) -> DataFrame:
    """points, evaluated once: written to the shared folder and read back."""
    path = new_folder(points.sparkSession, "points")
    points.write.parquet(path)
    return points.sparkSession.read.schema(points.schema).parquet(path)


def _range_edges(points: DataFrame, value: str) -> list:
    """Lower edges of ranges of values that hold about PER_RANGE rows each, at most 1,000 edges; none for a single range."""
    n = points.count()
    if n <= PER_RANGE:
        return []
    many = [m / 1000 for m in range(1, 1000)]
    found = points.agg(F.percentile_approx(value, many, 10_000).alias("edges")).first()["edges"]
    return sorted(set((found or [])[max(1, round(1000 * PER_RANGE / n)) - 1 :: max(1, round(1000 * PER_RANGE / n))]))


def _range_of(edges: list, value: str) -> Column:
    """How many edges a value has reached, by halving: ten comparisons for a thousand edges."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(value) >= F.lit(edges[middle]), among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(edges))


def bad_weights(df: DataFrame, weight: str) -> DataFrame:
    """Rows that a weighted statistic must refuse: negative, NaN or infinite weights."""
    w = F.col(weight).cast("double")
    return df.where((w < 0) | F.isnan(w) | (F.abs(w) == float("inf")))
