"""Validate an automated judge against human reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import ratio
from .stats import cohen_kappa, spearman


def join_reviews(human: DataFrame, judge: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Each human review with its judgment and outcome: matched, missing or error. Judge columns get the prefix judge_."""
    renamed = judge.select(F.col(id_col), *(F.col(c).alias(f"judge_{c}") for c in judge.columns if c != id_col))
    out = human.join(renamed, id_col, "left")
    return out.withColumn("outcome", F.when(F.col("judge_status").isNull(), "missing").when(F.col("judge_status") == "ok", "matched").otherwise("error"))


def identity_problems(human: DataFrame, judge: DataFrame, id_col: str = "case_id", identity: str = "judge_name") -> DataFrame:
    """(check, key): repeated ids on either side, more than one judge identity."""
    twice = lambda d, name: d.groupBy(id_col).count().where("count > 1").select(F.lit(name).alias("check"), F.col(id_col).cast("string").alias("key"))
    mixed = judge.agg(F.array_join(F.array_sort(F.collect_set(identity)), ",").alias("key"), F.countDistinct(identity).alias("n")).where("n > 1").select(F.lit("mixed_judges").alias("check"), "key")
    return twice(human, "human_repeated").unionByName(twice(judge, "judge_repeated")).unionByName(mixed)


def validate_judge(joined: DataFrame) -> DataFrame:
    """One row: agreement, kappas, rank correlation, false accepts and rejects of the judge.

    relevant and unsupported are booleans of both sides, score a number. A side accepts when evidence is relevant and
    nothing is unsupported. False accepts are shared by human rejects, false rejects by human accepts.
    """
    m = F.col("outcome") == "matched"
    accept, judged = F.col("relevant") & ~F.col("unsupported"), F.col("judge_relevant") & ~F.col("judge_unsupported")
    both = joined.withColumns({"accept": accept, "judge_accept": F.when(m, judged)})
    counted = F.col("accept").isNotNull() & F.col("judge_accept").isNotNull()
    agree = lambda a, b: F.avg(F.when(m & F.col(a).isNotNull() & F.col(b).isNotNull(), (F.col(a) == F.col(b)).cast("double")))
    joint = (F.col("relevant") == F.col("judge_relevant")) & (F.col("unsupported") == F.col("judge_unsupported"))
    one = both.agg(
        F.count(F.lit(1)).alias("reviews"), F.count_if(m).alias("matched"), F.count_if(F.col("outcome") == "missing").alias("missing"), F.count_if(F.col("outcome") == "error").alias("errors"),
        agree("relevant", "judge_relevant").alias("relevance_agreement"), agree("unsupported", "judge_unsupported").alias("unsupported_agreement"), F.avg(F.when(m, joint.cast("double"))).alias("joint_agreement"),
        F.count_if(counted & ~F.col("accept") & F.col("judge_accept")).alias("false_accepts"), F.count_if(counted & ~F.col("accept")).alias("human_rejects"),
        F.count_if(counted & F.col("accept") & ~F.col("judge_accept")).alias("false_rejects"), F.count_if(counted & F.col("accept")).alias("human_accepts"),
    ).withColumns({"false_accept_rate": ratio(F.col("false_accepts"), F.col("human_rejects")), "false_reject_rate": ratio(F.col("false_rejects"), F.col("human_accepts"))})
    pairs = joined.where(m)
    for name in ("relevant", "unsupported"):
        one = one.crossJoin(cohen_kappa(pairs, name, f"judge_{name}").select(F.col("kappa").alias(f"{name}_kappa")))  # one row each
    return one.crossJoin(spearman(pairs, "score", "judge_score").select("spearman"))


def disagreements(joined: DataFrame, id_col: str = "case_id", most: int = 10) -> DataFrame:
    differs = ~(F.col("relevant").eqNullSafe(F.col("judge_relevant")) & F.col("unsupported").eqNullSafe(F.col("judge_unsupported")))
    return joined.where((F.col("outcome") == "matched") & differs).orderBy(id_col).limit(most)


def evidence_comparison(items: DataFrame, human: DataFrame, judge: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Evaluation items beside what humans and the judge say of their evidence; absent sides read missing."""
    h = human.select(id_col, F.col("relevant").alias("human_relevant"), F.lit("reviewed").alias("human_status"))
    j = judge.select(id_col, F.col("relevant").alias("judge_relevant"), F.col("status").alias("judge_status"))
    out = items.join(h, id_col, "left").join(j, id_col, "left")
    return out.withColumns({s: F.coalesce(s, F.lit("missing")) for s in ("human_status", "judge_status")})
