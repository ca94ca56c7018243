"""Train and measure the learned baseline, and its sensitivity to wrong labels."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.routing_score import ACTION_OF, TEAM_OF, rule_label
from .baseline import TextBaseline
from .dataset import noise_plan, plan_digest
from .scoring import confusion, macro, per_class


def measure_split(predictions: DataFrame, expected: str, predicted: str, split_col: str = "split", labels: DataFrame | None = None) -> DataFrame:
    """(split, count, errors, accuracy, macro_precision, macro_recall, macro_f1) for each split of a table of predictions."""
    matrix = confusion(predictions.withColumn("__ef_split", F.col(split_col)), expected, predicted, by=["__ef_split"])
    counts = matrix.groupBy("__ef_split").agg(F.sum("weight").alias("count"), F.sum(F.when(F.col("expected") != F.col("predicted"), F.col("weight")).otherwise(0)).alias("errors"))
    scores = macro(per_class(matrix, labels, by=["__ef_split"]), by=["__ef_split"])
    return counts.join(scores, "__ef_split").withColumnRenamed("__ef_split", "split")


def train_and_measure(rows: DataFrame, text: str, label: str, split_col: str = "split", train: str = "train", **how) -> tuple[TextBaseline, DataFrame, float]:
    """(model, measure_split of the other splits, seconds of the fit)."""
    start = time.perf_counter()
    model = TextBaseline.fit(rows.where(F.col(split_col) == train), text, label, **how)
    took = time.perf_counter() - start
    return model, measure_split(model.predict(rows.where(F.col(split_col) != train), text), label, "predicted_label", split_col), took


def noise_ablation(rows: DataFrame, id_col: str, text: str, label: str, labels: list[str], fractions: tuple[float, ...] = (0.0, 0.1, 0.3), seed: int = 20260820, split_col: str = "split", train: str = "train", **how) -> DataFrame:
    """One row for each fraction and measured split: fraction, corrupted, plan_digest, split, count, errors and scores.

    The training labels of a fraction of rows move to the next label, with another seed for each fraction; a clean
    control must be among them; its plan is empty and has a null digest. Fits run one after the other.
    """
    if 0.0 not in fractions or len(set(fractions)) != len(fractions) or any(not 0 <= f <= 1 for f in fractions):
        raise ValueError("fractions must be distinct, within 0 and 1, and include 0.0")
    training, out = rows.where(F.col(split_col) == train), None
    size = training.count()
    for offset, fraction in enumerate(fractions):
        plan = noise_plan(training, id_col, label, labels, fraction, seed + offset, rows=size)
        moved = training.join(plan.select(F.col("id").alias(id_col), "corrupted"), id_col, "left").withColumn(label, F.coalesce("corrupted", label)).drop("corrupted")
        model = TextBaseline.fit(moved, text, label, **how)
        measured = measure_split(model.predict(rows.where(F.col(split_col) != train), text), label, "predicted_label", split_col)
        made = plan_digest(plan).select(F.coalesce("keys", F.lit(0)).cast("long").alias("corrupted"), F.col("digest").alias("plan_digest"))
        point = measured.crossJoin(made).select(F.lit(fraction).alias("fraction"), "corrupted", "plan_digest", *measured.columns)  # one row of the plan
        out = point if out is None else out.unionByName(point)
    return out


def noise_conclusion(points: DataFrame, split: str = "test") -> DataFrame:
    """(clean, noisiest_fraction, noisiest, fell): the clean control's macro F1 on a split beside the noisiest point's."""
    held = points.where(F.col("split") == split)
    one = held.agg(F.max(F.when(F.col("fraction") == 0, F.col("macro_f1"))).alias("clean"), F.max("fraction").alias("noisiest_fraction"), F.max_by("macro_f1", "fraction").alias("noisiest"))
    return one.withColumn("fell", F.col("noisiest") < F.col("clean"))


def full_record(predicted_label: Column, confidence: Column, subject: Column, body: Column) -> dict[str, Column]:
    """A whole prediction: the learned issue, its team and action, and the rules' other fields; a security action stays."""
    rules = rule_label(subject, body)
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), predicted_label)
    action = F.when(rules["recommended_action"] == "ESCALATE_SECURITY_REVIEW", rules["recommended_action"]).otherwise(of(ACTION_OF))
    return rules | {"issue_type": predicted_label, "routing_team": of(TEAM_OF), "recommended_action": action, "confidence": confidence}
