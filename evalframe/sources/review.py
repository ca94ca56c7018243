"""Human reviews as CSV or JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jsonl import read_strict_jsonl, write_canonical_jsonl

COLUMNS = ["schema_version", "case_id", "reviewer_id", "source_text", "predicted_evidence", "reference_evidence", "evidence_relevant", "unsupported_claim", "relevance_score", "notes"]
SCHEMA = "schema_version string, case_id string, reviewer_id string, source_text string, predicted_evidence array<string>, reference_evidence array<string>, evidence_relevant boolean, unsupported_claim boolean, relevance_score double, notes string"


def _boolean(c: str):
    low = F.lower(F.btrim(c))
    return F.when(low == "true", True).when(low == "false", False)


def read_reviews_csv(spark: SparkSession, path: str, complete: bool = False) -> tuple[DataFrame, DataFrame]:
    """(reviews, problems as case_id and reason). Booleans are true, false or blank; array cells are JSON."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    if raw.columns != COLUMNS:
        raise ValueError(f"the header must be {','.join(COLUMNS)}")
    text = lambda c: F.coalesce(F.btrim(c), F.lit(""))
    arrays, booleans = ("predicted_evidence", "reference_evidence"), ("evidence_relevant", "unsupported_claim")
    rules = [(F.lower(text(c)).isin("true", "false", ""), f"{c} is no boolean") for c in booleans]
    rules += [((text(c) == "") | F.from_json(c, "array<string>").isNotNull(), f"{c} is no JSON array") for c in arrays]
    rules += [((text("relevance_score") == "") | F.expr("try_cast(relevance_score AS double)").between(0, 1), "relevance_score is not within 0 and 1"), (text("case_id") != "", "case_id is blank")]
    if complete:
        rules += [(text(c) != "", f"{c} is blank") for c in booleans]
    checked = raw.withColumn("reasons", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(why)) for ok, why in rules))))
    good = checked.where(F.size("reasons") == 0).select(
        *(_boolean(c).alias(c) if c in booleans else F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")).alias(c) if c in arrays
          else F.expr("try_cast(relevance_score AS double)").alias(c) if c == "relevance_score" else F.col(c) for c in COLUMNS)
    )
    twice = raw.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("case_id is repeated").alias("reason"))
    return good, checked.select("case_id", F.explode("reasons").alias("reason")).unionByName(twice)


def write_reviews_csv(reviews: DataFrame, path: str) -> None:
    """One CSV row a review, ordered by case."""
    cells = [F.to_json(c).alias(c) if c.endswith("_evidence") else F.col(c).cast("string").alias(c) for c in COLUMNS]
    reviews.orderBy("case_id").select(*cells).write.mode("errorifexists").csv(path, header=True, quote='"', escape='"')


def read_reviews_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_strict_jsonl(spark, path, SCHEMA, blank_lines=True)


def write_reviews_jsonl(reviews: DataFrame, path: str) -> None:
    write_canonical_jsonl(reviews.select(*COLUMNS), path, "case_id")
