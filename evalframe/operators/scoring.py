"""Score predictions against gold labels: errors, invalid output and wrong answers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_counts


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def evaluation_records(gold: DataFrame, outcomes: DataFrame, id_col: str, subject: Column, body: Column, slice_col: Column, robustness: Column, split: Column) -> DataFrame:
    """Gold rows with their outcome, input_text (non-empty parts joined by LF) and slice (given, else robustness, else split)."""
    text = F.concat_ws("\n", F.nullif(subject, F.lit("")), F.nullif(body, F.lit("")))
    return gold.withColumns({"input_text": text, "slice": F.coalesce(slice_col, robustness, split)}).join(outcomes, id_col, "left")


def one_outcome(prediction: Column, raw: Column, error: Column) -> Column:
    """Whether exactly one of three outcomes is there."""
    return (prediction.isNotNull().cast("int") + raw.isNotNull().cast("int") + error.isNotNull().cast("int")) == 1


def score_items(df: DataFrame, fields: list[str], error: Column, invalid: Column, expected: str = "expected_{}", predicted: str = "predicted_{}", evidence: Column | None = None, text: Column | None = None) -> DataFrame:
    """Add status (error, schema_invalid, scored), match_<field>, exact_match and evidence counts.

    exact_match is null for errors, false for invalid rows, and else whether all fields are equal (null equals null).
    evidence and text are normalised columns; counts are null unless the row is scored.
    """
    status = F.when(error, "error").when(invalid, "schema_invalid").otherwise("scored")
    out = df.withColumn("status", status)
    scored = F.col("status") == "scored"
    match = {f"match_{f}": F.when(scored, F.col(expected.format(f)).eqNullSafe(F.col(predicted.format(f)))) for f in fields}
    out = out.withColumns(match)
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f"match_{f}")
    out = out.withColumn("exact_match", F.when(F.col("status") == "schema_invalid", False).when(scored, whole))
    if evidence is not None:
        counts = evidence_counts(evidence, text)
        out = out.withColumns({f"evidence_{k}": F.when(scored, counts[k]) for k in ("total", "grounded", "unsupported")})
    return out


def redact_invalid(df: DataFrame, prediction_cols: list[str], message_col: str, message: str = "schema validation failed") -> DataFrame:
    """Schema-invalid rows lose their prediction and message text."""
    bad = F.col("status") == "schema_invalid"
    return df.withColumns({c: F.when(~bad, F.col(c)) for c in prediction_cols} | {message_col: F.when(bad, F.lit(message)).otherwise(F.col(message_col))})


def summarize(items: DataFrame, fields: list[str], slice_col: str | None = None, weight: Column | None = None) -> DataFrame:
    """Population metrics with explicit denominators, for all rows and (scope = slice) for each slice, in one pass.

    wrong = returned - exact: invalid rows are wrong, errors are not. Rates without a denominator are null.
    """
    count = lambda cond: F.count_if(cond).alias
    returned, scored = F.col("status") != "error", F.col("status") == "scored"
    measures = [
        F.count(F.lit(1)).alias("total"), count(~returned)("errors"), count(returned)("returned"), count(scored)("valid"),
        count(F.col("status") == "schema_invalid")("invalid"), count(F.col("exact_match"))("exact"),
        *(F.avg(F.col(f"match_{f}").cast("double")).alias(f"accuracy_{f}") for f in fields),
    ]
    if "evidence_total" in items.columns:
        measures += [F.sum(f"evidence_{k}").alias(f"evidence_{k}") for k in ("total", "grounded", "unsupported")]
        measures += [F.avg((F.col("evidence_total") > 0).cast("double")).alias("evidence_presence_rate")]
    if slice_col is None:
        out = items.agg(*measures)
    else:
        named = items.withColumn("scope", F.col(slice_col))
        out = named.groupingSets([[], ["scope"]], "scope").agg(*measures, F.grouping("scope").alias("overall"))
        out = out.withColumn("scope", F.when(F.col("overall") == 1, "ALL").otherwise(F.col("scope"))).drop("overall")
    out = out.withColumns({
        "wrong": F.col("returned") - F.col("exact"), "error_rate": ratio(F.col("errors"), F.col("total")),
        "schema_validity_rate": ratio(F.col("valid"), F.col("returned")), "exact_match_rate": ratio(F.col("exact"), F.col("returned")),
    })
    if "evidence_total" in items.columns:
        out = out.withColumns({"grounding_rate": ratio(F.col("evidence_grounded"), F.col("evidence_total")), "unsupported_rate": ratio(F.col("evidence_unsupported"), F.col("evidence_total"))})
    return out


def duplicate_cases(items: DataFrame, id_col: str) -> DataFrame:
    return items.groupBy(id_col).count().where("count > 1")


def confusion(df: DataFrame, expected: str, predicted: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, expected, predicted, weight): rows with a null side play no part."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    pairs = df.where(F.col(expected).isNotNull() & F.col(predicted).isNotNull())
    return pairs.groupBy(*(by or []), F.col(expected).alias("expected"), F.col(predicted).alias("predicted")).agg(w.alias("weight"))


def per_class(matrix: DataFrame, labels: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, label, support, predicted, correct, precision, recall, f1) over configured and observed labels; 0 where undefined."""
    by = by or []
    sides = matrix.select(*by, F.explode(F.array(
        F.struct(F.col("expected").alias("label"), F.col("weight").alias("support"), F.lit(0).cast("double").alias("predicted"), F.when(F.col("expected") == F.col("predicted"), F.col("weight")).otherwise(0).cast("double").alias("correct")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast(matrix.schema["weight"].dataType).alias("support"), F.col("weight").cast("double").alias("predicted"), F.lit(0).cast("double").alias("correct")),
    )).alias("x")).select(*by, "x.*")
    sums = sides.groupBy(*by, "label").agg(F.sum("support").cast("double").alias("support"), F.sum("predicted").alias("predicted"), F.sum("correct").alias("correct"))
    if labels is not None:
        frame = matrix.select(*by).distinct().crossJoin(labels.select("label")) if by else labels.select("label")
        sums = frame.join(sums, [*by, "label"], "full").fillna(0.0, ["support", "predicted", "correct"])
    zero = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return sums.withColumns({"precision": zero(F.col("correct"), F.col("predicted")), "recall": zero(F.col("correct"), F.col("support"))}).withColumn(
        "f1", zero(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def macro(classes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, accuracy, macro_precision, macro_recall, macro_f1) of per_class rows."""
    return classes.groupBy(*(by or [])).agg(
        ratio(F.sum("correct"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )


def misclassified(items: DataFrame, id_col: str, expected: str, predicted: str, examples: int = 10) -> tuple[DataFrame, DataFrame]:
    """How many rows are wrong, and the first by id."""
    wrong = items.where(~F.col(expected).eqNullSafe(F.col(predicted)))
    return wrong.agg(F.count(F.lit(1)).alias("errors")), wrong.orderBy(id_col).limit(examples).select(id_col, expected, predicted)


#: Categories of a failure and the field whose mismatch makes each.
FIELD_FAILURES = {"issue_type": "issue_type_mismatch", "routing_team": "routing_team_mismatch", "severity": "severity_mismatch", "affected_scope": "affected_scope_mismatch", "recommended_action": "recommended_action_mismatch", "evidence": "evidence_mismatch"}


def failure_rows(items: DataFrame, id_col: str, fields: list[str], error_kind: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """(id, category, detail), several for one item: what went wrong, never any input text."""
    names = FIELD_FAILURES if names is None else names
    item = lambda cond, name, detail: F.when(cond, F.struct(F.lit(name).alias("category"), detail.alias("detail")))
    kind = F.coalesce(F.col(error_kind), F.lit("unknown")) if error_kind else F.lit("unknown")
    error, scored = F.col("status") == "error", F.col("status") == "scored"
    timeout = F.contains(F.lower(kind), F.lit("timeout"))
    miss = {f: scored & ~F.col(f"match_{f}") for f in fields}
    mismatches = F.array_sort(F.array_compact(F.array(*(F.when(miss[f], F.lit(f)) for f in fields))))
    found = [
        item(error & timeout, "timeout", kind), item(error & ~timeout, "prediction_error", kind),
        item(F.col("status") == "schema_invalid", "schema_invalid", F.lit("schema invalid")),
        *(item(miss[f], names.get(f, "other_mismatch"), F.lit(f)) for f in fields),
        item(F.size(mismatches) > 1, "multiple_field_mismatch", F.array_join(mismatches, ",")),
    ]
    if "evidence_total" in items.columns:
        found += [
            item(scored & (F.col("evidence_total") == 0), "evidence_missing", F.lit("evidence")),
            item(scored & (F.col("evidence_unsupported") > 0), "evidence_not_literal", F.concat_ws("/", F.col("evidence_unsupported").cast("string"), F.col("evidence_total").cast("string"))),
        ]
    return items.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*found))).alias("x")).select("id", "x.*")


def failure_taxonomy(failures: DataFrame, examples: int = 3) -> DataFrame:
    """(category, n, failed_cases of that category, examples: the first ids)."""
    ranked = failures.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("id")))
    return failures.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("cases")).join(
        ranked.where(F.col("place") <= examples).groupBy("category").agg(F.array_sort(F.collect_list("id")).alias("examples")), "category", "left"
    )
