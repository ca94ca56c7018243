"""Rule-based contracts: each gives an array of the rules a row breaks (empty: valid)."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import contains_literal, fold_joined, fold_odd, join_items, normalize_items, normalize_text, once, part_items, unsafe_controls
from .dataset import conflicts, duplicates, full_diff, prefix_digest

#: Fixed values of the ticket contract: closed vocabularies in declaration order.
VOCABULARY = {
    "issue_type": ["SSO_AUTHENTICATION_FAILURE", "MFA_FAILURE", "ACCOUNT_LOCKED_OR_DISABLED", "ACCESS_DENIED_AFTER_LOGIN", "PROVISIONING_OR_SYNC_FAILURE", "OTHER_IAM"],
    "severity": ["P1", "P2", "P3", "P4"],
    "routing_team": ["IDENTITY_PLATFORM", "ACCESS_MANAGEMENT", "SERVICE_DESK"],
    "affected_scope": ["SINGLE_USER", "MULTIPLE_USERS", "DEPARTMENT", "ORGANIZATION", "UNKNOWN"],
    "recommended_action": ["RESET_OR_UNLOCK_ACCOUNT", "INVESTIGATE_MFA_CONFIGURATION", "INVESTIGATE_IDP_OR_SSO_CONFIGURATION", "REVIEW_ACCESS_ENTITLEMENTS", "INVESTIGATE_PROVISIONING_SYNC", "COLLECT_MORE_INFORMATION", "ESCALATE_SECURITY_REVIEW"],
}
ROBUSTNESS = ["EMOTIONAL_URGENCY", "AMBIGUOUS_REPORT", "CONFLICTING_EVIDENCE", "MISLEADING_TERMINOLOGY", "PROMPT_INJECTION", "INCOMPLETE_INFORMATION"]
#: Which splits each purpose may read.
PURPOSES = {"training": ["train"], "validation": ["validation"], "test_evaluation": ["test"], "adversarial_evaluation": ["adversarial"], "analysis": ["train", "validation", "test", "adversarial"]}
#: Length bounds, counted after stripping.
LENGTHS = {"ticket_id": (3, 64), "subject": (3, 200), "body": (10, 4000), "employee_department": (1, 100), "evidence": (1, 300)}


def broken(**rules: Column) -> Column:
    """Names of the rules that do not hold; an unknown outcome counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def length_between(c: Column | str, low: int, high: int) -> Column:
    return F.length(F.btrim(F.col(c) if isinstance(c, str) else c)).between(low, high)


def ticket_contract(ticket_id: str, subject: str, body: str, department: str, submitted_at: str) -> Column:
    """submitted_at is the raw text: a time without an offset is refused before any cast."""
    return broken(
        ticket_id=length_between(ticket_id, *LENGTHS["ticket_id"]) & F.btrim(ticket_id).rlike("^[A-Za-z0-9][A-Za-z0-9_-]*$"),
        subject=length_between(subject, *LENGTHS["subject"]) & ~unsafe_controls(subject),
        body=length_between(body, *LENGTHS["body"]) & ~unsafe_controls(body),
        employee_department=length_between(department, *LENGTHS["employee_department"]) & ~unsafe_controls(department),
        submitted_at=F.col(submitted_at).rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$") & F.expr(f"try_to_timestamp({submitted_at})").isNotNull(),
    )


@dataclass(frozen=True)
class Contract:
    """A pluggable contract for a prediction: closed labels, an evidence list, and a score in [0, 1]."""

    vocabulary: dict[str, list[str]] = field(default_factory=lambda: VOCABULARY)
    evidence: str | None = "evidence"
    score: str | None = "confidence"
    max_evidence: int = 5

    @property
    def fields(self) -> list[str]:
        return [*self.vocabulary, *filter(None, (self.evidence, self.score))]

    def rules(self, get, same: Column | None = None) -> dict[str, Column]:
        """Rules over typed columns; get(name) gives one. same: the evidence, normalised and case-folded, if it is at hand."""
        out = {name: get(name).isin(labels) for name, labels in self.vocabulary.items()}
        if self.evidence:
            items = get(self.evidence)
            same = normalize_items(items, fold=True) if same is None else same
            out[self.evidence] = F.size(items).between(1, self.max_evidence) & F.forall(items, lambda x: length_between(x, *LENGTHS["evidence"])) & (F.size(F.array_distinct(same)) == F.size(items))
        if self.score:
            s = get(self.score)
            out[self.score] = ~F.isnan(s) & s.between(0.0, 1.0)
        return out

    def check(self, prefix: str = "") -> Column:
        return broken(**self.rules(lambda n: F.col(prefix + n)))


def strict_json(raw: Column | str) -> Column:
    """The text as a VARIANT if it is exactly one JSON object, else null.

    Prose, fences, repeated keys and NaN are refused by the parser; trailing text by a wrapper whose last key, a digest
    of the text, must still be there.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw

    def value(x: Column) -> Column:
        keys, v = F.map_keys(x["wrapped"].cast("map<string,variant>")), F.try_variant_get(x["wrapped"], "$.v", "variant")
        good = F.coalesce(F.array_contains(keys, x["digest"]) & (F.size(keys) == 2), F.lit(False)) & F.schema_of_variant(v).startswith("OBJECT")
        return F.when(good, v)

    wrap = lambda x: F.struct(x["digest"], F.try_parse_json(F.concat(F.lit('{"v":'), x["raw"], F.lit(',"'), x["digest"], F.lit('":1}'))).alias("wrapped"))
    return once(once(F.struct(raw.alias("raw"), F.sha2(raw, 256).alias("digest")), wrap), value)


def check_raw_prediction(raw: Column | str, contract: Contract) -> Column:
    """Broken rules of raw model output: not_json_object, keys (missing or unknown), then the contract's own."""
    kinds = {n: "array<string>" if n == contract.evidence else "double" if n == contract.score else "string" for n in contract.fields}

    def parts(v: Column) -> Column:
        """All that the rules read of a prediction, typed; null for what is no object."""
        typed = [F.try_variant_get(v, f"$.{n}", kind).alias(f"f{place}") for place, (n, kind) in enumerate(kinds.items())]
        kind = F.schema_of_variant(F.try_variant_get(v, f"$.{contract.score}", "variant")) if contract.score else F.lit(None).cast("string")
        entries = join_items(F.try_variant_get(v, f"$.{contract.evidence}", "array<string>")) if contract.evidence else F.lit(None).cast("string")
        return F.when(v.isNotNull(), F.struct(F.array_sort(F.map_keys(v.cast("map<string,variant>"))).alias("keys"), kind.alias("kind"), entries.alias("entries"), *typed))

    # Chained, not nested: the Python function's argument holds no lambda within a lambda.
    read = once(once(strict_json(raw), parts), lambda v: F.struct(v.alias("v"), fold_joined(v["entries"], fold=True).alias("same")))
    place = list(kinds).index

    def verdict(x: Column) -> Column:
        v = x["read"]["v"]
        rules = contract.rules(lambda n: v[f"f{place(n)}"], part_items(F.coalesce(x["read"]["same"]["plain"], x["odd"])))
        if contract.score:
            rules[contract.score] = rules[contract.score] & v["kind"].rlike("^(BIGINT|DOUBLE|DECIMAL.*|FLOAT)$")  # a string or boolean is not coerced
        keys = v["keys"] == F.array(*map(F.lit, sorted(contract.fields)))
        return F.when(v.isNull(), F.array(F.lit("not_json_object"))).otherwise(F.concat(broken(keys=keys), broken(**rules)))

    odd = fold_odd(read["same"]["odd"], fold=True) if contract.evidence else F.lit(None).cast("string")
    return once(F.struct(read.alias("read"), odd.alias("odd")), verdict)


def _fits(gold, given) -> bool:
    """Whether a JSON value has the gold value's shape, all the way down; arrays follow the gold array's first entry."""
    if isinstance(gold, dict):
        return isinstance(given, dict) and gold.keys() == given.keys() and all(_fits(v, given[k]) for k, v in gold.items())
    if isinstance(gold, list):
        return isinstance(given, list) and (not gold or all(_fits(gold[0], x) for x in given))
    if isinstance(gold, float):
        return isinstance(given, (int, float)) and not isinstance(given, bool) and math.isfinite(given)
    return type(gold) is type(given)


@F.pandas_udf(BooleanType())
def _shapes_fit(gold: pd.Series, given: pd.Series) -> pd.Series:
    return pd.Series([g is not None and p is not None and _fits(json.loads(g), json.loads(p)) for g, p in zip(gold, given, strict=True)])


def same_shape(gold: Column, prediction: Column, extra: str = "confidence") -> Column:
    """Whether a VARIANT object has the gold object's keys and JSON types, nested ones included.

    Only extra may be added, a finite number within 0 and 1 or null. A fraction in gold accepts any number, a whole
    number only whole ones. Whatever is null is unlike everything. Only rows whose keys agree but whose values
    have another type than gold's reach the Python check of nested values.
    """
    as_map = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    keys = F.array_sort(F.map_keys(as_map(gold)))
    given = F.array_sort(F.filter(F.map_keys(as_map(prediction)), lambda k: F.array_contains(keys, k) | (k != extra)))
    sure = F.try_variant_get(prediction, f"$.{extra}", "variant")
    number = F.schema_of_variant(sure).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & F.try_variant_get(prediction, f"$.{extra}", "double").between(0.0, 1.0)
    sure_fits = F.array_contains(keys, extra) | sure.isNull() | (F.schema_of_variant(sure) == "VOID") | number
    alike = F.schema_of_variant(gold) == F.schema_of_variant(prediction)
    flat = alike & ~F.schema_of_variant(gold).contains("VARIANT")
    ask = (keys == given) & ~F.coalesce(flat, F.lit(False))
    own = lambda v: F.to_json(F.map_filter(as_map(v), lambda k, _: F.array_contains(keys, k)))
    nested = _shapes_fit(F.when(ask, own(gold)), F.when(ask, own(prediction)))
    return F.coalesce((keys == given) & F.coalesce(sure_fits, F.lit(False)) & F.coalesce(flat | nested, F.lit(False)), F.lit(False))


def example_contract(split: str, robustness: str, subject: str, body: str, evidence: str) -> Column:
    """A robustness category exactly on adversarial rows, and evidence that stands in subject and body."""
    text = normalize_text(F.concat_ws("\n", subject, body))
    return broken(
        robustness=(F.col(split) == "adversarial").eqNullSafe(F.col(robustness).isNotNull()) & (F.col(robustness).isNull() | F.col(robustness).isin(ROBUSTNESS)),
        evidence=F.forall(F.zip_with(evidence, F.array_repeat(text, F.size(evidence)), lambda x, t: contains_literal(t, F.btrim(F.regexp_replace(x, r"\s+", " ")))), lambda ok: ok),
    )


def manifest_violations(manifest: DataFrame, vocabulary: DataFrame, total: int) -> DataFrame:
    """Violations of a manifest (split, file, count, field, label, n in long form): (check, key)."""
    splits = manifest.select("split", "file", "count").distinct()
    twice = splits.groupBy("split").count().where("count > 1").select(F.lit("split_repeated").alias("check"), F.col("split").alias("key"))
    path = splits.where(~F.col("file").rlike(r"^(?!/)(?!.*(^|/)\.\.(/|$))[A-Za-z0-9._/-]+$")).select(F.lit("unsafe_path").alias("check"), F.col("file").alias("key"))
    sums = manifest.groupBy("split", "field").agg(F.sum("n").alias("n"), F.max("count").alias("count")).where("n <> count").select(F.lit("distribution_sum").alias("check"), F.concat_ws(".", "split", "field").alias("key"))
    gaps = manifest.select("split").distinct().crossJoin(vocabulary).join(manifest, ["split", "field", "label"], "left_anti").select(F.lit("label_missing").alias("check"), F.concat_ws(".", "split", "field", "label").alias("key"))
    whole = splits.agg(F.sum("count").alias("n")).where(~F.col("n").eqNullSafe(F.lit(total))).select(F.lit("total").alias("check"), F.col("n").cast("string").alias("key"))
    return twice.unionByName(path).unionByName(sums).unionByName(gaps).unionByName(whole)


def require_purpose(df: DataFrame, purpose: str, split_col: str = "split") -> DataFrame:
    """The rows that a purpose may read; an unknown purpose raises before any job."""
    if purpose not in PURPOSES:
        raise PermissionError(f"unknown purpose {purpose!r}")
    return df.where(F.col(split_col).isin(PURPOSES[purpose]))


def load_for(df: DataFrame, split: str, purpose: str, split_col: str = "split") -> DataFrame:
    """One split for a purpose that may read it, else an error."""
    if split not in PURPOSES.get(purpose, []):
        raise PermissionError(f"{purpose} may not read split {split}")
    return df.where(F.col(split_col) == split)


def verified_split(examples: DataFrame, manifest: DataFrame, split: str, purpose: str, id_col: str, key: str, label_key: str, fields: list[str], split_col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(rows of a split for a purpose, violations as check_ordinal, check, detail) against a manifest in long form.

    manifest: (split, count, digest, field, label, n), digest being prefix_digest of the keys. Checks run in this order, and
    the smallest ordinal is the first error: 0 no such split, 1 conflicting labels, 2 repeated keys, 3 count, 4 digest,
    5 label distribution. Labels that occur on one side only differ as well; rows
    without a label count in none. A purpose that may not read the split raises.
    """
    rows = load_for(examples, split, purpose, split_col)
    declared = manifest.where(F.col("split") == split)
    problem = lambda n, name, d, detail: d.select(F.lit(n).alias("check_ordinal"), F.lit(name).alias("check"), detail.cast("string").alias("detail"))
    head = declared.agg(F.max("count").alias("count"), F.max("digest").alias("digest"))
    counted = rows.agg(F.count(F.lit(1)).alias("n")).crossJoin(head)  # one row each
    digest = prefix_digest(rows, key).select(F.col("digest").alias("actual")).crossJoin(head)
    shares = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields))).alias("x")).select("x.*").where("label IS NOT NULL").groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"))
    differ = full_diff(declared.where("n > 0").select("field", "label", "n"), shares, ["field", "label"], "n")
    found = (
        problem(0, "split_missing", head.where("count IS NULL"), F.lit(split))
        .unionByName(problem(1, "conflicting_labels", conflicts(rows, key, label_key, id_col), F.col("first_id")))
        .unionByName(problem(2, "duplicate_input", duplicates(rows, key, id_col), F.col("id")))
        .unionByName(problem(3, "count", counted.where("n <> count"), F.col("n")))
        .unionByName(problem(4, "fingerprint_digest", digest.where("actual <> digest"), F.col("actual")))
        .unionByName(problem(5, "label_distribution", differ, F.concat_ws(".", "field", "label")))
    )
    return rows, found


def pricing_contract(input_price: str, output_price: str, source: str, as_of: str) -> Column:
    """A price above zero needs its source and date; source and date come together."""
    both = F.col(source).isNotNull() & F.col(as_of).isNotNull()
    free = (F.col(input_price) == 0) & (F.col(output_price) == 0)
    return broken(prices=(F.col(input_price) >= 0) & (F.col(output_price) >= 0), provenance=both | (free & F.col(source).isNull() & F.col(as_of).isNull()))


def accounting_contract(summary: DataFrame) -> DataFrame:
    """One-row balance checks of a population summary: (check, ok)."""
    checks = {"outcomes": "errors + returned = total", "returned": "valid + invalid = returned", "exact": "exact <= valid", "wrong": "wrong = returned - exact"}
    return summary.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), F.expr(v).alias("ok")) for k, v in checks.items()))).alias("x")).select("x.*")
