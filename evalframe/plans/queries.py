"""The registered queries of the evaluation operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import routing_score, text
from ..operators import contracts, costs, dataset, judge, regression, routing, scoring, sft, stats
from ..sources.shared import new_folder
from ..streaming import telemetry
from . import derived
from .derived import ITEMS_SQL, items, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


NORM = r"trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\t\n\v\f\r\x1C-\x20]+', ' ', 'g'), ' ')"
KEYED = f"n AS (SELECT doc_id, lang, source, n_chars, {NORM} AS norm FROM documents), k AS (SELECT *, sha256('{{\"body\":' || to_json(norm)::VARCHAR || ',\"lang\":' || to_json(lang)::VARCHAR || '}}') AS fp FROM n)"


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the fingerprint of their normalised text and language."""
    return docs(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", F.expr(derived.SPLIT.format(k="doc_id")).alias("split"), text.normalize_text("text", fold=True).alias("body")).withColumn("fp", text.canonical_sha256(body="body", lang="lang"))


@query(f"WITH n AS (SELECT doc_id, {NORM} AS norm FROM documents) SELECT doc_id, sha256(norm) AS norm_sha256, length(norm)::INT AS length FROM n")
def normalized_text(spark, sf_dir):
    n = text.normalize_text("text", fold=True)
    return docs(spark, sf_dir).select("doc_id", n.alias("n")).select("doc_id", F.sha2("n", 256).alias("norm_sha256"), F.length("n").alias("length"))


@query(f"WITH {KEYED} SELECT doc_id, fp FROM k")
def fingerprints(spark, sf_dir):
    return keyed(spark, sf_dir).select("doc_id", "fp")


@query(f"WITH {KEYED}, w AS (SELECT fp, doc_id AS id, lag(doc_id) OVER o AS previous_id, first_value(doc_id) OVER o AS first_id FROM k WINDOW o AS (PARTITION BY fp ORDER BY doc_id)) SELECT * FROM w WHERE previous_id IS NOT NULL")
def duplicate_inputs(spark, sf_dir):
    return dataset.duplicates(keyed(spark, sf_dir).select("fp", "doc_id"), "fp", "doc_id")


@query(f"WITH {KEYED}, s AS (SELECT fp, {derived.SPLIT.format(k='doc_id')} AS split FROM k) SELECT fp, array_to_string(list_sort(list(DISTINCT split)), ',') AS splits, count(*) AS rows FROM s GROUP BY fp HAVING count(DISTINCT split) > 1")
def cross_split_leakage(spark, sf_dir):
    return dataset.leakage(keyed(spark, sf_dir), "fp", "split").withColumn("splits", F.array_join("splits", ","))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keyed() and label, a digest of all of a document's labels; null without any."""
    labels = table(spark, sf_dir, "labels").select("doc_id", text.label_fingerprint(quality=F.col("quality"), toxic=F.col("toxic")).alias("label"))
    return keyed(spark, sf_dir).join(labels, "doc_id", "left")


@query(f"""WITH {KEYED} SELECT fp, count(DISTINCT (quality, toxic)) AS labels, count(*) AS rows, min(doc_id) AS first_id FROM k JOIN labels USING (doc_id)
GROUP BY fp HAVING count(DISTINCT (quality, toxic)) > 1""")
def label_conflicts(spark, sf_dir):
    """Whole texts that occur with different labels."""
    return dataset.conflicts(labelled(spark, sf_dir).where("label IS NOT NULL"), "fp", "label", "doc_id")


@query(f"WITH {KEYED} SELECT substr(norm, 1, 20) AS prefix, count(DISTINCT quality) AS labels, count(*) AS rows, min(doc_id) AS first_id FROM k JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def conflicting_labels(spark, sf_dir):
    """Labels that differ among documents which begin alike: a place to look, no proof. label_conflicts compares whole texts."""
    rows = keyed(spark, sf_dir).select("doc_id", F.substring("body", 1, 20).alias("prefix")).join(table(spark, sf_dir, "labels"), "doc_id")
    return dataset.conflicts(rows, "prefix", "quality", "doc_id")


VOCAB = "v AS (SELECT * FROM (VALUES ('quality', '0'), ('quality', '1'), ('quality', '2'), ('toxic', '0'), ('toxic', '1')) AS t(field, label))"


@query(f"""WITH {VOCAB}, l AS (SELECT 'quality' AS field, quality::VARCHAR AS label FROM labels UNION ALL SELECT 'toxic', toxic::VARCHAR FROM labels),
c AS (SELECT field, label, count(*) AS n FROM l GROUP BY ALL) SELECT v.field, v.label, coalesce(n, 0)::BIGINT AS n FROM v LEFT JOIN c USING (field, label)""")
def label_distribution(spark, sf_dir):
    vocabulary = spark.createDataFrame([("quality", "0"), ("quality", "1"), ("quality", "2"), ("toxic", "0"), ("toxic", "1")], "field string, label string")
    return dataset.label_distribution(table(spark, sf_dir, "labels"), vocabulary, ["quality", "toxic"])


@query(f"WITH {KEYED}, s AS (SELECT DISTINCT {derived.SPLIT.format(k='doc_id')} AS split, fp FROM k) SELECT split, count(fp) AS keys, sha256(string_agg(fp, chr(10) ORDER BY fp) || chr(10)) AS digest FROM s GROUP BY split")
def fingerprint_set_digest(spark, sf_dir):
    """One task sees all keys of a split, as one digest of all asks for; fingerprint_prefix_digest is the form for many."""
    return dataset.set_digest(keyed(spark, sf_dir), "fp", ["split"])


@query(f"""WITH {KEYED}, s AS (SELECT DISTINCT {derived.SPLIT.format(k='doc_id')} AS split, fp FROM k), p AS (SELECT split, substr(fp, 1, 3) AS prefix, count(fp) AS n, sha256(string_agg(fp, chr(10) ORDER BY fp) || chr(10)) AS d FROM s GROUP BY 1, 2)
SELECT split, sum(n)::BIGINT AS keys, sha256(string_agg(d, chr(10) ORDER BY prefix)) AS digest FROM p GROUP BY split""")
def fingerprint_prefix_digest(spark, sf_dir):
    return dataset.prefix_digest(keyed(spark, sf_dir), "fp", by=["split"])


KEYED_NULLS = KEYED.replace("to_json(norm)::VARCHAR", "coalesce(to_json(norm)::VARCHAR, 'null')").replace("to_json(lang)::VARCHAR", "coalesce(to_json(lang)::VARCHAR, 'null')")


@query(f"""WITH {KEYED_NULLS}, s AS (SELECT k.doc_id, fp, {derived.SPLIT.format(k='k.doc_id')} AS split, CASE WHEN l.doc_id IS NOT NULL THEN (quality, toxic) END AS label FROM k LEFT JOIN labels l ON k.doc_id = l.doc_id),
d AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY fp ORDER BY doc_id NULLS FIRST) AS p FROM s),
v AS (SELECT 'split_missing' AS "check", 0 AS check_ordinal FROM (VALUES ('train'), ('validation'), ('test'), ('adversarial')) AS w(split) WHERE split NOT IN (SELECT split FROM s)
UNION ALL SELECT 'conflicting_labels', 1 FROM (SELECT fp FROM s GROUP BY fp HAVING count(DISTINCT label) > 1) UNION ALL SELECT 'duplicate_id', 2 FROM (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_input', 3 FROM d WHERE p IS NOT NULL UNION ALL SELECT 'cross_split_leakage', 4 FROM (SELECT fp FROM s GROUP BY fp HAVING count(DISTINCT split) > 1))
SELECT "check", check_ordinal, count(*) AS n FROM v GROUP BY ALL""")
def dataset_violations(spark, sf_dir):
    found = dataset.validate_dataset(labelled(spark, sf_dir), "doc_id", "fp", "label", "split", ["train", "validation", "test", "adversarial"])
    return found.groupBy("check", "check_ordinal").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(replace(lower(d.text), 'ß', 'ss'), '\\s+', ' ', 'g')), trim(regexp_replace(replace(lower(b.text), 'ß', 'ss'), '\\s+', ' ', 'g')))")
def benchmark_containment(spark, sf_dir):
    return dataset.containment(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("""WITH w AS (SELECT doc_id, lower(text) AS t, [lang || ' ', 'the', 'von', ' ', 'of the'] AS e FROM documents), f AS (SELECT doc_id, t, list_filter(e, lambda x: trim(x) <> '') AS e FROM w)
SELECT doc_id, len(e)::INT AS total, len(list_filter(e, lambda x: contains(t, x)))::INT AS grounded, (len(e) - len(list_filter(e, lambda x: contains(t, x))))::INT AS unsupported FROM f""")
def evidence_counts(spark, sf_dir):
    evidence = F.array(F.concat("lang", F.lit(" ")), F.lit("the"), F.lit("von"), F.lit(" "), F.lit("of the"))
    return docs(spark, sf_dir).select("doc_id", text.evidence_counts(evidence, F.lower("text")).alias("c")).select("doc_id", "c.*")


@query(f"WITH {ITEMS_SQL} SELECT expected_quality::VARCHAR AS expected, predicted_quality::VARCHAR AS predicted, count(*) AS weight FROM items WHERE status = 'scored' GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    scored = items(spark, sf_dir).where("status = 'scored'").select(F.col("expected_quality").cast("string").alias("e"), F.col("predicted_quality").cast("string").alias("p"))
    return scoring.confusion(scored, "e", "p")


CLASSES = """c AS (SELECT l.label, coalesce(sum(w) FILTER (WHERE e = l.label), 0)::DOUBLE AS support, coalesce(sum(w) FILTER (WHERE p = l.label), 0)::DOUBLE AS predicted,
  coalesce(sum(w) FILTER (WHERE e = l.label AND p = l.label), 0)::DOUBLE AS correct FROM labels_ l LEFT JOIN m ON e = l.label OR p = l.label GROUP BY l.label),
r AS (SELECT *, CASE WHEN predicted > 0 THEN correct / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN correct / support ELSE 0 END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""
LINE_MATRIX = "m AS (SELECT l_returnflag AS e, CASE WHEN l_orderkey % 7 = 0 THEN 'A' WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END AS p, l_quantity::DOUBLE AS w FROM lineitem), labels_ AS (SELECT unnest(['A', 'N', 'R', 'X']) AS label)"


def line_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS e", "CASE WHEN l_orderkey % 7 = 0 THEN 'A' WHEN l_linenumber % 3 = 0 THEN 'N' ELSE l_returnflag END AS p", "CAST(l_quantity AS DOUBLE) AS w")
    return scoring.confusion(rows, "e", "p", "w")


@query(f"WITH {LINE_MATRIX}, {CLASSES} SELECT label, support, predicted, correct, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def classification_report(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in "ANRX"], "label string")
    return scoring.per_class(line_matrix(spark, sf_dir), labels)


@query(f"WITH {LINE_MATRIX}, {CLASSES} SELECT round(sum(correct) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM f")
def macro_scores(spark, sf_dir):
    labels = spark.createDataFrame([(x,) for x in "ANRX"], "label string")
    return scoring.macro(scoring.per_class(line_matrix(spark, sf_dir), labels))


@query(f"""WITH {ITEMS_SQL}, g AS (SELECT CASE WHEN grouping(slice) = 1 THEN 'ALL' ELSE slice END AS scope, count(*) AS total, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status <> 'error') AS returned,
  count(*) FILTER (status = 'scored') AS valid, count(*) FILTER (status = 'schema_invalid') AS invalid, count(*) FILTER (exact_match) AS exact, round(avg(match_quality::INT), 6) AS accuracy_quality, round(avg(match_toxic::INT), 6) AS accuracy_toxic
  FROM items GROUP BY GROUPING SETS ((), (slice)))
SELECT *, returned - exact AS wrong, round(errors / total, 6) AS error_rate, round(valid / nullif(returned, 0), 6) AS schema_validity_rate, round(exact / nullif(returned, 0), 6) AS exact_match_rate FROM g""")
def evaluation_summary(spark, sf_dir):
    return scoring.summarize(items(spark, sf_dir), ["quality", "toxic"], "slice")


OBS = f"{ITEMS_SQL}, obs AS (SELECT confidence AS score, coalesce(exact_match, false) AS correct FROM items WHERE status <> 'error')"


@query(f"""WITH {OBS}, b AS (SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, avg(score) AS mean_score, avg(correct::INT) AS accuracy FROM obs GROUP BY 1)
SELECT r.bin::INT AS bin, round(r.bin / 10, 6) AS lower, round((r.bin + 1) / 10, 6) AS upper, coalesce(n, 0)::BIGINT AS n, round(mean_score, 6) AS mean_score, round(accuracy, 6) AS accuracy FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin""")
def calibration_bins(spark, sf_dir):
    return stats.calibration_bins(stats.calibration_input(items(spark, sf_dir)))


@query(f"""WITH {OBS}, b AS (SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS s, avg(correct::INT) AS a FROM obs GROUP BY 1)
SELECT round(sum(n * abs(s - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""")
def calibration_error(spark, sf_dir):
    return stats.expected_calibration_error(stats.calibration_bins(stats.calibration_input(items(spark, sf_dir))))


@query(f"""WITH {OBS}, p AS (SELECT round(score, 4) AS score, count(*) AS n, count(*) FILTER (correct) AS good FROM obs GROUP BY 1),
c AS (SELECT score, (sum(n) OVER o)::BIGINT AS accepted, sum(good) OVER o AS ok, sum(n) OVER () AS total FROM p WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT score, accepted, round(accepted / total, 6) AS coverage, round(1 - ok / accepted, 6) + 0.0 AS risk FROM c""")
def risk_coverage(spark, sf_dir):
    return stats.risk_coverage(stats.calibration_input(items(spark, sf_dir)))


FAILED = f"""{ITEMS_SQL}, x AS (SELECT doc_id AS id, unnest(list_filter([CASE WHEN status = 'error' THEN 'prediction_error' END, CASE WHEN status = 'schema_invalid' THEN 'schema_invalid' END,
  CASE WHEN NOT match_quality THEN 'quality_mismatch' END, CASE WHEN NOT match_toxic THEN 'toxic_mismatch' END, CASE WHEN NOT match_quality AND NOT match_toxic THEN 'multiple_field_mismatch' END], lambda c: c IS NOT NULL)) AS category FROM items)"""


@query(f"""WITH {FAILED}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY id) AS place FROM x)
SELECT category, count(*) AS n, count(DISTINCT id) AS cases, array_to_string(list_sort(list(id) FILTER (place <= 3)), ',') AS examples FROM r GROUP BY category""")
def failure_taxonomy(spark, sf_dir):
    rows = scoring.failure_rows(items(spark, sf_dir), "doc_id", ["quality", "toxic"], names={"quality": "quality_mismatch", "toxic": "toxic_mismatch"})
    return scoring.failure_taxonomy(rows).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("""WITH p AS (SELECT l_returnflag AS scope, l_extendedprice::DOUBLE AS v, sum(l_quantity)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT scope, v, sum(w) OVER (PARTITION BY scope ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY scope) AS total FROM p)
SELECT scope, round(min(v) FILTER (cum >= 0.5::DOUBLE * total), 6) AS p50, round(min(v) FILTER (cum >= 0.95::DOUBLE * total), 6) AS p95 FROM c GROUP BY scope""")
def weighted_percentiles(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS scope", "CAST(l_extendedprice AS DOUBLE) AS v", "CAST(l_quantity AS DOUBLE) AS w")
    return stats.weighted_percentile(rows, "v", "w", [0.5, 0.95], ["scope"])


@query("SELECT event_type AS model_selected, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return stats.percentile(derived.events(spark, sf_dir), "latency_ms", [0.5, 0.95], ["model_selected"])


SWEEP = """b AS (SELECT o_orderkey AS k, o_orderpriority AS slice, (1 + o_orderkey % 5)::DOUBLE AS w, ((o_orderkey * 7919) % 1000)::DOUBLE / 1000 AS s FROM orders),
t AS (SELECT unnest([0.0, 0.5, 0.85, 0.95])::DOUBLE AS threshold),
d AS (SELECT *, (k % 20 = 1 OR s < threshold) AS up FROM b, t),
e AS (SELECT *, CASE WHEN up THEN k % 50 = 7 ELSE k % 20 = 1 END AS err, CASE WHEN up THEN k % 50 <> 7 ELSE k % 20 <> 1 END AS ok,
  CASE WHEN up THEN k % 10 <> 3 AND k % 50 <> 7 ELSE k % 4 <> 0 AND k % 20 <> 1 END AS hit,
  (20 + k % 50)::DOUBLE + CASE WHEN up THEN 200 + k % 300 ELSE 0 END AS lat, 0.0001::DOUBLE + CASE WHEN up THEN 0.002::DOUBLE ELSE 0 END AS cost FROM d),
g AS (SELECT threshold, CASE WHEN grouping(slice) = 1 THEN 'ALL' ELSE slice END AS scope, sum(w) AS weight, sum(w * up::INT) / sum(w) AS frontier_share, sum(w * err::INT) / sum(w) AS error_rate,
  sum(w * (NOT err AND ok)::INT) / sum(w * (NOT err)::INT) AS schema_validity_rate, sum(w * (NOT err AND hit)::INT) / sum(w * (NOT err)::INT) AS exact_match_rate, sum(w * lat) / sum(w) AS avg_latency_ms,
  sum(w * cost) / sum(w) AS avg_cost_usd, 100 * sum(w * (NOT up AND NOT hit)::INT) / sum(w) AS overconfident_per_100 FROM e GROUP BY GROUPING SETS ((threshold), (threshold, slice)))"""


def swept(spark, sf_dir):
    return routing.sweep(routing.routed(derived.branches(spark, sf_dir), [0.0, 0.5, 0.85, 0.95]), "slice")


@query(f"WITH {SWEEP} SELECT threshold, scope, weight, round(frontier_share, 6) AS frontier_share, round(error_rate, 6) AS error_rate, round(schema_validity_rate, 6) AS schema_validity_rate, round(exact_match_rate, 6) AS exact_match_rate, round(avg_latency_ms, 6) AS avg_latency_ms, round(avg_cost_usd, 6) AS avg_cost_usd, round(overconfident_per_100, 6) AS overconfident_per_100 FROM g")
def routing_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@query(f"WITH {SWEEP} SELECT threshold, round(exact_match_rate * (1 - error_rate), 6) AS quality, round(avg_cost_usd, 6) AS avg_cost_usd, round(frontier_share, 6) AS frontier_share FROM g WHERE scope = 'ALL'")
def quality_cost(spark, sf_dir):
    return routing.quality_cost(swept(spark, sf_dir))


RULES = """c AS (SELECT doc_id, lang, n_chars, lower(text) AS t FROM documents),
a AS (SELECT doc_id, n_chars, round(greatest(0, 1.0::DOUBLE - CASE WHEN length(trim(regexp_replace(replace(t, 'ß', 'ss'), '\\s+', ' ', 'g'))) < 45 THEN 0.3::DOUBLE ELSE 0 END
  - CASE WHEN lang = 'de' THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN lang = 'fr' THEN 0.15::DOUBLE ELSE 0 END), 4) AS ambiguity,
  CASE WHEN doc_id % 10 = 0 THEN NULL ELSE ((doc_id * 7919) % 1000)::DOUBLE / 1000 END AS sure FROM c),
s AS (SELECT doc_id, ambiguity, doc_id % 25 = 3 AS hard_failure, CASE WHEN doc_id % 25 = 3 THEN 0 ELSE round(greatest(0, least(1, least(ambiguity, exp((0.25 * ln(greatest(ambiguity, 1e-6)) + coalesce(0.15 * ln(greatest(sure, 1e-6)), 0))
  / (0.6::DOUBLE + CASE WHEN sure IS NULL THEN 0 ELSE 0.15::DOUBLE END))))), 4) END AS score FROM a)"""


def assessed(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "lang", text.normalize_text("text", fold=True).alias("t"))
    issue, scope = F.when(F.col("lang") == "de", "OTHER_IAM").otherwise("MFA_FAILURE"), F.when(F.col("lang") == "fr", "UNKNOWN").otherwise("SINGLE_USER")
    unclear, reasons = routing_score.ambiguity(F.lit(""), F.col("t"), issue, scope)
    d = d.select("doc_id", F.round(unclear, 4).alias("ambiguity"), reasons.alias("reasons"))
    sure = F.when(F.col("doc_id") % 10 != 0, ((F.col("doc_id") * 7919) % 1000).cast("double") / 1000)
    valid = F.col("doc_id") % 25 != 3
    parts = {"structural": F.lit(1.0), "evidence_grounding": F.lit(1.0), "ambiguity": F.col("ambiguity"), "self_reported": sure}
    score, hard = routing_score.routing_score(parts, valid)
    return d.select("doc_id", "ambiguity", hard.alias("hard_failure"), score.alias("score"))


@query(f"WITH {RULES} SELECT * FROM s")
def confidence_assessment(spark, sf_dir):
    return assessed(spark, sf_dir)


@query(f"WITH {RULES} SELECT doc_id, doc_id % 20 = 1 OR score < 0.85 AS escalate, CASE WHEN doc_id % 20 = 1 THEN 'small_model_error' WHEN score < 0.85 THEN 'low_confidence' ELSE 'small_confident' END AS reason FROM s")
def route_decisions(spark, sf_dir):
    escalate, reason = routing_score.route(F.col("doc_id") % 20 != 1, F.col("score"), 0.85)
    return assessed(spark, sf_dir).select("doc_id", escalate.alias("escalate"), reason.alias("reason"))


HUMAN = """h AS (SELECT doc_id AS case_id, quality = 1 AS relevant, toxic = 1 AS unsupported, (doc_id % 101)::DOUBLE / 100 AS score FROM labels),
j AS (SELECT doc_id AS case_id, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status, doc_id % 6 <> 0 AS relevant, doc_id % 9 = 0 AS unsupported, (doc_id % 17)::DOUBLE / 16 AS score FROM labels WHERE doc_id % 13 <> 0),
m AS (SELECT h.*, j.status, j.relevant AS jr, j.unsupported AS ju, j.score AS js, coalesce(j.status = 'ok', false) AS ok, h.relevant AND NOT h.unsupported AS acc, CASE WHEN j.status = 'ok' THEN j.relevant AND NOT j.unsupported END AS jacc FROM h LEFT JOIN j USING (case_id)),
p AS (SELECT * FROM m WHERE ok), q AS (SELECT count(*) AS n, avg((relevant = jr)::INT) AS ar, avg(relevant::INT) AS r1, avg(jr::INT) AS r2, avg((unsupported = ju)::INT) AS au, avg(unsupported::INT) AS u1, avg(ju::INT) AS u2 FROM p),
k AS (SELECT CASE WHEN r1 * r2 + (1 - r1) * (1 - r2) >= 1 THEN ar::INT ELSE (ar - (r1 * r2 + (1 - r1) * (1 - r2))) / (1 - (r1 * r2 + (1 - r1) * (1 - r2))) END AS relevant_kappa,
  CASE WHEN u1 * u2 + (1 - u1) * (1 - u2) >= 1 THEN au::INT ELSE (au - (u1 * u2 + (1 - u1) * (1 - u2))) / (1 - (u1 * u2 + (1 - u1) * (1 - u2))) END AS unsupported_kappa FROM q),
rk AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY js) + (count(*) OVER (PARTITION BY js) - 1) / 2.0::DOUBLE AS b FROM p),
sp AS (SELECT (avg(a * b) - avg(a) * avg(b)) / sqrt((avg(a * a) - avg(a) ** 2) * (avg(b * b) - avg(b) ** 2)) AS spearman FROM rk)"""


def reviews(spark, sf_dir):
    human = table(spark, sf_dir, "labels").selectExpr("doc_id AS case_id", "quality = 1 AS relevant", "toxic = 1 AS unsupported", "CAST(doc_id % 101 AS DOUBLE) / 100 AS score")
    judged = table(spark, sf_dir, "labels").where("doc_id % 13 <> 0").selectExpr("doc_id AS case_id", "CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS status", "doc_id % 6 <> 0 AS relevant", "doc_id % 9 = 0 AS unsupported", "CAST(doc_id % 17 AS DOUBLE) / 16 AS score")
    return human, judged


@query(f"""WITH {HUMAN} SELECT count(*) AS reviews, count(*) FILTER (ok) AS matched, count(*) FILTER (status IS NULL) AS missing, count(*) FILTER (status = 'error') AS errors, round(avg((relevant = jr)::INT) FILTER (ok), 6) AS relevance_agreement,
  round(avg((unsupported = ju)::INT) FILTER (ok), 6) AS unsupported_agreement, round(avg((relevant = jr AND unsupported = ju)::INT) FILTER (ok), 6) AS joint_agreement, count(*) FILTER (NOT acc AND jacc) AS false_accepts,
  count(*) FILTER (NOT acc AND jacc IS NOT NULL) AS human_rejects, count(*) FILTER (acc AND NOT jacc) AS false_rejects, count(*) FILTER (acc AND jacc IS NOT NULL) AS human_accepts,
  round(count(*) FILTER (NOT acc AND jacc) / count(*) FILTER (NOT acc AND jacc IS NOT NULL), 6) AS false_accept_rate, round(count(*) FILTER (acc AND NOT jacc) / count(*) FILTER (acc AND jacc IS NOT NULL), 6) AS false_reject_rate,
  round(any_value(relevant_kappa), 6) AS relevant_kappa, round(any_value(unsupported_kappa), 6) AS unsupported_kappa, round(any_value(spearman), 6) AS spearman FROM m, k, sp""")
def judge_validation(spark, sf_dir):
    return judge.validate_judge(judge.join_reviews(*reviews(spark, sf_dir)))


@query(f"""WITH {ITEMS_SQL}, h AS (SELECT doc_id, quality = 1 AS human_relevant FROM labels WHERE doc_id % 3 = 0), j AS (SELECT doc_id, doc_id % 6 <> 0 AS judge_relevant, CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END AS judge_status FROM labels WHERE doc_id % 13 <> 0)
SELECT doc_id, status, human_relevant, CASE WHEN h.doc_id IS NULL THEN 'missing' ELSE 'reviewed' END AS human_status, judge_relevant, coalesce(judge_status, 'missing') AS judge_status FROM items LEFT JOIN h USING (doc_id) LEFT JOIN j USING (doc_id)""")
def evidence_comparison(spark, sf_dir):
    human, judged = (d.withColumnRenamed("case_id", "doc_id") for d in reviews(spark, sf_dir))
    return judge.evidence_comparison(items(spark, sf_dir).select("doc_id", "status"), human.where("doc_id % 3 = 0"), judged, "doc_id")


METRICS = ["error_rate", "schema_validity_rate", "exact_match_rate"]
POLICY = [("ALL", "error_rate", "max", 0.04), ("ALL", "exact_match_rate", "min", 0.9), ("en", "schema_validity_rate", "min", 0.99), ("xx", "exact_match_rate", "min", 0.5)]
GATE = f"""{ITEMS_SQL}, g AS (SELECT CASE WHEN grouping(slice) = 1 THEN 'ALL' ELSE slice END AS scope, count(*) FILTER (status = 'error') / count(*) AS error_rate, count(*) FILTER (status = 'scored') / count(*) FILTER (status <> 'error') AS schema_validity_rate,
  count(*) FILTER (exact_match) / count(*) FILTER (status <> 'error') AS exact_match_rate FROM items GROUP BY GROUPING SETS ((), (slice))),
l AS (UNPIVOT g ON error_rate, schema_validity_rate, exact_match_rate INTO NAME metric VALUE value), p AS (SELECT * FROM (VALUES {", ".join(f"('{s}', '{m}', '{o}', {t}::DOUBLE)" for s, m, o, t in POLICY)}) AS t(scope, metric, op, threshold)),
v AS (SELECT CASE WHEN op = 'min' AND value < threshold THEN 'floor_failed' WHEN op = 'max' AND value > threshold THEN 'ceiling_failed' END AS code, p.scope, p.metric, round(value, 6) AS actual, threshold FROM p JOIN l ON p.scope = l.scope AND p.metric = l.metric
  UNION ALL SELECT DISTINCT 'slice_missing', scope, 'slice', NULL, NULL FROM p WHERE scope NOT IN (SELECT scope FROM g))"""


def violations(spark, sf_dir):
    metrics = regression.long_metrics(scoring.summarize(items(spark, sf_dir), ["quality", "toxic"], "slice"), METRICS)
    return regression.apply_policy(metrics, spark.createDataFrame(POLICY, "scope string, metric string, op string, threshold double"))


@query(f"WITH {GATE} SELECT * FROM v WHERE code IS NOT NULL")
def regression_gate(spark, sf_dir):
    return violations(spark, sf_dir)


@query(f"WITH {GATE} SELECT CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END AS status, 0::BIGINT AS differences, count(*) AS violations FROM v WHERE code IS NOT NULL")
def gate_verdict(spark, sf_dir):
    identity = items(spark, sf_dir).agg(F.count(F.lit(1)).alias("case_count"), F.max("doc_id").alias("last_id"))
    return regression.verdict(regression.compare_identities(identity, identity, ["case_count", "last_id"]), violations(spark, sf_dir))


@query("""WITH a AS (SELECT count(*)::VARCHAR AS case_count, max(doc_id)::VARCHAR AS last_id, NULL::VARCHAR AS judge_identity FROM labels), b AS (SELECT count(*)::VARCHAR AS case_count, max(doc_id)::VARCHAR AS last_id, NULL::VARCHAR AS judge_identity FROM labels WHERE toxic = 0)
SELECT 'case_count' AS field, a.case_count AS "left", b.case_count AS "right" FROM a, b WHERE a.case_count IS DISTINCT FROM b.case_count UNION ALL SELECT 'last_id', a.last_id, b.last_id FROM a, b WHERE a.last_id IS DISTINCT FROM b.last_id""")
def run_comparability(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    identity = lambda d: d.agg(F.count(F.lit(1)).alias("case_count"), F.max("doc_id").alias("last_id"), F.lit(None).cast("string").alias("judge_identity"))
    return regression.compare_identities(identity(labels), identity(labels.where("toxic = 0")), ["case_count", "last_id", "judge_identity"])


EVENTS = "e AS (SELECT ts, event_type AS model_selected, event_type = 'error' AS err, event_id % 4 = 0 AS fb, event_id % 50 = 0 AS sf, value AS lat, (event_id % 1000)::DOUBLE / 1000000 AS cost FROM events)"
RATES = "count(*) AS events, round(avg(err::INT), 6) AS error_rate, round(avg(fb::INT), 6) AS fallback_rate, round(avg(sf::INT), 6) AS schema_failure_rate, round(avg(lat), 6) AS avg_latency_ms, round(sum(cost), 6) AS cost_usd"


@query(f"WITH {EVENTS} SELECT {RATES}, round(quantile_disc(lat, 0.5), 6) AS p50_latency_ms, round(quantile_disc(lat, 0.95), 6) AS p95_latency_ms FROM e")
def telemetry_summary(spark, sf_dir):
    return telemetry.summarize(derived.events(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT date_trunc('day', ts) AS window_start, model_selected, {RATES} FROM e GROUP BY 1, 2")
def telemetry_windows(spark, sf_dir):
    out = telemetry.rollup(derived.events(spark, sf_dir), "1 day")
    return out.drop("window_end", "p50_latency_ms", "p95_latency_ms", "latencies", "latency_sketch").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {EVENTS} SELECT date_trunc('day', ts) AS window_start, model_selected, {RATES} FROM e GROUP BY 1, 2")
def streaming_telemetry(spark, sf_dir):
    """The same rollup by Structured Streaming over the events file, to the end of its input, kept in a table in the shared folder."""
    folder = sf_dir.rstrip("/").replace("file://", "")
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder) if not _is_dir(spark, sf_dir) else spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet")
    target, state = new_folder(spark, "rollup"), new_folder(spark, "state")
    rows = source.selectExpr("CAST(ts AS TIMESTAMP) AS timestamp", "event_type AS model_selected", "CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status", "event_id % 4 = 0 AS fallback", "event_id % 50 = 0 AS schema_failure", "value AS latency_ms", "CAST(event_id % 1000 AS DOUBLE) / 1000000 AS estimated_cost_usd")
    whole = lambda batch, _: batch.write.mode("overwrite").parquet(target)  # noqa: E731  (each batch has the whole result so far)
    telemetry.rollup(rows, "1 day").writeStream.foreachBatch(whole).option("checkpointLocation", state).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).drop("window_end", "p50_latency_ms", "p95_latency_ms", "latencies", "latency_sketch").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def _is_dir(spark: SparkSession, sf_dir: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


PRICES = [("user", 2.0, 8.0), ("assistant", 0.5, 1.5)]


@query("""WITH p AS (SELECT * FROM (VALUES ('user', 2.0::DOUBLE, 8.0::DOUBLE), ('assistant', 0.5::DOUBLE, 1.5::DOUBLE)) AS t(role, i, o))
SELECT role, count(*) AS calls, round(sum(round((length(text) * i + (turn + 1) * o) / 1e6, 10)), 6) AS cost_usd FROM conversations JOIN p USING (role) GROUP BY role""")
def token_costs(spark, sf_dir):
    usage = table(spark, sf_dir, "conversations").select("role", F.length("text").alias("input_tokens"), (F.col("turn") + 1).alias("output_tokens"))
    prices = spark.createDataFrame(PRICES, "role string, input_usd_per_million double, output_usd_per_million double")
    return costs.with_prices(usage, prices, ["role"]).where("cost_usd IS NOT NULL").groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum("cost_usd").alias("cost_usd"))


TOKENS = """t AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': coalesce(text, '')} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
a AS (SELECT conv_id, list_aggregate(list_transform(m[:-2], lambda x: '<' || x.role || '> ' || x.text), 'string_agg', chr(10)) AS p0, m[-1].text AS r FROM t WHERE m[-1].role = 'assistant'),
w AS (SELECT conv_id, len(list_filter(string_split_regex(coalesce(p0, '') || chr(10) || '<assistant> ', '\\s+'), lambda x: x <> '')) AS np, len(list_filter(string_split_regex(r, '\\s+'), lambda x: x <> '')) AS nr FROM a)"""


def masked(spark, sf_dir):
    prompt, response = sft.render(F.col("messages"))
    rows = sft.conversations(table(spark, sf_dir, "conversations")).select("conv_id", prompt.alias("prompt"), response.alias("response"))
    return sft.response_only(rows, "prompt", "response", 256)


@query(f"WITH {TOKENS} SELECT conv_id, least(np + nr, 256)::INT AS n_tokens, greatest(least(np + nr, 256) - np, 0)::INT AS supervised_tokens, np + nr > 256 AS was_truncated, np >= 256 AND nr > 0 AS lost_response FROM w")
def sft_masks(spark, sf_dir):
    return masked(spark, sf_dir).select("conv_id", F.size("tokens").alias("n_tokens"), "supervised_tokens", "was_truncated", "lost_response")


@query(f"WITH {TOKENS} SELECT count(*) AS rows, 0::BIGINT AS bad_rows, count(*) FILTER (np + nr > 256) AS truncated, sum(greatest(least(np + nr, 256) - np, 0))::BIGINT AS supervised_tokens FROM w")
def sft_audit(spark, sf_dir):
    return sft.audit_masks(masked(spark, sf_dir), "prompt", "response")


@query(f"""WITH {TOKENS}, n AS (SELECT conv_id, least(np + nr, 256) AS n, conv_id % 4 AS shard FROM w), b AS (SELECT *, (row_number() OVER (PARTITION BY shard ORDER BY conv_id) - 1) // 8 AS batch FROM n)
SELECT conv_id, batch::BIGINT AS batch, (ceil(max(n) OVER (PARTITION BY shard, batch) / 8) * 8)::INT AS width FROM b""")
def sft_padding(spark, sf_dir):
    rows = masked(spark, sf_dir).withColumn("shard", F.col("conv_id") % 4)
    return sft.pad_batches(rows, "conv_id", 8, 0, groups="shard").select("conv_id", "batch", F.size("input_ids").alias("width"))


@query("SELECT doc_id, source FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[a-z]{2,}')")
def secret_scan(spark, sf_dir):
    return docs(spark, sf_dir).where(text.secret_like("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]{2,}")).select("doc_id", "source")


@query("""WITH r AS (SELECT doc_id AS id, quality::VARCHAR AS original, row_number() OVER (ORDER BY sha256('20260820:' || doc_id), doc_id) AS place, count(*) OVER () AS n FROM labels)
SELECT id, original, CASE WHEN original = '0' THEN '1' ELSE '0' END AS corrupted FROM r WHERE place <= round_even(n * 0.1, 0)""")
def label_noise_plan(spark, sf_dir):
    return dataset.noise_plan(table(spark, sf_dir, "labels").withColumn("quality", F.col("quality").cast("string")), "doc_id", "quality", ["0", "1"], 0.1, 20260820)


#: Ways to write an event as model output; only the first is one strict object.
BROKEN = ["{o}", "{o} trailing", "```{o}```", '{{"a": 1, "a": 2}}', '{{"a": NaN}}', "[{o}]", ""]


@query("SELECT event_id, event_id % 7 = 0 AS valid FROM events")
def strict_json(spark, sf_dir):
    good = F.to_json(F.struct("event_id", "event_type", "value"))
    raw = F.lit(None).cast("string")
    for n, form in enumerate(BROKEN):
        made = F.concat(*(good if part == "{o}" else F.lit(part) for part in form.replace("{o}", "\0{o}\0").replace("{{", "{").replace("}}", "}").split("\0") if part)) if form else F.lit("")
        raw = F.when(F.col("event_id") % 7 == n, made).otherwise(raw)
    return table(spark, sf_dir, "events").select("event_id", contracts.strict_json(raw).isNotNull().alias("valid"))


@query()
def ml_baseline(spark, sf_dir):
    """Labels and predictions of the learned baseline on all labelled rows; held_out tells those that it was not fitted on."""
    from ..operators.baseline import TextBaseline

    rows = docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("toxic")), "doc_id")
    rows = rows.withColumn("held_out", F.col("doc_id") % 5 == 0)
    model = TextBaseline.fit(rows.where("NOT held_out"), "text", "toxic")
    return model.predict(rows, "text").groupBy("held_out", "toxic", "predicted_label").agg(F.count(F.lit(1)).alias("n"))
