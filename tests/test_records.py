"""Contracts, stored runs, experiments and files on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from evalframe.functions import text
from evalframe.operators import contracts, dataset, experiments, regression, routing, scoring, sft, stats
from evalframe.sources import jsonl


def test_label_fingerprint_folds_evidence(spark):
    rows = [(1, ["Straße", " ＡＢ  c"]), (2, ["ab C", "STRASSE"]), (3, ["ab", "c strasse"]), (4, ["ﬁne", None]), (5, ["FINE"]), (6, [])]
    df = spark.createDataFrame(rows, "id int, evidence array<string>")
    got = {r.id: r.f for r in df.select("id", text.label_fingerprint("evidence", x=F.lit(1)).alias("f")).collect()}
    assert got[1] == got[2] != got[3] and got[4] == got[5] != got[6]


def test_same_shape_goes_down(spark):
    gold = '{"a": 1.5, "b": {"c": ["x"], "d": 1}, "e": []}'
    cases = {
        '{"a": 2, "b": {"c": ["y", "z"], "d": 2}, "e": [1, "q"]}': True, '{"a": 2, "b": {"c": ["y", 3], "d": 2}, "e": []}': False, '{"a": true, "b": {"c": [], "d": 2}, "e": []}': False,
        '{"a": 2, "b": {"c": [], "d": 2.5}, "e": []}': False, '{"a": 2, "b": {"c": []}, "e": []}': False, '{"a": 2, "b": {"c": [], "d": 1}, "e": [], "confidence": 1}': True,
        '{"a": 2, "b": {"c": [], "d": 1}, "e": [], "confidence": "1"}': False, '{"a": 2, "b": {"c": [], "d": 1}, "e": [], "z": 1}': False, "[1]": False,
    }
    df = spark.createDataFrame(list(cases.items()), "raw string, ok boolean").select("raw", "ok", contracts.same_shape(F.parse_json(F.lit(gold)), F.try_parse_json("raw")).alias("got"))
    assert [(r.raw, r.got) for r in df.collect() if r.got != r.ok] == []


def test_verified_split(spark):
    rows = [(1, "k1", "a", "train"), (2, "k2", "b", "train"), (3, "k2", "b", "train"), (4, "k3", "a", "train"), (5, "k3", "b", "train"), (6, "k9", "a", "test")]
    df = spark.createDataFrame(rows, "id int, fp string, label string, split string")
    digest = dataset.prefix_digest(df.where("split = 'train'"), "fp").first()["digest"]
    good = spark.createDataFrame([("train", 5, digest, "label", "a", 2), ("train", 5, digest, "label", "b", 3)], "split string, count long, digest string, field string, label string, n long")
    check = lambda manifest, split="train", purpose="training": contracts.verified_split(df, manifest, split, purpose, "id", "fp", "label", ["label"])
    kept, found = check(good)
    assert kept.count() == 5 and sorted((r.check_ordinal, r.check) for r in found.collect()) == [(1, "conflicting_labels"), (2, "duplicate_input"), (2, "duplicate_input")]
    bad = good.withColumns({"count": F.lit(7).cast("long"), "digest": F.lit("x"), "n": F.lit(2).cast("long")})
    assert {r.check_ordinal for r in check(bad)[1].collect()} == {1, 2, 3, 4, 5}
    assert {r.check_ordinal for r in check(good, "test", "test_evaluation")[1].collect()} >= {0}
    with pytest.raises(PermissionError):
        check(good, "test", "training")


def test_stored_runs(spark, tmp_path):
    identity = spark.createDataFrame([("d", 3)], "dataset_name string, case_count long")
    report = lambda rate: spark.createDataFrame([("ALL", rate), ("x", 1.0)], "scope string, exact_match_rate double")
    paths = [str(tmp_path / n) for n in "ab"]
    for path, rate in zip(paths, (0.9, 0.7)):
        regression.store_run(identity, report(rate), path)
    policy = spark.createDataFrame([("ALL", "exact_match_rate", "min", 0.8), ("x", "exact_match_rate", "min", 0.8)], "scope string, metric string, op string, threshold double")
    allowed = spark.createDataFrame([("exact_match_rate", 0.1)], "metric string, max_drop double")
    verdict, found = regression.gate_stored_runs(spark, *paths, policy, ["exact_match_rate"], allowed, ["dataset_name", "case_count"])
    assert verdict.first()["status"] == "fail" and sorted(r.code for r in found.collect()) == ["floor_failed", "regression"]
    regression.store_run(identity.withColumn("case_count", F.lit(4)), report(0.9), str(tmp_path / "c"))
    assert regression.gate_stored_runs(spark, paths[0], str(tmp_path / "c"), policy, ["exact_match_rate"], None, ["dataset_name", "case_count"])[0].first()["status"] == "incomparable"
    with pytest.raises(ValueError):
        regression.gate_stored_runs(spark, paths[0], paths[0] + "/", policy, [])
    with pytest.raises(Exception, match="already exists"):
        regression.store_run(identity, report(1.0), paths[0])


def test_evidence_index_keeps_folders_apart(spark, tmp_path):
    for folder, body in (("a", "one"), ("b", "two")):
        (tmp_path / "run" / folder).mkdir(parents=True)
        (tmp_path / "run" / folder / "report.json").write_text(body)
    root, index = str(tmp_path / "run"), str(tmp_path / "index")
    jsonl.write_evidence_index(spark, root, index)
    assert [r.value[66:] for r in spark.read.text(index).collect()] == ["a/report.json", "b/report.json"]
    assert jsonl.verify_evidence_index(spark, root, index).count() == 0
    (tmp_path / "run" / "b" / "report.json").write_text("three")
    (tmp_path / "run" / "c.txt").write_text("new")
    assert sorted((r.name, r.status) for r in jsonl.verify_evidence_index(spark, root, index).collect()) == [("b/report.json", "changed"), ("c.txt", "extra")]


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums(spark, descending, monkeypatch):
    monkeypatch.setattr(stats, "PER_RANGE", 7)
    df = spark.range(100).selectExpr("CAST((id * 37) % 101 AS DOUBLE) AS v", "id + 1 AS n")
    got = stats.running_sums(df, "v", ["n"], descending).collect()
    want = {r.v: sum(s.n for s in got if (s.v > r.v if descending else s.v < r.v)) for r in got}
    assert len(got) == 100 and all(r.before_n == want[r.v] and r.all_n == 5050 for r in got)
    assert stats.running_sums(df.limit(0), "v", ["n"]).count() == 0


def test_risk_coverage_keeps_close_scores_apart(spark):
    obs = spark.createDataFrame([(0.500001, True), (0.500002, False), (0.500002, True), (0.1, False)], "score double, correct boolean")
    got = stats.risk_coverage(obs).orderBy(F.desc("score")).collect()
    assert [(r.accepted, round(r.risk, 4)) for r in got] == [(2, 0.5), (3, round(1 / 3, 4)), (4, 0.5)]


def test_chat_and_prompt(spark):
    system, template = sft.load_prompt("version: 2\nSYSTEM:\nBe brief.\nUSER:\nT {ticket_json}\nS {schema_json}\n", "2")
    record = '{"b":"{schema_json}"}'
    turns = spark.range(1).select(sft.chat(system, template, F.lit(record), "{}", F.lit("{}")).alias("m")).first()["m"]
    assert [(t.role, t.content) for t in turns] == [("system", "Be brief."), ("user", f"T {record}\nS {{}}"), ("assistant", "{}")]
    for bad in ("version: 1\nSYSTEM:\na\nUSER:\n{ticket_json}{schema_json}", "version: 2\nSYSTEM:\na\nUSER:\n{ticket_json}", "no prompt"):
        with pytest.raises(ValueError):
            sft.load_prompt(bad, "2")


def test_sources_and_tail(spark):
    runs = spark.createDataFrame([("a", 1, None), ("b", 1, "x")], "run string, n int, note string")
    assert [(r.field, r["values"]) for r in routing.source_differences(runs, "run", ["n", "note"]).collect()] == [("note", ["null", "x"])]
    rows = spark.createDataFrame([(0.5, "s", 10.0, 1.0), (0.5, "s", 20.0, 19.0), (0.5, "t", 90.0, 1.0)], "threshold double, slice string, latency_ms double, weight double")
    assert {r.scope: r.p95 for r in routing.latency_tail(rows, "slice").collect()} == {"ALL": 20.0, "s": 20.0, "t": 90.0}


def test_full_record(spark):
    df = spark.createDataFrame([("MFA_FAILURE", 0.9, "help", "phishing mail, all users"), ("OTHER_IAM", 0.4, "okta", "my account")], "label string, sure double, subject string, body string")
    got = df.select(*(c.alias(k) for k, c in experiments.full_record(*map(F.col, ("label", "sure", "subject", "body"))).items())).collect()
    assert [(r.issue_type, r.routing_team, r.recommended_action, r.affected_scope, r.confidence) for r in got] == [
        ("MFA_FAILURE", "IDENTITY_PLATFORM", "ESCALATE_SECURITY_REVIEW", "ORGANIZATION", 0.9), ("OTHER_IAM", "SERVICE_DESK", "COLLECT_MORE_INFORMATION", "SINGLE_USER", 0.4)]


def test_noise_ablation(spark):
    words = {"a": "alpha apple anchor", "b": "beta banana bottle"}
    rows = [(i, f"{words['ab'[i % 2]]} filler{i % 7}", "ab"[i % 2], ("train", "train", "validation", "test")[(i // 2) % 4]) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, text string, label string, split string")
    points = experiments.noise_ablation(df, "id", "text", "label", ["a", "b"], (0.0, 0.4), max_iter=50).persist()
    got = {(r.fraction, r.split): r for r in points.collect()}
    assert set(got) == {(f, s) for f in (0.0, 0.4) for s in ("validation", "test")} and [got[f, "test"].corrupted for f in (0.0, 0.4)] == [0, 48]
    assert got[0.0, "test"].macro_f1 == 1.0 and got[0.0, "test"].errors == 0 and got[0.0, "test"]["count"] == 60
    end = experiments.noise_conclusion(points).first()
    assert (end.clean, end.noisiest_fraction) == (1.0, 0.4) and end.fell == (end.noisiest < 1.0)
    with pytest.raises(ValueError):
        experiments.noise_ablation(df, "id", "text", "label", ["a", "b"], (0.1,))


def test_plan_digest_has_no_order(spark):
    rows = [("1", "a", "b"), ("2", "b", "a")]
    digest = lambda r: dataset.plan_digest(spark.createDataFrame(r, "id string, original string, corrupted string")).first()
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:1]) and digest(rows)["keys"] == 2


def test_example_contract_needs_literal_evidence(spark):
    rows = [(1, "adversarial", "PROMPT_INJECTION", "Hi", "ｆull  width words", ["full width"]), (2, "train", None, "Hi", "body", ["absent"]), (3, "adversarial", None, "Hi", "body", [" Hi "]), (4, "train", "OTHER", "Hi", "body", ["body"])]
    df = spark.createDataFrame(rows, "id int, split string, robust string, subject string, body string, evidence array<string>")
    got = {r.id: r.rules for r in df.select("id", contracts.example_contract("split", "robust", "subject", "body", "evidence").alias("rules")).collect()}
    assert got == {1: [], 2: ["evidence"], 3: ["robustness"], 4: ["robustness"]}


def test_json_object_and_redaction(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"a": 1, "b": ["x"]}))
    assert jsonl.read_json_object(spark, str(tmp_path / "one.json"), "a int, b array<string>").collect()[0].b == ["x"]
    with pytest.raises(ValueError):
        jsonl.read_json_object(spark, str(tmp_path / "one.json"), "a int", max_file=3)
    rows = spark.createDataFrame([(1, "schema_invalid", "p", "secret"), (2, "scored", "p", "fine")], "id int, status string, p string, m string")
    assert {r.id: (r.p, r.m) for r in scoring.redact_invalid(rows, ["p"], "m").collect()} == {1: (None, "schema validation failed"), 2: ("p", "fine")}


def test_manifest_lock(spark):
    manifest = spark.createDataFrame([("train", "t.jsonl", 5, "x", "y"), ("test", "e.jsonl", 2, "z", "w")], "split string, file string, count long, sha256 string, fingerprint_sha256 string")
    lock = spark.createDataFrame([("test", "e.jsonl", 3, "z", "w")], manifest.schema)
    assert [(r.field, r.declared, r.actual) for r in jsonl.lock_differences(manifest, lock).collect()] == [("count", "3", "2")]
    assert jsonl.lock_differences(manifest, manifest.where("split = 'test'")).count() == 0


def test_baseline_round_trip(spark, tmp_path):
    from evalframe.operators.baseline import TextBaseline

    rows = [(i, ("Café au lait" if i % 2 else "tea and milk") + f" cup{i % 5}", "yn"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, label string")
    model = TextBaseline.fit(df, "text", "label", max_iter=50)
    model.save(str(tmp_path / "m"))
    again = TextBaseline.load(spark, str(tmp_path / "m"))
    pick = lambda m: {r.id: (r.predicted_label, round(r.predicted_confidence, 9)) for r in m.predict(df, "text").collect()}
    assert pick(model) == pick(again) and all(p == "yn"[i % 2] for i, (p, _) in pick(model).items()) and model.identity == again.identity
    assert TextBaseline.fit(df.orderBy(F.desc("id")), "text", "label", max_iter=5).identity == model.identity


def test_duplicates_in_order(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2), (None, 8), (None, 9)], "k string, id int")
    assert sorted((str(r.k), r.id, r.previous_id, r.first_id) for r in dataset.duplicates(df, "k", "id").collect()) == [("a", 2, 1, 1), ("a", 3, 2, 1)]


def test_time_limit(spark):
    from evalframe.operators.inference import run_model

    def make():
        import time

        def model(row):
            time.sleep(30 if row["n"] == 2 else 0)
            return {"raw_prediction": str(row["n"])}

        return model

    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, n int").coalesce(1)
    got = {r.id: (r.raw_prediction, r.error_kind, r.retriable) for r in run_model(df, make, "id", ["n"], time_limit=1.0).collect()}
    assert got == {1: ("1", None, None), 2: (None, "timeout", True), 3: ("3", None, None)}
    with pytest.raises(ValueError):
        run_model(df, make, "id", ["n"], time_limit=0)


def test_template_expansion(spark):
    from evalframe.operators.synthetic import expand_templates

    df = spark.createDataFrame([(i,) for i in (*range(12), -1, None)], "n int")
    how = {"templates": {"MFA_FAILURE": ["code for {scope}"], "OTHER_IAM": ["help {scope}"]}, "scopes": {"SINGLE_USER": "me", "DEPARTMENT": "us"}}
    got = expand_templates(df, "n", **how, security=("MFA_FAILURE", 3, "stolen")).orderBy("n").collect()
    by = {r.n: r for r in got}
    assert len(got) == 14 and by[None].issue_type is None and by[-1].body is None and by[1].robustness is None
    assert [(by[i].issue_type, by[i].affected_scope, by[i].body) for i in (0, 1, 2, 3)] == [("MFA_FAILURE", "SINGLE_USER", "stolen"), ("OTHER_IAM", "SINGLE_USER", "help me"), ("MFA_FAILURE", "DEPARTMENT", "code for us"), ("OTHER_IAM", "DEPARTMENT", "help us")]
    assert by[0].recommended_action == by[6].recommended_action == "ESCALATE_SECURITY_REVIEW" != by[2].recommended_action
    assert len({by[i].submitted_at for i in range(12)}) == 12
    with pytest.raises(ValueError):
        expand_templates(df, "n", **how, stride=60)


def test_killed_calls(spark):
    """Hanging and dying calls end in bounded time, leave no process behind, and retries reach the model again."""
    import os
    import time

    from evalframe.operators.inference import run_model

    def make():
        def model(row):
            n = row["n"]
            if n % 4 == 1:
                time.sleep(3600)
            if n % 4 == 2:
                os._exit(1)
            if n % 4 == 3 and not os.path.exists(row["mark"]):
                open(row["mark"], "w").close()
                time.sleep(3600)
            return {"raw_prediction": f"{n}:{os.getpid()}"}

        return model

    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame([(i, i, f"{folder}/{i}") for i in range(40)], "id int, n int, mark string").repartition(4)
    start = time.time()
    got = {r.id: r for r in run_model(df, make, "id", ["n", "mark"], time_limit=0.5, processes=3, retries=1).collect()}
    assert time.time() - start < 60 and len(got) == 40
    for i, r in got.items():
        kind = (None, "timeout", "adapter_error", None)[i % 4]
        assert r.error_kind == kind and (r.raw_prediction is None) == (kind is not None), (i, r)
    pids = {int(r.raw_prediction.split(":")[1]) for r in got.values() if r.raw_prediction}
    assert os.getpid() not in pids
    deadline = time.time() + 5
    while time.time() < deadline and any(os.path.exists(f"/proc/{p}") for p in pids):
        time.sleep(0.1)
    assert not any(os.path.exists(f"/proc/{p}") for p in pids)
    assert run_model(df.limit(0), make, "id", ["n", "mark"], time_limit=1.0).count() == 0


def test_many_hanging_calls(spark):
    """A thousand calls that hang in native code end in about their limits' sum over the processes."""
    import time

    from evalframe.operators.inference import run_model

    def make():
        import ctypes

        return lambda row: ctypes.CDLL(None).pause()

    start = time.time()
    out = run_model(spark.range(1000).repartition(4), make, "id", ["id"], time_limit=0.05, processes=4)
    assert {r.error_kind: r["count"] for r in out.groupBy("error_kind").count().collect()} == {"timeout": 1000}
    assert time.time() - start < 90
