import pytest
from pyspark.sql import functions as F

from evalframe.sources import jsonl, published, review


def test_strict_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":NaN}\n{"b":1}\n{"a":1,"a":2}\n')
    (tmp_path / "b.jsonl").write_text('{"a":1}')
    good, bad = jsonl.read_strict_jsonl(spark, str(tmp_path), "a int")
    assert [r.a for r in good.collect()] == [1]
    assert {(r.line_no, r.reason) for r in bad.collect()} == {(2, "blank line"), (3, "not one JSON object"), (4, "unknown key"), (5, "not one JSON object"), (None, "no line end at the end")}


def test_canonical_sink_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(2, "é\"", None), (1, "x", 3)], "b int, a string, c int")
    out = str(tmp_path / "out")
    jsonl.write_canonical_jsonl(df.coalesce(1), out, "b")
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":"x","b":1,"c":3}', '{"a":"é\\"","b":2,"c":null}']
    with pytest.raises(ValueError):
        jsonl.write_canonical_jsonl(df.limit(0), str(tmp_path / "none"))
    index = str(tmp_path / "index")
    jsonl.write_evidence_index(spark, out, index)
    assert jsonl.verify_evidence_index(spark, out, index).count() == 0


def test_publish_once(spark, tmp_path):
    df, path = spark.range(3), str(tmp_path / "t")
    assert published.publish(df, path) == "published" and published.publish(df, path) == "unchanged"
    with pytest.raises(FileExistsError):
        published.publish(spark.range(4), path)


def test_reviews_round_trip(spark, tmp_path):
    rows = [("1", "b", "r", "text, with\nlines", ["x"], [], True, None, 0.5, 'a "note"'), ("1", "a", "r", "t", [], ["y"], False, False, None, "")]
    df = spark.createDataFrame(rows, review.SCHEMA)
    review.write_reviews_csv(df.coalesce(1), str(tmp_path / "csv"))
    good, bad = review.read_reviews_csv(spark, str(tmp_path / "csv"))
    assert bad.count() == 0 and [(r.case_id, r.evidence_relevant, r.predicted_evidence) for r in good.orderBy("case_id").collect()] == [("a", False, []), ("b", True, ["x"])]
    bad_file = tmp_path / "bad.csv"
    bad_file.write_text(",".join(review.COLUMNS) + "\n1,a,r,t,[],[],yes,true,2,\n")
    assert sorted(r.reason for r in review.read_reviews_csv(spark, str(bad_file))[1].collect()) == ["evidence_relevant is no boolean", "relevance_score is not within 0 and 1"]
    review.write_reviews_jsonl(df, str(tmp_path / "jsonl"))
    assert review.read_reviews_jsonl(spark, str(tmp_path / "jsonl") + "/*.txt")[0].count() == 2
