"""Streams in event time, published tables, numbered lines and digests of large files."""

from __future__ import annotations

import datetime as dt
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from evalframe.sources import files, jsonl, published
from evalframe.sources.lines import numbered_lines
from evalframe.streaming import ingest, retention, telemetry

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def _at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def _run_parts(spark, tmp_path, parts, schema, make):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = make(spark.readStream.schema(schema).parquet(source)).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)


@pytest.mark.parametrize("salts", [1, 3])
def test_retention_keeps_the_last_n_and_drops_late_rows(spark, tmp_path, salts):
    schema = "timestamp timestamp, request_id string, model_selected string"
    first = [(_at(m), f"r{m:03d}", "a") for m in range(0, 90, 5)] + [(_at(3), "n1", None), (None, "x", "a"), (_at(4), None, "a"), (_at(5), "tie", "a")]
    second = [(_at(200), "r200", "a"), (_at(10), "late", "a"), (_at(85), "in time", "a")]
    snapshots = _run_parts(spark, tmp_path, [first, second, [(_at(400), "end", "b")]], schema, lambda s: retention.retained(s, 3, every_seconds=3600, late="10 minutes", salts=salts))
    got = {}
    for r in retention.last_of(snapshots, 3).orderBy("until", "rank").collect():
        got.setdefault((r.key, (r.until - START.replace(tzinfo=None)).total_seconds() / 60), []).append(r.request_id)
    assert got == {("a", 60): ["r055", "r050", "r045"], (None, 60): ["n1"], ("a", 120): ["r085", "in time", "r080"], ("a", 240): ["r200", "r085", "in time"]}
    assert snapshots.groupBy("key", "salt", "until").count().agg(F.max("count")).first()[0] <= 3


def test_rollup_drops_late_rows_and_closes_windows_once(spark, tmp_path):
    fields = {f.name: None for f in telemetry.EVENT.fields}
    row = lambda m, n, ms: tuple((fields | {"timestamp": _at(m), "request_id": n, "model_selected": "a", "status": "ok", "latency_ms": ms}).values())
    parts = [[row(i, f"r{i}", float(i)) for i in range(100)], [row(5, "late", 1e9), row(99, "in time", 99.0), row(300, "last", None)]]
    windows = _run_parts(spark, tmp_path, parts, telemetry.EVENT, lambda s: telemetry.rollup(s, "1 hour", "10 minutes"))
    got = [(r.events, r.p50_latency_ms, r.p95_latency_ms) for r in windows.orderBy("window_start").collect()]
    assert got == [(60, 29.0, 56.0), (41, 80.0, 98.0)]
    whole = telemetry.merged(windows, ["model_selected"]).first()
    assert (whole.events, whole.p50_latency_ms, whole.latencies) == (101, 50.0, 101)


def test_rollup_of_empty_latencies(spark):
    row = tuple(dict.fromkeys(f.name for f in telemetry.EVENT.fields))
    df = spark.createDataFrame([tuple(_at(1) if n == "timestamp" else None for n in row)], telemetry.EVENT)
    one = telemetry.rollup(df).first()
    assert (one.events, one.p50_latency_ms, one.latencies) == (1, None, 0)
    assert telemetry.rollup(df.limit(0)).count() == 0


def test_a_failed_batch_is_written_once(spark, tmp_path, monkeypatch):
    source = tmp_path / "in"
    source.mkdir()
    event = lambda m, n: f'{{"timestamp":"{_at(m).isoformat()}","request_id":"{n}"}}'
    good, bad, state = (str(tmp_path / n) for n in ("good", "bad", "state"))

    def run():
        ingest.ingest(spark, f"file://{source}", good, bad, state).awaitTermination()

    (source / "1.jsonl").write_text("\n".join([event(0, "a"), "{", "", event(50, "b")]) + "\n")
    run()
    plain, calls = ingest.write_batch, []

    def broken(df, sink, batch):
        calls.append(sink)
        if sink == bad and len(calls) < 3:
            raise OSError("no space")
        return plain(df, sink, batch)

    monkeypatch.setattr(ingest, "write_batch", broken)
    (source / "2.jsonl").write_text("\n".join([event(60, "c"), event(10, "d"), '{"request_id":"e"}', event(41, "f")]))
    with pytest.raises(Exception, match="no space"):
        run()
    assert {r.request_id for r in ingest.committed(spark, good, telemetry.EVENT.toDDL()).collect()} == {"a", "b", "c", "f"}
    run()
    run()  # nothing new
    assert sorted(r.request_id for r in ingest.committed(spark, good, telemetry.EVENT.toDDL()).collect()) == ["a", "b", "c", "f"]
    found = sorted((os.path.basename(r.file), r.line_no, r.reason) for r in ingest.committed(spark, bad, ingest.QUARANTINE).collect())
    broken_json = "not valid JSON for an event"
    assert found == [("1.jsonl", 2, broken_json), ("1.jsonl", 3, broken_json), ("2.jsonl", 2, "late"), ("2.jsonl", 3, "timestamp or request_id is missing")]
    assert ingest.committed(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_published_rows_are_refused_if_they_differ(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(1, "a", 0.5), (1, "a", 0.5), (2, None, None)]
    df = spark.createDataFrame(rows, "n int, s string, x double").repartition(3)
    assert published.publish(df, path) == "published"
    before = sorted(os.listdir(path))
    assert published.publish(df.repartition(1), path) == "unchanged"
    for other in (rows[:1] + rows[2:] + rows[2:], [(1, "a", 0.5), (1, "b", 0.5), (2, None, None)], rows[:2]):
        with pytest.raises(FileExistsError):
            published.publish(spark.createDataFrame(other, df.schema), path)
    with pytest.raises(FileExistsError):
        published.publish(df.withColumnRenamed("s", "t"), path)
    assert sorted(os.listdir(path)) == before
    assert sorted(map(tuple, published.read_published(spark, path).collect()), key=repr) == sorted(rows, key=repr)
    assert published.changed_parts(spark, path).count() == 0
    record = published.published_record(path)
    with open(f"{path}/{record['parts'][0]['name']}", "ab") as part:
        part.write(b"x")
    os.remove(f"{path}/{record['parts'][1]['name']}")
    assert {(r.name, r.actual is None) for r in published.changed_parts(spark, path).collect()} == {(record["parts"][0]["name"], False), (record["parts"][1]["name"], True)}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    broken = spark.range(1000, numPartitions=8).withColumn("x", F.when(F.col("id") == 900, F.raise_error(F.lit("broken row"))).otherwise(F.lit("fine")))
    with pytest.raises(Exception, match="broken row"):
        published.publish(broken, path)
    assert published.published_record(path) is None and not os.path.exists(path)
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)


def test_a_table_without_rows_is_published(spark, tmp_path):
    path, empty = str(tmp_path / "t"), spark.range(0)
    assert published.publish(empty, path) == "published" and published.publish(empty, path) == "unchanged"
    assert published.read_published(spark, path).count() == 0
    with pytest.raises(FileExistsError):
        published.publish(spark.range(1), path)


def test_line_numbers_across_splits(spark, tmp_path):
    lines = {"a": [f"{i} " + "x" * (i % 700) for i in range(2000)], "b": ["", "one\r", ""], "c": []}
    for name, said in lines.items():
        (tmp_path / name).write_text("".join(f"{x}\n" for x in said), newline="")
    (tmp_path / "d").write_text("no end")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted((os.path.basename(r.file), r.line_no, r.value) for r in found) == sorted((k, i + 1, x) for k, said in (lines | {"d": ["no end"]}).items() for i, x in enumerate(said))


def test_strict_lines_of_files_with_faults(spark, tmp_path):
    (tmp_path / "empty").write_text("")
    (tmp_path / "la tin").write_bytes(b'{"a":1}\n{"b":"\xe9"}\n')
    (tmp_path / "large").write_text('{"a":1}\n' * 20)
    good, bad = jsonl.read_strict_jsonl(spark, str(tmp_path), "a int", max_file=100)
    assert good.count() == 0
    assert {(os.path.basename(r.file), r.line_no, r.reason) for r in bad.collect()} == {("empty", None, "empty file"), ("la%20tin", None, "not UTF-8"), ("large", None, "file too large")}
    assert jsonl.read_strict_jsonl(spark, str(tmp_path / "large"), "a int")[0].count() == 20


def test_digest_of_a_file_above_two_gigabytes(spark, tmp_path):
    with open(tmp_path / "big", "wb") as file:
        file.write(b"begin")
        file.truncate((2 << 30) + 5)
    (tmp_path / "small").write_bytes(b"small")
    expected = hashlib.sha256(b"begin")
    zeros = bytes(1 << 24)
    for _ in range((2 << 30) >> 24):
        expected.update(zeros)
    got = {os.path.basename(r.path): (r.bytes, r.sha256) for r in files.file_digests(spark, str(tmp_path)).collect()}
    assert got == {"big": ((2 << 30) + 5, expected.hexdigest()), "small": (5, hashlib.sha256(b"small").hexdigest())}


def test_paths_of_other_stores():
    assert files.arrow_uri("s3a://bucket/a b") == "s3://bucket/a b" and files.arrow_uri("hdfs://n/x") == "hdfs://n/x" and files.arrow_uri("/x") == "file:///x"
    assert files.open_store("file:///tmp/a%20b")[1] == "/tmp/a b"
    with pytest.raises(ValueError, match="unknown"):
        files.open_store("unknown://store/x")


@pytest.mark.parametrize("name", ["line_numbers", "merged_windows", "retained_events", "closed_windows", "quarantined_stream"])
def test_queries_on_no_events(spark, tmp_path, name):
    from evalframe.plans.stream_queries import QUERIES

    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "events.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
