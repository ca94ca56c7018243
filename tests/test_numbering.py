"""Order over ranges against plain Python: hot keys, ties, nulls, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from evalframe.operators import dataset, numbering, sft


@pytest.fixture
def ranges(spark):
    """Spark's ranges stay apart, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_duplicates_of_a_hot_key(ranges):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(300)}", rng.randrange(10_000_000)) for _ in range(3000)]
    rows += [(None, 1), (None, 2), ("zz", 5), ("zz", 6)]
    df = ranges.createDataFrame(rows, "previous string, first long").repartition(5)
    got = sorted(tuple(r) for r in dataset.duplicates(df, "previous", "first").collect())
    by: dict = {}
    for k, i in rows:
        if k is not None:
            by.setdefault(k, []).append(i)
    want = []
    for k, ids in by.items():
        ids.sort()
        want += [(k, b, a, ids[0]) for a, b in zip(ids, ids[1:], strict=False)]
    assert got == sorted(want)
    assert dataset.duplicates(df.limit(0), "previous", "first").count() == 0
    dealt = numbering.ranged(df.where("previous IS NOT NULL"), ["previous", "first"])
    sizes = [r["count"] for r in dealt.groupBy(numbering.RANGE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * sorted(sizes)[4]  # a key on 60 % of all rows is spread


def test_duplicates_by_another_order(ranges):
    df = ranges.createDataFrame([("a", 3, 30), ("a", 1, 40), ("a", 2, 10), ("b", 1, 1), ("a", 2, 10)], "k string, at int, id int")
    assert sorted(tuple(r) for r in dataset.duplicates(df, "k", "id", ["at"]).collect()) == [("a", 10, 10, 40), ("a", 10, 40, 40), ("a", 30, 10, 40)]


def test_numbers_are_gapless(ranges):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in range(2000)] + [("c", 2001)]
    df = ranges.createDataFrame(rows, "g string, id int").orderBy(F.rand(1))
    for by in (None, "g"):
        got = {r.id: r.n for r in numbering.numbered(df, ["id"], "n", by).collect()}
        seen: dict = {}
        for g, i in sorted(rows, key=lambda r: r[1]):
            at = g if by else 0
            assert got[i] == seen.get(at, 0)
            seen[at] = got[i] + 1
    assert numbering.numbered(df.limit(0), ["id"], "n", "g").count() == 0


def test_batches_over_ranges(ranges):
    df = ranges.range(100).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda x: x.cast("int")).alias("tokens")).withColumn("labels", F.col("tokens"))
    got = sft.pad_batches(df, "id", 8, 0, 4).collect()
    assert {r.id: r.batch for r in got} == {i: i // 8 for i in range(100)}
    for r in got:
        longest = max(i % 7 + 1 for i in range(r.batch * 8, min(100, r.batch * 8 + 8)))
        assert len(r.input_ids) == len(r.attention_mask) == -(-longest // 4) * 4 and sum(r.attention_mask) == r.id % 7 + 1
