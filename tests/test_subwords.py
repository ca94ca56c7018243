"""Subword masks against a plain walk over the tokenizer's own whole encoding."""

import os
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from evalframe.operators import sft, subwords

RULES = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(RULES), reason="no tokenizer file")
TURNS = [
    ("user: hi\nbot: ", "hello there"), ("ask ", "  two spaces, naïve 日本語 \U0001f600 end "), ("", "only"), ("p ", ""), (None, None), ("x", None),
    ("<|endoftext|> is text ", "so <|endoftext|>"), ("tab\t\n\n ", "\n\n newline"), ("word", "piece"), ("long " * 300, "answer " * 90),
]


@lru_cache(maxsize=1)
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(RULES)
    t.encode_special_tokens = True
    return t


def whole(text):
    return plain().encode(text, add_special_tokens=False)


@pytest.fixture(scope="module")
def rules():
    return subwords.read_rules(RULES)


def test_stretches_encode_as_the_whole(spark, rules):
    text = "It's  a naïve\tcase , 'quoted' x=1\n\n " * 40 + "日本 語 \U0001f600 end"
    for size in (1, 7, 50, 10_000):
        parts = list(subwords.stretches(text, size))
        assert "".join(p for _, p in parts) == text and all(text[a : a + len(p)] == p for a, p in parts)
        found = [(i, s + a, e + a) for a, p in parts for i, (s, e) in zip(whole(p).ids, whole(p).offsets, strict=True)]
        e = whole(text)
        assert found == [(i, *o) for i, o in zip(e.ids, e.offsets, strict=True)]


@pytest.mark.parametrize("limit", [None, 1, 5, 200])
def test_masks_and_audit(spark, rules, limit):
    df = spark.createDataFrame([(n, p, r) for n, (p, r) in enumerate(TURNS)], "id long, p string, r string")
    out = subwords.response_only(df, "p", "r", rules, limit)
    for row in out.collect():
        p, r = row.p or "", row.r or ""
        e = whole(p + r)
        cut = len(e.ids) if limit is None else limit
        want = [i if o[1] > len(p) else sft.IGNORE for i, o in zip(e.ids, e.offsets, strict=True)]
        assert row.tokens == e.ids[:cut] and row.labels == want[:cut] and [tuple(o) for o in row.offsets] == e.offsets[:cut]
        assert row.was_truncated == (len(e.ids) > cut) and row.boundary == want.count(sft.IGNORE)
        learned = [x for x in want[:cut] if x != sft.IGNORE]
        assert row.supervised_tokens == len(learned) and row.lost_response == (not learned and r != "")
    found = subwords.audit(out, "p", "r").first()
    assert (found.rows, found.bad_rows) == (len(TURNS), 0)
    assert subwords.audit(out.where("false"), "p", "r").first().rows == 0


def test_audit_finds_each_fault(spark, rules):
    df = spark.createDataFrame([(1, "ask me ", "a longer answer here")], "id long, p string, r string")
    good = subwords.response_only(df, "p", "r", rules)
    faults = {
        "learns the prompt": good.withColumn("labels", F.col("tokens")),
        "ignores the answer": good.withColumn("labels", F.array_repeat(F.lit(sft.IGNORE), F.size("labels"))),
        "starts late": good.withColumn("labels", F.transform("labels", lambda x, i: F.when(i <= F.col("boundary"), F.lit(sft.IGNORE)).otherwise(x))),
        "has a hole": good.withColumn("labels", F.transform("labels", lambda x, i: F.when(i == F.size("labels") - 2, F.lit(sft.IGNORE)).otherwise(x))),
        "other labels": good.withColumn("labels", F.transform("labels", lambda x: F.when(x == sft.IGNORE, x).otherwise(x + 1))),
        "one label short": good.withColumn("labels", F.slice("labels", 1, F.size("labels") - 1)),
        "a gap": good.withColumn("offsets", F.filter("offsets", lambda o, i: i != 1)),
        "a lost end": good.withColumns({c: F.slice(c, 1, F.size(c) - 1) for c in ("tokens", "labels", "offsets")}),
    }
    assert subwords.audit(good, "p", "r").first().bad_rows == 0
    assert {k: subwords.audit(v, "p", "r").first().bad_rows for k, v in faults.items()} == dict.fromkeys(faults, 1)


def test_learned_characters(spark, rules):
    df = spark.createDataFrame([(n, p, r) for n, (p, r) in enumerate(TURNS)], "id long, p string, r string")
    got = subwords.learned_characters(subwords.response_only(df, "p", "r", rules), "p").collect()
    assert all(r.learned_chars == len(r.r or "") and r.leaked_tokens == 0 for r in got)


def test_very_long_text(spark, rules):
    df = spark.createDataFrame([(1, "x " * 400_000, "tail words"), (2, "y" * 300_000, "z")], "id long, p string, r string")
    got = {r.id: r for r in subwords.response_only(df, "p", "r", rules).select("id", F.size("tokens").alias("n"), "supervised_tokens", F.element_at("offsets", -1)["end"].alias("last")).collect()}
    assert got[1].last == 800_010 and got[1].supervised_tokens >= 2 and got[2].last == 300_001
