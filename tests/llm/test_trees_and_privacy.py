"""Hash trees, prefix tries and personal data against brute force on small odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalframe.llm import merkle, prefix_trie, privacy
from evalframe.llm.prefix_trie import ZFastTrie, two_fattest


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def _tree(leaves: list[str]) -> tuple[str, list[list[tuple[str | None, bool]]]]:
    """Root and every leaf's path, plainly."""
    paths: list[list] = [[] for _ in leaves]
    at, level = list(range(len(leaves))), leaves
    while len(level) > 1:
        for leaf, place in enumerate(at):
            other = place ^ 1
            paths[leaf].append((level[other] if other < len(level) else None, place % 2 == 1))
            at[leaf] = place // 2
        level = [_h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


@pytest.mark.parametrize("bits", [2, 8])
def test_merkle_manifest_against_plain_trees(spark, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    sizes = {None: 5, "": 1, "de": 2, "en": 23, "fr": 16, "ü": 17}
    rows = [(i, lang, None if i % 5 == 0 else f"täxt {i}", None if i % 4 == 0 else i) for i, lang in enumerate(k for k, n in sizes.items() for _ in range(n))]
    rows += [(None, "en", "no id", 1), (7, "en", "", 2), (7, "en", "", 2)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, n long").withColumn("hash", F.lit("clash")).withColumn("tree", F.lit(1))
    altered = {"n": F.when(F.col("doc_id") % 3 == 0, F.col("n") + 1).otherwise(F.col("n"))}
    got = merkle.manifest(df, ["doc_id", "lang", "text", "n"], "lang", "doc_id", altered)
    got = got.select("doc_id", "leaf", "altered_leaf", "subroot", "root", "path", merkle.fold(F.col("leaf"), F.col("path")).alias("same"), merkle.fold(F.col("altered_leaf"), F.col("path")).alias("folded")).collect()

    leaf = lambda d, k, t, n: _h(_field(d), _field(k), _field(t), _field(n))
    trees = {k: sorted(((d is not None, d or 0), leaf(d, k, t, n), leaf(d, k, t, n + 1 if n is not None and d is not None and d % 3 == 0 else n)) for d, kk, t, n in rows if kk == k) for k in sizes}
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    subs = {k: _tree([x[1] for x in trees[k]]) for k in order}
    root, above = _tree([subs[k][0] for k in order])
    want = []
    for place, k in enumerate(order):
        for (key, own, other), path in zip(trees[k], subs[k][1], strict=True):
            want.append((key[1] if key[0] else None, own, other, subs[k][0], root, tuple(path + above[place])))
    assert sorted(((r[0], r[1], r[2], r[3], r[4], tuple((s[0], s[1]) for s in r[5])) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r["same"] == root for r in got)
    assert all((r["folded"] == root) == (r["altered_leaf"] == r["leaf"]) for r in got)


def test_merkle_manifest_of_one_row_and_of_none(spark):
    one = merkle.manifest(spark.createDataFrame([(1, None, None)], "doc_id long, lang string, text string"), ["doc_id", "text"], "lang", "doc_id").collect()
    assert [(r.leaf, r.subroot, r.root, r.path) for r in one] == [(_h("1:1", "-"),) * 3 + ([],)]
    assert merkle.manifest(spark.createDataFrame([], "doc_id long, lang string"), ["doc_id"], "lang", "doc_id").count() == 0


def _brute_trie(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    nodes: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {k: sum(len(o) == len(k) + 1 and o[: len(k)] == k for o in nodes) for k in nodes}
    out = []
    for k, members in nodes.items():
        below = [o for o in nodes if o[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(k))
        out.append((
            min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), kids[k], sum(kids[o] == 0 for o in below),
            sum((len(nodes[o]) - 1) * len(o[-1][1]) for o in below if o), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


@pytest.mark.parametrize("batch,members", [(2, 3), (256, 4096)])
def test_prefix_trie_against_all_prefixes(spark, monkeypatch, batch, members):
    monkeypatch.setattr(prefix_trie, "BATCH", batch)
    monkeypatch.setattr(prefix_trie, "MEMBERS", members)
    dice = random.Random(5)
    convs = {c: [("user", dice.choice("ab")) for _ in range(dice.randrange(1, 9))] for c in range(-20, 60)}
    convs |= {100 + c: convs[0] for c in range(20)} | {200: [("system", "x")] * 70, 201: [("system", "x")] * 40 + [("user", "ü")], 202: [("system", "x")] * 69}
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(300, None, None, None), (300, 1, "user", "a"), (None, 1, "user", "lost")]
    convs[300] = [("", ""), ("user", "a")]
    dice.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("len", F.lit("clash"))
    got = prefix_trie.prefix_trie(df).collect()
    assert sorted(tuple(r) for r in got) == sorted(_brute_trie(convs), key=lambda x: x[:2])


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _packed(word: str) -> bytes:
    return b"".join(hashlib.blake2b(word[:i].encode(), digest_size=16).digest() for i in range(1, len(word) + 1))


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("ab", max_size=12), min_size=1, max_size=30), st.text("ab", max_size=14))
def test_fat_binary_search_finds_the_exit(words, sought):
    trie = ZFastTrie(0)
    for i, word in enumerate(sorted(words, key=hash)):
        trie.insert(i, _packed(word))
    longest = max(len([1 for i in range(min(len(w), len(sought))) if w[: i + 1] == sought[: i + 1]]) for w in words)
    depth, owner, _ = trie.locate(_packed(sought))
    assert depth == longest
    assert (owner < 0) == (depth == 0)
    if depth:
        assert trie.at(trie.paths[owner], depth) == trie.at(_packed(sought), depth)
    assert len(trie.handles) == len(trie.top) == len(trie.first)


def test_two_fattest():
    for low in range(40):
        for high in range(low + 1, 41):
            assert two_fattest(low, high) == max(range(low + 1, high + 1), key=lambda n: (n & -n))


RULES = [
    (0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (1, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    (2, r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and privacy.luhn(re.sub("[^0-9]", "", m))),
    (3, r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    (6, privacy.IBAN, lambda m: privacy.iban_holds(m)),
]


def _brute_spans(text: str) -> list:
    out = [(k, m.start(), m.end()) for k, rule, fine in RULES for m in re.finditer(rule, text) if fine(m.group())]
    out += [(4, m.start(1), m.end(1)) for m in privacy.ACCOUNT.finditer(text)]
    out += [(5, m.start(), m.end()) for m in re.finditer(r"[A-Za-z][A-Za-z0-9+.-]{0,31}" + privacy.LOGIN.pattern, text)]
    return sorted(out)


PIECES = ["a", "b.c", "@", "@@", ".", "..", "1", "23", "255", "256", "0000", " ", "-", "+", "+1 (555) 010-9999", "4111 1111 1111 1111", "378282246310005", "me@x.org", "1.2.3.4", "ü", "\n", "http://", "u:p@h.de:80", "account no: ", "SSN", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "٣", "😀"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_anchors_find_what_plain_rules_find(parts):
    text = "".join(parts)
    assert privacy.private_spans(text, privacy.anchors()) == _brute_spans(text)


def test_spans_and_masks_of_a_table(spark):
    long = "1" * 300_000 + "a" * 300_000 + "@" * 1000 + " 9.9.9.9.9.9.9.9"
    rows = [(1, "Write to me@x.org, or 1.2.3.4 and 4111111111111111."), (2, None), (3, ""), (4, long), (4, "account 12345678 ftp://u:p@h.de x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("private", F.lit("old")).withColumn("end", F.lit(1))
    got = {(r.doc_id, r.s) for r in privacy.find_private(df).select("doc_id", privacy.spans_text("private").alias("s")).collect()}
    assert got == {(1, "email:9:17,ip:22:29,card:34:50"), (2, ""), (3, ""), (4, "ip:601001:601008,ip:601009:601016"), (4, "email:25:31,account:8:16,address:17:31")}
    masked = {r.masked for r in privacy.mask_private(df.where("doc_id <> 4 OR length(text) < 99")).collect()}
    assert masked == {"Write to [email], or [ip] and [card].", None, "", "account [account] [address] x"}
    assert privacy.find_private(df.limit(0)).count() == 0


