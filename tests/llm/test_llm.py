"""The training-data operators on small tables: brute force, edge cases, round trips."""

import functools
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.llm import components, embedding_dedup, line_dedup, minhash, mixing, pieces, sharding, substring_dedup, topk, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df, key):
    return {r[key]: r for r in df.collect()}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 180))) for _ in range(40)]
    out = dict(enumerate(base))
    for i in range(25):  # near and exact copies, shared passages, in other sources
        t = base[i].split()
        if i % 3 == 0:
            t[len(t) // 2] = "changed"
        out[100 + i] = " ".join(t if i % 2 else t + ["tail"])
    passage = " ".join(rng.choice(words) for _ in range(70))
    for i in range(6):
        out[200 + i] = base[i] + " " + passage + "\n" + base[39 - i]
    out |= {300: None, 301: "", 302: "   \n ", 303: "A b", 304: "a B", 305: "one two three four five six seven", 306: "one two three four five six seven eight"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, f"s{k % 5}" if k % 11 else None, "clash", 7) for k, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed string, size int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


# 1


def test_line_dedup(spark):
    line, rows = "shared line", []
    for i in range(12):
        rows.append((i, f"own {i}\nshared line\n\nshared line", f"site{i}"))
    rows += [(50, "rare\nown 3", "site1"), (51, None, "site2"), (52, "", None), (53, "shared line", None), (54, "half", "site1"), (54, "half", "site1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("x"))
    got = rows_of(line_dedup.dedup_lines(df, min_sites=10), "doc_id")
    assert got[0].text == "own 0\nshared line\n" and got[0].n_removed == 1  # the first showing stays
    assert got[5].text == "own 5\n" and got[5].n_removed == 2 and got[5].n_lines == 4
    assert got[50].text == "rare\nown 3" and got[51].text is None and got[51].n_lines == 0 and got[52].text == "" and got[53].text == ""
    assert line_dedup.dedup_lines(df, min_sites=10).count() == len(rows)
    assert rows_of(line_dedup.dedup_lines(df, min_sites=10, keep_first=False), "doc_id")[0].text == "own 0\n"
    flagged = line_dedup.boilerplate_lines(df, min_sites=10).collect()
    assert [(r.sites, r.exact) for r in flagged] == [(12, True)]
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


# 2


@pytest.mark.parametrize("rows", [[], [(1, 5)], [(i, (i * 37) % 100 + 1) for i in range(500)], [(7, 3)] * 40 + [(None, 2)] * 5 + [(8, None)]])
def test_shards(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, bytes long").withColumn("shard", F.lit("old"))
    got = sharding.assign_shards(df, "bytes", ["doc_id"], shards=8).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    largest = max((b or 0 for _, b in rows), default=0)
    mean = sum(b or 0 for _, b in rows) / 8
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.bytes or 0 for r in own) - mean) <= largest
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)


# 3


def test_targets(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 50)], "source string, source_size long")
    t = rows_of(mixing.source_targets(df), "source")
    assert [t[s].weight for s in ("a", "b", "c", None)] == [1, 2, 3, 1]
    assert sum(r.target for r in t.values()) == pytest.approx(1160) and t["a"].target == 30 and t["c"].target == 300 and t[None].target == 150 and t["b"].target == pytest.approx(680)


def test_mix(spark, docs, texts):
    plan = mixing.plan_mix(docs, shards=4)
    got = plan.collect()
    assert {r.doc_id for r in got} == set(texts) and len(got) == len(texts)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        taken = sum(r["size"] * len(r.takes) for r in own)
        assert abs(taken - own[0].target) <= max(r["size"] for r in own) and sum(r["size"] for r in own) == own[0].source_size
    assert all(len(r.takes) <= 3 for r in got)
    mixed = mixing.mix(docs, shards=4).collect()
    assert len(mixed) == sum(len(r.takes) for r in got)
    assert sorted((r.doc_id, r.mix_shard, r.mix_copy) for r in mixed) == sorted((r.doc_id, t.shard, t.copy) for r in plan.collect() for t in r.takes)  # a rerun agrees
    assert mixing.plan_mix(empty(spark)).count() == 0


def test_quota_tree_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 200), (3, 0), (4, 5)], "place int, q long")
    seen = np.zeros((8, 4))
    for seed in range(6):
        got = mixing.split_quotas(quotas, 8, seed).collect()
        table = np.zeros((8, 4))
        for r in got:
            table[r.shard, r.place - 1] = r.q
        assert table.sum(0).tolist() == [1000, 200, 0, 5] and (table >= 0).all()
        assert set(table.sum(1)) <= {150, 151}
        seen += table
    assert abs(seen[:, 0].mean() / 6 - 125) < 1e-9 and 0.3 < np.std(seen[:, 0]) < 30  # random, around its share


# 4


def toxic_corpus(n=260, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), "grobian" + rng.choice(["", "en", "isch", "ette"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_toxicity(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "!!! 12"), (903, "lala " * 30000 + "grobianische " + "lala " * 10)], "doc_id long, text string").withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.fit_and_score(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= toxicity.TOXIC) == bool(rows[i][2]) for i in held)
    assert right >= 0.85 * len(held) and len(got) == len(rows) + 4
    assert got[900] == got[901] == got[902] == 0 and 0 <= got[903] <= 1
    assert {r for r, _ in toxicity.training_rows(docs, labels)}.isdisjoint({rows[i][1] for i in held})
    assert toxicity.fit(["a b"], [1]) is None
    assert toxicity.fit_and_score(docs.limit(0), labels.limit(0)).count() == 0


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        starts = toxicity.windows_of(n)
        assert {w for s in starts for w in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))


def test_gradients():
    net = toxicity.Network([b"a"], seed=1)
    rng = np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(5, toxicity.WORD_DIM + toxicity.CHAR_DIM))
    at = np.array([[0, 1, 2, 5, 5], [3, 4, 0, 1, 2]])
    label, weight = np.array([1.0, 0.0]), np.ones(2)
    loss = lambda: float((np.logaddexp(0, net.forward(net.gates(x), at)) - label * net.forward(net.gates(x), at)).mean())
    grads, _ = net.gradients(net.gates(x), at, label, weight)
    for name in ("hf", "hb", "look", "out"):
        flat, g = net.p[name].reshape(-1), grads[name].reshape(-1)
        k, old = int(np.abs(g).argmax()), None
        old = flat[k]
        flat[k] = old + 1e-2
        up = loss()
        flat[k] = old - 1e-2
        down = loss()
        flat[k] = old
        assert g[k] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


# 5


@pytest.fixture(scope="module")
def vocabulary():
    if not os.path.exists(pieces.PIECES):
        pytest.skip("no public vocabulary here")
    return pieces.Vocabulary(pieces.read_pieces(pieces.PIECES))


@functools.cache
def piece_scores():
    return {p.encode(): s for p, s, kind in pieces.read_pieces(pieces.PIECES) if kind == pieces.NORMAL}


def slow_viterbi(v, text):
    """Plain search over the whole text: the best sum of scores."""
    data = (pieces.MARK + text.replace(" ", pieces.MARK)).encode()
    table = piece_scores()
    best = [0.0] + [-float("inf")] * len(data)
    for i in range(len(data)):
        if best[i] == -float("inf") or data[i] & 0xC0 == 0x80:
            continue
        size = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        for j in range(i + 1, min(len(data), i + 48) + 1):
            if data[i:j] in table:
                best[j] = max(best[j], best[i] + table[data[i:j]])
        if data[i : i + size] not in table:
            best[i + size] = max(best[i + size], best[i] + float(v.unknown_score))
    return best[-1]


def test_pieces(vocabulary):
    rng = random.Random(2)
    samples = ["the of", "a", " a", "double  space", "tab\there", "l\n\nm", "naïve 日本語 😀", "\x01", "   "] + ["".join(rng.choice("ab the on  é日😀\n") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    encoder = pieces.Encoder(vocabulary)
    scores = {int(i): float(s) for i, s in zip(vocabulary.ids, vocabulary.scores)}
    for t, ids in zip(samples, encoder.encode(samples)):
        assert pieces.decode_ids(vocabulary, ids) == t
        if all(c in "ab theon" for c in t) and "  " not in t:
            assert sum(scores[i] for i in ids.tolist()) == pytest.approx(slow_viterbi(vocabulary, t))
    assert [len(x) for x in encoder.encode([None, ""])] == [0, 0]


def test_pieces_in_spark(spark, vocabulary, docs):
    more = docs.unionByName(spark.createDataFrame([(999, "lang" * 5000, None, "", 0)], docs.schema)).withColumn("piece_ids", F.lit("old"))
    got = pieces.decode(pieces.encode(more)).collect()
    assert len(got) == docs.count() + 1 and all(r.decoded == r.text for r in got)
    assert sorted(map(str, pieces.encode_and_decode(more.withColumn("decoded", F.lit("old"))).collect())) == sorted(map(str, got))
    assert pieces.decode(pieces.encode(empty(spark))).count() == pieces.encode_and_decode(empty(spark)).count() == 0


def test_slices_are_bounded():
    import pyarrow as pa

    texts = ["a"] * 600 + [None, "", "b" * 3_000_000, "c" * 700_000, "d" * 700_000, "e"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["n", "text"])
    parts = list(pieces._slices(batch, 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.num_rows <= pieces.ROWS and sum(len(t or "") for t in p.column(1).to_pylist()) <= pieces.BYTES) for p in parts)
    assert list(pieces._slices(batch.slice(0, 0), 1)) == []


# 6


def test_embedding_links(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    vectors = [*base, *(base[:10] + 0.05 * rng.normal(size=(10, 16))), *(base[:1] + 0.1 * rng.normal(size=(40, 16))), base[3], base[3] * 2]
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)]
    odd = [(500, None, "c"), (501, [0.0] * 16, "c"), (502, [float("nan")] * 16, "c"), (503, [1.0, None], "c"), (504, [], "c"), (505, [1.0, 2.0], "c"), (505, [1.0, 2.0], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, n_links string")
    got = embedding_dedup.embedding_links(df).collect()
    assert len(got) == len(rows) + len(odd)
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    root = np.arange(len(x))
    while True:
        new = np.array([min([root[i], *root[hit[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    one = {r.vec_id: r for r in got}
    assert all((one[i].n_links, one[i].component_id) == (hit[i].sum(), root[i]) for i in range(len(x)))
    assert all(one[i].n_links == 0 and one[i].kept for i in range(500, 505)) and one[505].n_links == 1
    assert embedding_dedup.embedding_links(df.limit(0)).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component_id for r in components.connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100}


# 7


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def expected_components(texts, percent):
    sets, root = {k: shingles(t) for k, t in texts.items()}, {k: k for k in texts}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and root[a] != root[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((root[a], root[b]))
                    root = {k: low if v == high else v for k, v in root.items()}
                    changed = True
    return sets, root


def test_near_duplicates(spark, docs, texts):
    sets, root = expected_components(texts, 85)
    got = rows_of(minhash.near_duplicates(docs), "doc_id")
    assert len({v for v in root.values()}) < len(root)
    assert all((got[k].n_shingles, got[k].component_id, got[k].kept) == (len(sets[k]), root[k], root[k] == k) for k in texts)
    kept = {r.doc_id for r in minhash.drop_near_duplicates(docs).collect()}
    assert kept == {k for k in texts if root[k] == k}
    assert minhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_filter_keeps_pairs_at_the_threshold(percent):
    """The exact chance that a pair at the threshold shares so few hashes that the filter drops it."""
    for on in (64, 80, 100, 128):
        dropped = np.flatnonzero(~minhash._hopeful(np.arange(on + 1) / on, np.full(on + 1, on), percent))
        assert len(dropped) and sum(math.comb(on, int(c)) * (percent / 100) ** int(c) * (1 - percent / 100) ** (on - int(c)) for c in dropped) < 1e-8


def test_chain_of_near_copies(spark):
    """Neighbours link, ends do not: the star of the smallest id alone would miss it."""
    words = [f"x{i}" for i in range(200)]
    texts = {n: " ".join(words[n * 4 : n * 4 + 120]) for n in range(20)}
    texts |= {50: texts[3], 51: texts[3]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, root = expected_components(texts, 85)
    assert {k: r.component_id for k, r in rows_of(minhash.near_duplicates(df), "doc_id").items()} == root and set(root.values()) == {0}


# 8


@pytest.mark.parametrize("n, dims", [(30, 3), (700, 8)])
def test_top_k(spark, n, dims):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(5000, None, 0), (5020, [float("inf")] * dims, 0), (5040, [0.0] * dims, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, query_block=16, candidate_block=64).collect()
    ids, whole = [*range(n), 5040], np.floor(64 * np.vstack([x, np.zeros((1, dims))]).astype(np.float64)).astype(np.int64)
    want = set()
    for q in [i for i in ids if i % 20 == 0]:
        s = whole @ whole[ids.index(q)]
        order = sorted((-int(s[c]), i) for c, i in enumerate(ids) if i != q)[:5]
        want |= {(q, k + 1, i, -v) for k, (v, i) in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


# 9


def test_repeated_passages(spark, docs, texts):
    seen, want = {}, {}
    for k in sorted(texts):
        w = WORD.findall(texts[k] or "")
        cover = [False] * len(w)
        own = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        for i, x in enumerate(own):
            if x in seen:
                cover[i : i + 50] = [True] * 50
        for x in own:
            seen.setdefault(x, k)
        want[k] = (len(w), sum(cover), " ".join(a for a, c in zip(w, cover) if not c))
    got = rows_of(substring_dedup.repeated_passages(docs), "doc_id")
    assert {k: (r.n_words, r.n_removed, r.kept_text) for k, r in got.items()} == want and any(v[1] for v in want.values())
    assert all(r.n_removed == sum(s.end - s.start for s in r.repeats) for r in got.values())
    twice = docs.where("doc_id = 0").union(docs.where("doc_id = 0"))
    assert {r.n_removed for r in substring_dedup.repeated_passages(twice).collect()} == {0}
    assert substring_dedup.repeated_passages(empty(spark)).count() == 0


# 10


def test_warc(spark, tmp_path):
    page = "<p>" + "é\r\n\r\nWARC/1.0\r\n" * 20 + "</p>"
    rows = [(3, "http://a/3", page, 1), (1, "http://a/1\r\nX: y", page, 1), (2, None, None, 1), (4, "u", "short", 1), (5, "u", "short", 1), (1, "again", page, 1), (9, "u", "x" * 200_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    warc.write_warc(warc.plan_records(df), str(tmp_path / "w"))
    plain = str(tmp_path / "plain")
    warc.write_warc(warc.plan_records(df), plain, compression="none")
    for path in (str(tmp_path / "w"), plain):
        got = warc.read_warc(spark, path).collect()
        assert sorted(r.record_type for r in got) == ["response"] * 6 + ["revisit"]
        revisit = next(r for r in got if r.record_type == "revisit")
        assert (revisit.record_id, revisit.refers_to, revisit.payload_bytes, bytes(revisit.payload)) == ("<urn:page:3>", "<urn:page:1>", len(page.encode()), b"")
        for r in got:
            if r.record_type == "response":
                assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest.removeprefix("sha256:")
        one = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit' AND target_uri = 'http://a/3'")
        assert [r.payload for r in one.collect()] == [None]
    warc.write_warc(warc.plan_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


# Odd rows: null ids, different texts under one id, very long words and texts, few labels


def test_near_duplicates_odd_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base), (1, base), (2, base + " end"), (3, "alone one two three four five six"), (3, base + " other end"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):
        got = minhash.near_duplicates(df).collect()
        assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] and len(got) == len(rows)
        assert {(r.component_id, r.kept) for r in got if r.doc_id == 2} == {(1, False)} and {r.component_id for r in got if r.doc_id == 4} == {4}
    assert {r.doc_id for r in minhash.drop_near_duplicates(df).collect()} >= {None, 1, 4}


def test_passages_of_long_and_odd_rows(spark):
    rng = random.Random(8)
    long_text = " ".join(rng.choice(["a", "b", "cc"]) for _ in range(30_000))
    words = long_text.split()
    rows = [(1, long_text), (2, "x " + " ".join(words[20_000:20_100]) + " y"), (3, "same " * 400), (4, "same " * 70), (5, " ".join(words[:49])), (6, "p q " * 60), (7, "q p " * 40), (None, long_text), (8, "z " * 60), (8, "x " + " ".join(words[5:70]))]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 30_000, 0), (2, 102, 100), (3, 400, 0), (4, 70, 70), (5, 49, 0), (6, 120, 0), (7, 80, 80), (None, 30_000, 0), (8, 60, 0), (8, 66, 65)], key=str)


@pytest.mark.parametrize("window", [3, 12, 13, 14, 20, 51])
def test_passages_of_other_windows(spark, window):
    rng = random.Random(window)
    texts = {k: " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 120))) for k in range(30)}
    texts |= {100 + k: texts[k][10:] + " z " + texts[k + 1][:80] for k in range(20)}
    seen, want = {}, {}
    for k in sorted(texts):
        w = texts[k].split()
        own = [tuple(w[i : i + window]) for i in range(len(w) - window + 1)]
        gone = {j for i, x in enumerate(own) if x in seen for j in range(i, i + window)}
        for x in own:
            seen.setdefault(x, k)
        want[k] = (len(w), len(gone), " ".join(a for i, a in enumerate(w) if i not in gone))
    got = rows_of(substring_dedup.repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=window), "doc_id")
    assert {k: (r.n_words, r.n_removed, r.kept_text) for k, r in got.items()} == want


def test_top_k_null_ids_and_depth(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 16), (20, None), (41, [1.0, 2.0]), (60_000, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0 OR vec_id IS NULL"), k=20, query_block=64, candidate_block=1024, with_depth=True).collect()
    assert not any(r.query_id is None or r.vec_id is None for r in got) and [(r.vec_id, r.score) for r in got if r.query_id == 60_000] == [(41, 64 * 128 + 128 * 64)]
    depth = {r.query_id: r.read for r in got if r.query_id < 3000}
    assert len(depth) == 150 and sum(d < 0.9 for d in depth.values()) > 140  # most searches stop well before the end of the lists
    whole = np.floor(64 * x).astype(np.int64)
    for q in (0, 1500, 2980):
        s = whole @ whole[q]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, -v) for v, i in sorted((-int(s[c]), c) for c in range(3000) if c != q)[:20]]


def test_top_k_ties_go_to_smaller_ids(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(60)] + [(7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, df.where("vec_id = 20"), k=5).collect()
    assert [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly 0.9: both filters, buckets and signs, let nearly all pass."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    other = rng.normal(size=x.shape)
    other -= (other * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * other / np.linalg.norm(other, axis=1)[:, None]
    meet = embedding_dedup._first_meeting(embedding_dedup.codes(x), embedding_dedup.codes(y)) < np.iinfo(np.int64).max
    apart = np.bitwise_count(embedding_dedup.signs(x).view(np.uint64) ^ embedding_dedup.signs(y).view(np.uint64)).sum(1)
    assert meet.mean() > 0.999 and (apart <= embedding_dedup.most_unlike(0.9)).all()
    share, most = math.acos(0.9) / math.pi, embedding_dedup.most_unlike(0.9)
    assert sum(math.comb(128, i) * share**i * (1 - share) ** (128 - i) for i in range(most + 1, 129)) < 1e-7


def test_many_links_and_null_ids_of_vectors(spark):
    """A crowd in one bucket is compared in blocks; a null id is a vector like any other."""
    rng = np.random.default_rng(6)
    crowd = np.r_[1.0, np.zeros(15)] + 0.03 * rng.normal(size=(1500, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(crowd)] + [(None, [0.0, -1.0] + [0.0] * 14)]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 1501 and {(r.n_links, r.component_id) for r in got if r.vec_id is not None} == {(1499, 0)} and [(r.n_links, r.component_id) for r in got if r.vec_id is None] == [(0, None)]


def test_warc_null_ids(spark, tmp_path):
    from evalframe.llm import queries

    page = "<html>" + "x" * 200
    df = spark.createDataFrame([(None, "u", page), (5, "u", page), (None, None, None), (7, "v", "short")], "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.QUERIES["op10_warc_round_trip"](spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("5", "response", None), ("7", "response", None), ("None", "response", None), ("None", "revisit", 5)]


def test_few_labels_end_soon():
    import time

    start = time.time()
    net = toxicity.fit(["bad word here", "good word there", "fine day"], [1, 0, 0])
    assert net is not None and time.time() - start < 60


def test_scores_equal_a_plain_loop():
    """The batched scorer against one window after the other, each gate and attention weight written out."""
    rows = toxic_corpus(60)
    net = toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows], steps=30)
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def plain(text):
        words, best = toxicity.words_of(text), -np.inf
        x = net.inputs(words).astype(np.float64)
        for s in toxicity.windows_of(len(words)):
            places, states = list(range(s, min(len(words), s + toxicity.WINDOW))), {}
            for way in "fb":
                state = np.zeros(h)
                for t in places if way == "f" else places[::-1]:
                    gx, gh = x[t] @ p[f"x{way}"] + p[f"b{way}"], state @ p[f"h{way}"]
                    z, r = sigmoid(gx[:h] + gh[:h]), sigmoid(gx[h : 2 * h] + gh[h : 2 * h])
                    state = (1 - z) * np.tanh(gx[2 * h :] + r * gh[2 * h :]) + z * state
                    states[way, t] = state
            both = [np.concatenate([states["f", t], states["b", t]]) for t in places]
            look = np.exp([v @ p["look"] for v in both])
            best = max(best, sum(a * v for a, v in zip(look / look.sum(), both, strict=True)) @ p["out"] + p["bias"][0])
        return float(sigmoid(best))

    texts = [t for _, t, _ in rows[:6]] + ["word " * 150]
    got = toxicity.Scorer(net).scores(texts)
    assert got == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_pieces_byte_fallback_against_plain_search(vocabulary):
    """Sums of scores with unknown characters and double spaces: every piece path as good as the plain search's."""
    rng = random.Random(4)
    encoder = pieces.Encoder(vocabulary)
    scores = {int(i): float(s) for i, s in zip(vocabulary.ids, vocabulary.scores)}
    lost = set(vocabulary.byte_ids.tolist())

    def total(ids):
        value, run = 0.0, bytearray()
        for i in [*ids.tolist(), None]:
            if i in lost and i not in scores:
                run += vocabulary.bytes_of[i]
                continue
            value += len(run.decode()) * float(vocabulary.unknown_score)
            run.clear()
            value += scores[i] if i is not None else 0
        return value

    for _ in range(120):
        t = "".join(rng.choice("ab the on  \x01é日😀𓀀ſ") for _ in range(rng.randint(1, 60)))
        assert total(encoder.encode([t])[0]) == pytest.approx(slow_viterbi(vocabulary, t))
    word = "lang" * 20_000 + "𓀀" + "é" * 3000
    ids = encoder.encode([word])[0]
    assert pieces.decode_ids(vocabulary, ids) == word
    chunks = [("▁" + "".join(rng.choice("abtheonzé日😀") for _ in range(rng.randint(1, 40)))).encode() for _ in range(200)]
    together = encoder._viterbi(chunks, np.array([len(c) for c in chunks]))
    assert all(np.array_equal(encoder._alone(c), x) for c, x in zip(chunks, together, strict=True))


def test_exact_band_of_line_counts(spark):
    """Lines with many more sites than the threshold are flagged by the sketch alone."""
    rows = [(i, f"everywhere\nown {i}\n" + ("near" if i < 10 else "far"), f"s{i}") for i in range(60)] + [(100, None, None), (101, "near " * 20_000, "s1")]
    flagged = line_dedup.boilerplate_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_sites=10).collect()
    assert sorted((r.exact, r.sites > 10) for r in flagged) == [(False, True), (False, True), (True, False)]


def test_mix_of_very_long_and_repeated_rows(spark):
    rows = [(1, "w " * 50_000, "big"), (2, "a b c", "small"), (2, "a b c", "small"), (None, "d e", None), (3, None, "none"), (4, "", "none")]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(plan) == len(rows) and {(r.doc_id, r["size"]) for r in plan} == {(1, 50_000), (2, 3), (None, 2), (3, 0), (4, 0)}
    assert all(len(r.takes) <= 3 for r in plan) and len({tuple(t.shard for t in r.takes) for r in plan if r.doc_id == 2}) == 1


def test_many_small_sources_meet_their_targets(spark):
    """Sources below a block of the corpus are cut into blocks of their own; more sources than a group of the tree holds."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(1, 9), f"host{i % 300:03}") for i in range(9000)] + [(9000 + i, "w " * 400, "large") for i in range(200)]
    plan = mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, largest = {}, {}, {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r["size"] * len(r.takes)
        target[r.source], largest[r.source] = r.target, max(largest.get(r.source, 0), r["size"])
    assert len(target) == 301 and all(abs(taken[s] - target[s]) <= 0.5 * target[s] / 20 + 3 * largest[s] for s in target)
    by_shard = {}
    for r in plan:
        for t in r.takes:
            by_shard[t.shard] = by_shard.get(t.shard, 0) + 1
    assert len(by_shard) == 16 and max(by_shard.values()) < 1.6 * min(by_shard.values())


def test_quota_tree_over_groups(spark):
    quotas = spark.createDataFrame([(i, i % 9) for i in range(1, 701)], "place int, q long")
    got = mixing.split_quotas(quotas, 16, 3).collect()
    table = np.zeros((16, 700))
    for r in got:
        table[r.shard, r.place - 1] += r.q
    assert table.sum(0).tolist() == [i % 9 for i in range(1, 701)] and (table >= 0).all() and set(table.sum(1)) <= {table.sum() // 16, table.sum() // 16 + 1}
    assert np.corrcoef(table[0], table[1])[0, 1] < 0.99


def test_scratch_is_cleared(spark):
    from evalframe.llm import common

    kept = common.stash(spark.range(5))
    assert kept.count() == 5 and os.path.isdir(common.scratch_dir(spark).removeprefix("file://"))
    common.clear_scratch(spark)
    assert not os.path.isdir(common.scratch_dir(spark).removeprefix("file://"))


def test_line_dedup_of_documents_of_many_flagged_lines(spark):
    """Removal is linear in the lines of a document: this many once took minutes."""
    import time

    from evalframe.llm import line_dedup

    body = "\n".join(f"line {i}" if i % 50 else f"own {i}" for i in range(40_000))
    df = spark.createDataFrame([(i, body.replace("own", f"own {i}"), f"s{i}") for i in range(12)], "doc_id long, text string, source string").repartition(4)
    begin = time.monotonic()
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup_lines(df).collect()}
    assert time.monotonic() - begin < 120
    assert got[0] == (40_000, 0, body.replace("own", "own 0"))
    assert all(got[i] == (40_000, 39_200, "\n".join(f"own {i} {n}" for n in range(0, 40_000, 50))) for i in range(1, 12))


def test_warc_files_are_cut_by_bytes(spark, tmp_path):
    sizes = [10, 90, 300, 0, 100, 5_000, 20, 30, 100, 100, 100, 700, 40, 100_000, 3_000] * 20
    rows = [(i, f"http://a/{i}", chr(97 + i % 26) * n + str(i).zfill(4) if n else None) for i, n in enumerate(sizes)]
    planned = warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2))
    warc.write_warc(planned, str(tmp_path / "w"), records_per_file=10, bytes_per_file=1_000)
    got = warc.read_warc(spark, str(tmp_path / "w")).selectExpr("record_id", "octet_length(payload) AS n", "payload").collect()
    assert {r.record_id: bytes(r.payload).decode() for r in got} == {f"<urn:page:{i}>": t or "" for i, _, t in rows} and len(got) == len(rows)
    import gzip

    for path in (tmp_path / "w").rglob("*.gz"):
        lengths = [int(line.split(b":")[1]) for line in gzip.decompress(path.read_bytes()).split(b"\r\n") if line.startswith(b"Content-Length:")]
        assert 1 <= len(lengths) <= 10 and (sum(lengths) <= 1_000 or len(lengths) == 1)


@pytest.mark.parametrize("scale", [1e6, 3e7])
def test_top_k_of_large_components(spark, scale):
    """Scores near the end of 64 bits are exact; beyond it they are refused, not wrapped."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.uniform(-scale, scale, 2)]) for i in range(120)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5).collect()
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vectors}
    for q in range(0, 120, 20):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == best
    for value in (1e9, 1e300):
        beyond = spark.createDataFrame([(0, [value, value]), (1, [value, value])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="fit into 64 bits"):
            topk.top_k(beyond, beyond, k=1).collect()


def test_mix_layout_follows_the_tree(spark):
    """The layout against a plain walk: a source's block copies, in drawn order, are dealt to shards along its leaf quotas."""
    words = [1 + (7 * i) % 40 for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}") for i, n in enumerate(words)], "doc_id long, text string, source string")
    seed, shards = 7, 16
    plan = mixing.plan_mix(docs, shards=shards, seed=seed).collect()

    def h(*parts):
        return int(hashlib.md5(":".join("null" if p is None else str(p) for p in parts).encode()).hexdigest()[:15], 16)

    names = sorted({r.source for r in plan if r.source is not None}) + [None]
    total = sum(words)
    taken, dealt = {}, {}
    for r in plan:
        place = names.index(r.source) + 1
        n = max(mixing.LEAST_BLOCKS, -(-r.source_size // max(1, -(-total // mixing.BLOCKS))))
        key = (place, h(seed, r.doc_id) % n)
        assert dealt.setdefault(key, r.takes) == r.takes  # a block goes whole
        for t in r.takes:
            taken[(*key, t.copy)] = t.shard
    for place in range(1, len(names) + 1):
        mine = sorted((k for k in taken if k[0] == place), key=lambda k: (h(seed, "draw", *k), k[1], k[2]))
        assert [taken[k] for k in mine] == sorted(taken[k] for k in mine)
    quotas = spark.createDataFrame([(p, sum(k[0] == p for k in taken)) for p in range(1, len(names) + 1)], "place int, q long")
    leaves = {(r.place, r.shard): r.q for r in mixing.split_quotas(quotas, shards, seed).collect()}
    for place in range(1, len(names) + 1):
        for shard in range(shards):
            assert sum(k[0] == place and s == shard for k, s in taken.items()) == leaves[place, shard]
    per_shard = [sum(s == n for s in taken.values()) for n in range(shards)]
    assert max(per_shard) - min(per_shard) <= 1


def test_tree_draws_the_hypergeometric_law(spark):
    """Left counts of one source over many trees against the exact law of drawing without replacement."""
    from math import comb

    seeds, (a, b) = 25, (9, 15)
    quotas = spark.createDataFrame([(1, a), (2, b)], "place int, q long")
    seen = [0] * (a + 1)
    for seed in range(seeds):
        found = {(r.place, r.shard): r.q for r in mixing.split_quotas(quotas, 2, seed).collect()}
        assert found[1, 0] + found[2, 0] == (a + b) // 2 and found[1, 0] + found[1, 1] == a
        seen[found[1, 0]] += 1
    law = [comb(a, x) * comb(b, 12 - x) / comb(a + b, 12) for x in range(a + 1)]
    n = sum(seen)
    mean, want = sum(x * c for x, c in enumerate(seen)) / n, sum(x * p for x, p in enumerate(law))
    spread = (sum(p * (x - want) ** 2 for x, p in enumerate(law)) / n) ** 0.5
    assert abs(mean - want) < 4 * spread and all(law[x] > 1e-4 for x, c in enumerate(seen) if c)
