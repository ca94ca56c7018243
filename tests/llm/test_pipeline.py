"""The pipeline's stages, each held against brute force on its own input."""

import corpus_pipeline
from evalframe.llm import mixing, queries
from tests.llm.test_llm import expected_components, toxic_corpus


def test_stages(spark, tmp_path):
    rows = toxic_corpus(160)
    clean = [t for _, t, y in rows if not y]
    docs = [(i, t, "en", f"s{i % 12}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, clean[5] + (" tail" if i else ""), "en", "s1", 9) for i in range(3)]
    docs += [(2000 + i, f"{clean[20 + i]}\nprinted everywhere", "de", f"s{i}", 9) for i in range(12)] + [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "sentence_pieces"]
    before = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in stages.items():
        stage(spark, before, str(tmp_path)).write.parquet(str(tmp_path / name))
        out[name] = (before.collect(), (before := spark.read.parquet(str(tmp_path / name))).collect())
        if name != "sentence_pieces":
            assert before.columns == list(corpus_pipeline.COLUMNS)
    source, kept = out["toxicity"]
    toxic = {i for i, _, y in rows if y}
    assert len({r.doc_id for r in kept} & toxic) <= 0.2 * len(toxic) and len({r.doc_id for r in source} - toxic - {r.doc_id for r in kept}) <= 0.1 * len(source)
    source, kept = out["line_dedup"]
    assert len(kept) == len(source)
    held = [r.doc_id for r in kept if r.text and "printed everywhere" in r.text]
    assert len(held) == 1
    source, kept = out["minhash_near_dedup"]
    _, root = expected_components({r.doc_id: r.text for r in source}, 80)
    assert sorted(r.doc_id for r in kept) == sorted(k for k, v in root.items() if k == v)
    source, kept = out["mixing"]
    known = {r.doc_id: r for r in source}
    assert all(known[r.doc_id] == r for r in kept) and max(sum(r.doc_id == k for r in kept) for k in known) <= 3
    plan = {r.doc_id: len(r.takes) for r in mixing.plan_mix(spark.read.parquet(str(tmp_path / "minhash_near_dedup"))).collect()}
    assert sum(plan.values()) == len(kept)
    source, kept = out["sentence_pieces"]
    assert len(kept) == len(source) and all(r.round_trip for r in kept)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept)


def test_near_copies_at_80(spark, tmp_path):
    """The stage links from 0.8 on: 45 of 55 shingles do, 39 of 49 do not."""
    texts = {}
    for n, words in enumerate((54, 48)):
        base = [f"w{n}x{i}" for i in range(words)]
        texts |= {2 * n: " ".join(base), 2 * n + 1: " ".join([*base[:20], "other", *base[21:]])}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    _, root = expected_components(texts, 80)
    assert root == {0: 0, 1: 0, 2: 2, 3: 3} and len(set(expected_components(texts, 85)[1].values())) == 4
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()) == sorted(k for k, v in root.items() if k == v)


def test_mix_order(spark, tmp_path):
    """The mixing stage hands on its copies by shard, in shuffled order, as op3_mix_layout names them."""
    docs = spark.createDataFrame([(i, f"word {i} " * (1 + i % 5), "en", f"s{i % 4}", 9) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.QUERIES["op3_mix_layout"](spark, str(tmp_path)).collect()
    want = [r.doc_id for r in sorted(plan, key=lambda r: (r.mix_shard, r.mix_order))]
    assert len({r.mix_shard for r in plan}) > 1 and len({(r.doc_id, r.mix_copy) for r in plan}) == len(plan) > len({r.doc_id for r in plan})
    assert [r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()] == want != sorted(want)
