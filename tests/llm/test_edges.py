"""All registered queries of the training-data operators, and the pipeline, on tables of odd rows and on empty ones."""

import pytest

import corpus_pipeline
from evalframe.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score string"
ODD_DOCS = [
    (1, "one line\nand another of some more words here", "en", "a", 9, 1, "x"), (1, "one line\nand another of some more words here", "en", "a", 9, 1, "x"), (1, "another text under one id", "en", "b", 9, 1, "x"),
    (2, None, None, None, None, None, None), (3, "", "en", "a", 0, 0, ""), (4, "  \n \t ", "de", "b", 5, 0, None), (None, "a text without an id, word after word after word", "en", None, 1, 1, "y"),
    (5, "x" * 60_000, "en", "a", 60_000, 1, "z"), (6, "word " * 30_000, "fr", "b", 150_000, 1, "z"), (7, "日本語の文章" * 300, "ja", "c", 1800, 1, "z"), (8, "▁ mark \x01   end", "en", "c", 9, 1, "z"),
    *((10 + i, f"text number {i} " * (i + 1), "en", f"s{i}", 9, 1, "w") for i in range(6)),
]
ODD_LABELS = [(1, 1, 0), (5, 0, 1), (10, 1, 0), (11, 0, 1), (12, None, None), (None, 1, 1), (13, 1, 0), (13, 1, 1)]
ODD_VECTORS = [
    (20, [1.0, 0.0, 0.0, 0.0], 1), (20, [1.0, 0.0, 0.0, 0.0], 1), (None, [1.0, 0.1, 0.0, 0.0], 1), (40, None, None), (60, [], 1), (80, [float("nan"), 1.0, 1.0, 1.0], 1), (100, [0.0, 0.0, 0.0, 0.0], 1),
    (1, [1.0, 2.0], 1), (2, [0.9, 0.1, 0.0, 0.0], 1), (3, [float("inf"), 0.0, 0.0, 0.0], 1), (4, [None, 1.0, 1.0, 1.0], 1),
]
ODD_PAGES = [(1, "u", "p" * 200, 1), (None, None, "p" * 200, 1), (2, "u", None, 1), (2, "u", None, 1), (3, "u\r\nX: y", "", 1), (4, "u", "p" * 200, 1), (5, "u", "short", 1)]
ODD_TURNS = [(100, 0, "user", "hello", 1), (101, None, None, None, 1), (101, 1, "user", "", 1), (102, 3, "user", "x" * 50_000, 1), (102, 3, "user", "x" * 50_000, 1), (None, 0, "user", "nobody's", 1), (-5, 0, "user", "hello", 1), (7, 0, "user", "hello", 1)]


@pytest.fixture(scope="module", params=["odd", "empty"])
def tables(request, spark, tmp_path_factory):
    folder, keep = tmp_path_factory.mktemp(request.param), request.param == "odd"
    for name, rows, schema in (
        ("documents", ODD_DOCS, DOCS), ("labels", ODD_LABELS, "doc_id long, quality int, toxic int"), ("embeddings", ODD_VECTORS, "vec_id long, embedding array<float>, label int"), ("pages", ODD_PAGES, "page_id long, url string, html string, payload int"),
        ("conversations", ODD_TURNS, "conv_id long, turn long, role string, text string, depth int"),
    ):
        spark.createDataFrame(rows if keep else [], schema).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder), {"documents": len(ODD_DOCS) * keep, "embeddings": len(ODD_VECTORS) * keep, "pages": len(ODD_PAGES) * keep}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_every_query(spark, tables, name):
    folder, size = tables
    rows = queries.QUERIES[name](spark, folder).collect()
    of = {"op6": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    if name not in ("op3_mix_layout", "op8_exact_top_k", "op13_prefix_trie"):  # one row of the result for each row of the table
        assert len(rows) == size[of]
    if name == "op8_exact_top_k":
        assert all(r.query_id in (20, 100) and r.vec_id is not None for r in rows) and bool(rows) == bool(size[of])
    if name == "op13_prefix_trie":
        assert sum(r.depth == 0 for r in rows) == bool(size[of]) and all(r.n_convs <= 5 for r in rows)
    if name == "op11_merkle_manifest" and rows:
        assert len({r.root for r in rows}) == 1 and all(r.verified == (r.folded_root == r.root) for r in rows)
    if name == "op5_sentence_pieces":
        assert all(r.round_trip for r in rows if r.doc_id != 8)
    if name == "op9_substring_dedup":
        assert all(r.n_removed <= r.n_words for r in rows)


def test_pipeline(spark, tables):
    rows = corpus_pipeline.run(spark, tables[0]).collect()
    assert all(r.round_trip for r in rows if r.doc_id != 8) and bool(rows) == bool(tables[1]["documents"])
