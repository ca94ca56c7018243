"""The registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import uuid

from . import embedding_dedup, line_dedup, merkle, minhash, mixing, pieces, prefix_trie, privacy, sharding, substring_dedup, topk, toxicity, warc
from .common import scratch_dir, table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("clean_sha256"),
    )


def op2_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.assign_shards(sized, "size", ["doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("takes")).alias("taken"))


def op3_mix_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the splitting tree puts each copy that op3_mix_sources takes: its shard, and its place in the shard's shuffle."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "mix_copy", "mix_shard", "mix_order")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = toxicity.fit_and_score(docs, labels)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("pieces_hash"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"),
    )


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, size and type come from the archives; a response's payload is hashed again as read."""
    path = f"{scratch_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_warc(warc.plan_records(table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")  # a null id comes back null
    full = warc.read_warc(spark, path).where("record_type = 'response'").select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
    )
    short = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        number("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )
    return full.unionByName(short)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    spoilt = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    more = {"n_chars": F.when(spoilt, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}
    proved = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", more)
    folded = proved.withColumn("folded_root", merkle.fold(F.col("altered_leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.find_private(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    counts = [privacy.count_of("private", k).alias(f"n_{k}") for k in privacy.KINDS[: privacy.BASE]]
    return found.select("doc_id", *counts, F.sha2(privacy.spans_text(privacy.base_spans("private")), 256).alias("base_sha256"), privacy.spans_text("private").alias("spans"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = prefix_trie.turns_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    heads = own.where("id % 100 = 0").select(F.col("id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    taken = (F.crc32(F.col("id").cast("string").cast("binary")) % 6).cast("int")
    rest = F.slice("turns", taken + 1, F.greatest(F.size("turns") - taken, F.lit(0)))
    turns = F.when(F.col("head").isNotNull(), F.concat(F.slice("head", F.lit(1), taken), rest)).otherwise(rest)
    return prefix_trie.build_trie(own.join(heads, F.col("id") - F.col("id") % 100 == F.col("base"), "left").select("id", turns.alias("turns")))


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_shard_by_bytes, op3_mix_sources, op3_mix_layout, op4_toxicity, op5_sentence_pieces, op6_embedding_near_dedup,
    op7_minhash_near_dedup, op8_exact_top_k, op9_substring_dedup, op10_warc_round_trip, op11_merkle_manifest, op12_private_data, op13_prefix_trie,
)}



def crc32_sql(name: str, column: str) -> str:
    """CTEs crcs (s, crc): the unsigned CRC-32 of a table's ids in decimal."""
    return f"""
WITH RECURSIVE tabs AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
crcs AS MATERIALIZED (SELECT s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)))::BIGINT AS crc FROM (SELECT DISTINCT {column}::VARCHAR AS s FROM {name} WHERE {column} IS NOT NULL), tabs),"""


ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents
), l AS (SELECT doc_id, source, z[1] AS line, z[2] AS pos FROM lines WHERE trim(z[1], ' ') <> ''),
flagged AS (SELECT line, min((doc_id, pos)) AS first FROM l GROUP BY line HAVING count(DISTINCT source) >= 10),
gone AS (SELECT doc_id, list(pos) AS pos FROM l JOIN flagged USING (line) WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(g.pos), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g.pos IS NULL THEN text ELSE
    coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g.pos, i - 1)), chr(10)), '') END) AS clean_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id = g.doc_id""",
    "op2_shard_by_bytes": r"""
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
s AS (SELECT doc_id, (coalesce(strlen(text), 0) + 1)::BIGINT AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)))::BIGINT AS text_crc32 FROM s, t),
p AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
  (sum(size) OVER ())::BIGINT AS total FROM c),
q AS (SELECT *, least(15, ((2 * start + size) * 16) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM q""",
    "op3_mix_sources": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, (sum(source_size) OVER ())::BIGINT AS total FROM s),
w AS (SELECT *, 1 + (place - 1) % 3 AS weight, source_size * 3 AS cap FROM r),
v AS (SELECT *, (total - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap > level * weight AS free FROM v),
water AS (SELECT arg_min(level, (cap / weight, place)) AS x FROM f WHERE free),
g AS (SELECT source, place, source_size, CASE WHEN free THEN x * weight ELSE cap::DOUBLE END AS target,
  greatest(64, ceil(source_size / greatest(1, ceil(total / 4096))))::BIGINT AS nb FROM f, water),
e AS (SELECT d.*, g.place, g.source_size, g.target, ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % nb AS block
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
b AS (SELECT place, block, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(source_size) AS source_size FROM e GROUP BY place, block),
m AS (SELECT *, coalesce(sum(words) OVER o, 0) + words / 2.0::DOUBLE AS middle, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM b
  WINDOW o AS (PARTITION BY place ORDER BY ('0x' || substr(md5('7:order:' || place || ':' || block), 1, 15))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT place, block, least(3, whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS copies FROM m)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM e JOIN k USING (place, block)""",
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = id LEFT JOIN n ON vec_id = a""",
    "op8_exact_top_k": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
QUALIFY rank <= 20""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(list_transform(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 4, 1) END), lambda i: hash(w[i + 1 : i + 5])))) AS s FROM w),
u AS MATERIALIZED (SELECT min(doc_id) AS id, s FROM s WHERE len(s) > 0 GROUP BY s),
x AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS h FROM u),
p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
links AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS r FROM u UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.r = links.a),
c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
g AS (SELECT s, component_id FROM u JOIN c USING (id))
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM s LEFT JOIN g ON s.s = g.s""",
    "op9_substring_dedup": r"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM w)),
f AS (SELECT h, min(doc_id) AS first FROM x GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM x JOIN f USING (h) WHERE first < doc_id GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j - 1))) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id""",
    "op10_warc_round_trip": r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f""",
    "op11_merkle_manifest": crc32_sql("documents", "doc_id") + r"""
d AS (SELECT *, (SELECT crc FROM crcs WHERE crcs.s = coalesce(doc_id::VARCHAR, 'null')) % 7 = 0 AND doc_id IS NOT NULL AS spoilt FROM documents),
f AS (SELECT doc_id, lang, spoilt, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
  n_chars, coalesce(strlen(text) || ':' || text, '-') AS z FROM d),
leaf AS MATERIALIZED (SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
  CASE WHEN spoilt THEN sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) END AS altered FROM f),
base AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
t AS (SELECT lang, 0 AS lvl, idx, leaf AS h, n FROM base UNION ALL SELECT lang, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, lvl, idx // 2),
subs AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, idx, h, n FROM subs UNION ALL SELECT lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (max(n) + 1) // 2 FROM u WHERE n > 1 GROUP BY lvl, idx // 2),
steps AS (SELECT b.doc_id, b.leaf, b.altered, x.lvl, b.lang, s.h AS sib, (b.idx >> x.lvl) & 1 AS side FROM base b JOIN (SELECT DISTINCT lang, lvl FROM t WHERE n > 1) x ON b.lang IS NOT DISTINCT FROM x.lang
    LEFT JOIN t s ON s.lang IS NOT DISTINCT FROM b.lang AND s.lvl = x.lvl AND s.idx = xor(b.idx >> x.lvl, 1)
  UNION ALL SELECT b.doc_id, b.leaf, b.altered, 1000 + x.lvl, b.lang, s.h, (g.idx >> x.lvl) & 1 FROM base b JOIN subs g ON b.lang IS NOT DISTINCT FROM g.lang JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) x ON true
    LEFT JOIN u s ON s.lvl = x.lvl AND s.idx = xor(g.idx >> x.lvl, 1)),
p AS (SELECT doc_id, leaf, lang, any_value(altered) AS altered, sha256(coalesce(string_agg(sib, '' ORDER BY lvl), '')) AS proof,
  list(CASE WHEN sib IS NULL THEN 'N' WHEN side = 1 THEN 'R' || sib ELSE 'L' || sib END ORDER BY lvl) AS path FROM steps GROUP BY doc_id, leaf, lang),
q AS (SELECT b.doc_id, b.leaf, g.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(b.altered, b.leaf), coalesce(path, [])), lambda v, s: sha256(CASE WHEN s[1] = 'N' THEN v WHEN s[1] = 'R' THEN s[2:] || v ELSE v || s[2:] END)) AS folded_root
  FROM base b JOIN subs g ON b.lang IS NOT DISTINCT FROM g.lang LEFT JOIN p ON p.doc_id IS NOT DISTINCT FROM b.doc_id AND p.leaf = b.leaf AND p.lang IS NOT DISTINCT FROM b.lang)
SELECT *, folded_root = root AS verified FROM q""",
    "op13_prefix_trie": crc32_sql("conversations", "conv_id") + r"""
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos, k, chars FROM
  (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, ''))::BIGINT AS chars FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, (SELECT crc FROM crcs WHERE s = conv_id::VARCHAR) % 6 AS h FROM t),
r AS (SELECT c.conv_id, t.pos, t.k, t.chars FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= h
  UNION ALL SELECT c.conv_id, pos + 1000000, k, chars FROM c JOIN t USING (conv_id) WHERE pos > h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS d FROM r),
p AS MATERIALIZED (SELECT conv_id, d, chars, md5(string_agg(k, '' ) OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM o),
q AS MATERIALIZED (SELECT conv_id, d, chars, node FROM p UNION ALL SELECT conv_id, 0, 0, '' FROM c),
l AS (SELECT conv_id, max(d) AS len FROM q GROUP BY conv_id),
n AS MATERIALIZED (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(q.conv_id::VARCHAR, ',' ORDER BY q.conv_id) FILTER (WHERE d = len), '') AS ends FROM q JOIN l USING (conv_id) GROUP BY node, d),
up AS MATERIALIZED (SELECT n.node, n.conv_id, n.d, x.node AS parent FROM n JOIN q x ON x.conv_id = n.conv_id AND x.d = n.d - 1),
kids AS (SELECT parent AS node, count(*) AS n_children FROM up GROUP BY parent),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
s AS (SELECT a.node, sum((f.n_children = 0)::BIGINT) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved FROM f JOIN q a ON a.conv_id = f.conv_id AND a.d <= f.d GROUP BY a.node)
SELECT f.conv_id, f.d::BIGINT AS depth, pn.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s USING (node) LEFT JOIN up USING (node) LEFT JOIN n pn ON pn.node = up.parent""",
    "op12_private_data": r"""
WITH k AS (SELECT * FROM (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'),
  (5, 'account', '\b(?i:account|acct|passport|ssn)(?: ?(?i:number|no\.?|#))?[ :=#]{1,3}[A-Z]{0,2}[0-9](?:[ -]?[0-9]){4,16}\b'),
  (6, 'address', '[A-Za-z][A-Za-z0-9+.-]{0,31}://[^\x00-\x20/?#@<>\x22]+@[A-Za-z0-9.-]+(?::[0-9]+)?'),
  (7, 'iban', '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b')) AS v(place, kind, rule)),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT r, place, kind, regexp_extract_all(text, rule) AS f, string_split_regex(text, rule) AS p FROM d, k),
n AS (SELECT r, place, kind, f, p, unnest(range(1, len(f) + 1)) AS i FROM m),
o AS (SELECT r, place, kind, f[i] AS hit, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start,
  string_split(regexp_replace(f[i], '[^0-9]', '', 'g'), '') AS g FROM n),
v AS (SELECT r, place, kind, hit, start + CASE WHEN place = 5 THEN length(hit) - length(regexp_extract(hit, '[A-Z]{0,2}[0-9](?:[ -]?[0-9])*$')) ELSE 0 END AS start, start + length(hit) AS stop FROM o WHERE CASE place
  WHEN 2 THEN len(list_filter(string_split(hit, '.'), lambda x: x::HUGEINT > 255)) = 0
  WHEN 3 THEN len(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(g) + 1), lambda j: CASE WHEN j % 2 = 1 THEN g[len(g) - j + 1]::INT ELSE g[len(g) - j + 1]::INT * 2 // 10 + g[len(g) - j + 1]::INT * 2 % 10 END)) % 10 = 0
  WHEN 4 THEN len(g) BETWEEN 9 AND 15
  WHEN 7 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(replace(hit, ' ', '')[5:] || hit[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c)::BIGINT - 55 END)),
    lambda a, b: (a * CASE WHEN b < 10 THEN 10 ELSE 100 END + b) % 97) = 1
  ELSE true END),
s AS (SELECT r, count(*) FILTER (WHERE place = 1) AS n_email, count(*) FILTER (WHERE place = 2) AS n_ip, count(*) FILTER (WHERE place = 3) AS n_card, count(*) FILTER (WHERE place = 4) AS n_phone,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) AS spans, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY place, start) FILTER (WHERE place <= 4) AS base FROM v GROUP BY r)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card, coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (r)""",
}
