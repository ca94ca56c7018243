"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function gives each document its k smallest shingle hashes. Inverted lists of neighbouring retained values
bring documents together; the union sketch of two documents estimates their Jaccard similarity and drops what cannot
reach the threshold; what is left is confirmed on the full shingle sets.

Documents with equal sets are one vertex from the start, so copies never meet each other in a list. In each list the
document with the smallest id is confirmed against all others first. Lists whose documents then still lie in several
components are compared across components, in blocks inside tasks: sketches first, in the first list that a pair
shares, then full sets of the documents whose sketches leave hope. Tasks hand on documents and the links that join
components, never pairs; each row of a list of m documents is sent to as many tasks as the list has blocks (m / BLOCK).
A link is missed only if none of its LISTS neighbouring pairs is shared or its sketches lie SLACK standard errors below
the threshold; each has a chance below 1e-8 for a pair at the threshold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import pin, stash
from .components import connected_components
from .grouped import groups, matrix
from .wordhash import BASES, Powers, Runs, WordHashes

#: Retained hashes of a document, and how many neighbouring pairs of them are looked up. At a similarity of 0.85 the
#: chance that none of 24 neighbouring pairs is shared is below 1e-8; sets of up to 25 shingles are never missed.
SKETCH, LISTS = 64, 24
#: Documents of an inverted list that are compared at once, by sketches and by texts.
BLOCK, TEXTS = 1024, 256
#: Standard errors below the threshold from which on a pair's sketches rule it out.
SLACK = 7


def shingle_set(text: str | None, width: int, words: WordHashes, powers: Powers) -> np.ndarray:
    """Sorted distinct 63-bit hashes of all runs of width words, A-Z lower-cased; of the whole text if it has fewer words."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not tokens:
        return np.zeros(0, np.int64)
    width = min(width, len(tokens))
    start = np.arange(len(tokens) - width + 1)
    return np.unique((Runs(words.of(tokens), powers).hash(start, start + width) >> np.uint64(1)).astype(np.int64))


def sketch(docs: DataFrame, id_col: str, text_col: str, width: int = 5, k: int = SKETCH) -> DataFrame:
    """(id, version, n_shingles, set_digest, sketch): sketch holds the k smallest hashes in order, set_digest 128 bits of the whole set, version 64 of the text."""
    schema = StructType([StructField("id", docs.schema[id_col].dataType), *StructType.fromDDL("version long, n_shingles long, set_digest binary, sketch array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), Powers(BASES[0])
        for batch in batches:
            counts, digests, kept = [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py(), width, words, powers)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                kept.append(found[:k])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), text_col).mapInArrow(run, schema)


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union on the full shingle sets.

    The partners of a are dealt into groups of about 64, each with its own copy of a, and stream past a's set.
    """
    members = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / 64).alias("parts"))
    dealt = pairs.join(members, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    wanted = dealt.select("a", "part", F.col("b").alias("id"), F.lit(1).alias("role")).unionByName(
        dealt.select("a", "part", F.col("a").alias("id"), F.lit(0).alias("role")).distinct()
    )
    rows = wanted.join(texts, "id").repartition("a", "part").sortWithinPartitions("a", "part", "role").select("a", "part", "role", "id", "text")
    kind = pairs.schema["a"].dataType
    schema = StructType([StructField("a", kind), StructField("b", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers, of, base = WordHashes(), Powers(BASES[0]), None, np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for a, part, role, other, text in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                found = shingle_set(text.as_py(), width, words, powers)
                if role == 0:
                    of, base = (a, part), found
                elif of == (a, part):
                    both = len(np.intersect1d(base, found, assume_unique=True))
                    if both and 100 * both >= percent * (len(base) + len(found) - both):
                        out.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], batch.column(0).type) for i in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, schema)


def _estimates(x: np.ndarray, x_size: int, many: np.ndarray, sizes: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union-sketch estimates of one padded sketch against many; how many hashes each rests on; the first shared lead.

    Up to the smaller of the two largest retained hashes, both sets are known in full. A lead is the smaller of two
    neighbouring retained values that both sketches list; the largest integer where there is none.
    """
    k, top = many.shape[1], np.iinfo(np.int64).max
    reach = np.minimum(x[-1] if x_size > k else top - 1, np.where(sizes > k, many[:, -1], top - 1))
    seen = many <= reach[:, None]
    at = np.minimum(np.searchsorted(x, many), k - 1)
    same = (x[at] == many) & (many < top)
    both = (same & seen).sum(1)
    union = np.searchsorted(x, reach, side="right") + seen.sum(1) - both
    next_to = same[:, :-1] & same[:, 1:] & (at[:, 1:] == at[:, :-1] + 1) & (at[:, :-1] < lists)
    next_to[:, lists:] = False
    lead = np.where(next_to.any(1), many[np.arange(len(many)), next_to.argmax(1)], top)
    return both / np.maximum(union, 1), union, lead


def _hopeful(est: np.ndarray, on: np.ndarray, percent: int) -> np.ndarray:
    """Whether an estimate lies at most SLACK standard errors below the threshold; exact where it rests on whole sets.

    On 64 hashes and more, a pair at a threshold of 0.8 or 0.85 falls below with a chance under 1e-8 (binomial tail).
    """
    p = percent / 100
    return est >= p - SLACK * np.sqrt(p * (1 - p) / np.maximum(on, 1))


def _mixed_lists(labelled: DataFrame, block: int) -> DataFrame:
    """(key, blocks) of lists whose rows lie in several components; a stored table, so that Spark knows its size."""
    ends = labelled.groupBy("key").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi"), F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    return stash(ends.where("lo < hi").select("key", "blocks"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Rows (key, blocks, id, ...) dealt so that any two rows of a list meet in one group (key, i, j)."""
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    return own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows plus component_id, their own id where no link has joined them yet."""
    return rows.join(labels, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))


def _compare_lists(listed: DataFrame, sketches: DataFrame, labels: DataFrame, percent: int, k: int, lists: int) -> DataFrame:
    """(key, id) of documents that may link, by their sketches, with one of the same list but another component.

    A pair is looked at only in the first list that it shares.
    """
    padded = sketches.select("id", F.concat("sketch", F.array_repeat(F.lit(np.iinfo(np.int64).max), k - F.size("sketch"))).alias("sketch"))
    mixed = _mixed_lists(_labelled(listed, labels), BLOCK)
    rows = _in_blocks(_labelled(listed.join(mixed, "key"), labels).join(padded, "id"))
    rows = rows.select("key", "i", "j", "own", "lead", "id", "n_shingles", "component_id", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = StructType([*StructType.fromDDL("key long").fields, listed.schema["id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 3):
            key, i, j = (g.column(c)[0].as_py() for c in range(3))
            own, lead, sizes, table = g.column(3).to_numpy(), g.column(4)[0].as_py(), g.column(6).to_numpy(), matrix(g.column(8))
            comps = np.unique(g.column(7).to_numpy(), return_inverse=True)[1]
            flagged = np.zeros(g.num_rows, bool)
            for x in range(g.num_rows):
                near = (comps[x + 1 :] != comps[x]) & (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x]))
                if i != j:
                    near &= own[x + 1 :] != own[x]
                at = np.flatnonzero(near) + x + 1
                if len(at):
                    est, on, first = _estimates(table[x], sizes[x], table[at], sizes[at], lists)
                    good = at[_hopeful(est, on, percent) & (first == lead)]
                    flagged[good] = True
                    flagged[x] |= len(good) > 0
            ids = g.column(5).combine_chunks().filter(pa.array(flagged))
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key)), ids], names=schema.names)

    return rows.mapInArrow(run, schema).distinct()


def _confirm_lists(flagged: DataFrame, texts: DataFrame, labels: DataFrame, percent: int, width: int, k: int) -> DataFrame:
    """Links (a, b), confirmed on full sets, that join different components of a list; what is joined already is not compared again."""
    mixed = _mixed_lists(_labelled(flagged, labels), TEXTS)
    rows = _in_blocks(_labelled(flagged.join(mixed, "key"), labels)).join(texts, "id").select("key", "i", "j", "own", "id", "component_id", "text").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    schema = StructType([StructField("a", flagged.schema["id"].dataType), StructField("b", flagged.schema["id"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, powers = WordHashes(), Powers(BASES[0])
        for g in groups(batches, 3):
            across, own = g.column(1)[0].as_py() != g.column(2)[0].as_py(), g.column(3).to_numpy()
            sets = [shingle_set(t.as_py(), width, words, powers) for t in g.column(6)]
            sizes, table = np.array([len(s) for s in sets]), np.full((len(sets), k), np.iinfo(np.int64).max)
            for row, found in zip(table, sets, strict=True):
                row[: min(k, len(found))] = found[:k]
            root = np.unique(g.column(5).to_numpy(), return_inverse=True)[1]
            out: list[tuple[int, int]] = []
            for x in range(len(sets)):
                near = (root[x + 1 :] != root[x]) & (100 * np.minimum(sizes[x + 1 :], sizes[x]) >= percent * np.maximum(sizes[x + 1 :], sizes[x]))
                if across:
                    near &= own[x + 1 :] != own[x]
                at = np.flatnonzero(near) + x + 1
                if not len(at):
                    continue
                est, on, _ = _estimates(table[x], sizes[x], table[at], sizes[at], 1)
                for y in at[_hopeful(est, on, percent)][np.argsort(-est[_hopeful(est, on, percent)], kind="stable")].tolist():
                    if root[x] == root[y]:
                        continue
                    place = np.minimum(np.searchsorted(sets[x], sets[y]), len(sets[x]) - 1)
                    both = int((sets[x][place] == sets[y]).sum())
                    if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                        out.append((x, y))
                        root[root == root[y]] = root[x]
            if out:
                ids = g.column(4).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([p[n] for p in out])) for n in (0, 1)], names=["a", "b"])

    return rows.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, width: int = 5, k: int = SKETCH, lists: int = LISTS) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Documents link when 100 * intersection >= percent * union of their sets of distinct runs of width words; a text of
    fewer words is one shingle; a null text or one without words has none and links with nothing. component_id is the
    smallest id reachable, kept tells whether that is the row itself. Repeated rows of one id stay one vertex and come
    out as often as they came in. Of different texts under one id, the one with the smallest hash links for the id; the
    others get the component of equal sets, or their own id. A null id links with nothing: its component is null, and it
    is kept. Extra columns are not looked at.
    """
    sketches = stash(sketch(docs, id_col, text_col, width, k))
    repeated = stash(sketches.where("id IS NOT NULL").groupBy("id").agg(F.min("version").alias("chosen"), F.max("version").alias("last")).where("chosen < last").select("id", "chosen"))
    one_text = lambda d: d.join(repeated, "id", "left").where("chosen IS NULL OR chosen = version").drop("chosen")
    # Members of a group have equal sets, so any of them stands for the sketch.
    sets = stash(
        one_text(sketches.where("n_shingles > 0 AND id IS NOT NULL")).groupBy("set_digest")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    )
    keys = sets.where("n_shingles > 1").select(
        "id", "n_shingles",
        F.explode(F.transform(F.sequence(F.lit(1), F.least(F.size("sketch") - 1, F.lit(lists))), lambda i: F.struct(
            F.xxhash64(F.element_at("sketch", i.cast("int")), F.element_at("sketch", (i + 1).cast("int"))).alias("key"), F.element_at("sketch", i.cast("int")).alias("lead"),
        ))).alias("pair"),
    ).select("id", "n_shingles", "pair.*")
    shared = stash(keys.groupBy("key").agg(F.min(F.struct("id", "n_shingles")).alias("first"), F.max("id").alias("last")).where("first.id < last").drop("last"))
    listed = stash(keys.join(shared, "key"))
    docs_in = one_text(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text"))).select("id", "text")
    texts = stash(docs_in.join(listed.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]))

    star = listed.where("id <> first.id").where(
        F.least("n_shingles", "first.n_shingles") * 100 >= F.greatest("n_shingles", "first.n_shingles") * percent
    ).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    links = pin(_verify(star, texts, width, percent))
    labels = connected_components(links)
    flagged = pin(_compare_lists(listed.select("key", "lead", "id", "n_shingles"), sets, labels, percent, k, lists))
    found = pin(_confirm_lists(flagged, texts, labels, percent, width, k))
    if not found.isEmpty():
        labels = connected_components(links.unionByName(found))

    of_set = sets.select("set_digest", F.col("id").alias("first")).join(labels.withColumnRenamed("id", "first"), "first", "left").select("set_digest", F.coalesce("component_id", "first").alias("component_id"))
    out = sketches.select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("set_digest")).alias("set_digest")).join(of_set, "set_digest", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; all columns stay, and so do rows with a null id or no words.

    Rows of one id stay or go together.
    """
    gone = near_duplicates(docs, id_col, text_col, **how).where("NOT kept").select(F.col(id_col).alias("__ef_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__ef_gone"], "left_anti")
