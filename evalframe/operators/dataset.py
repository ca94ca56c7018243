"""Checks on labelled datasets: duplicates, conflicts, leakage, distributions, digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import normalize_text
from ..sources.files import open_store
from ..sources.shared import new_folder
from .numbering import with_neighbours

#: Items of one automaton, and their first characters that it holds: at most about 2,000,000 nodes.
ITEMS, PATTERN = 10_000, 200


def duplicates(df: DataFrame, key: str, id_col: str, order: list[str] | None = None) -> DataFrame:
    """Rows whose key came before, with the row before and the first one: (key, id, previous_id, first_id).

    df is evaluated once. Rows are dealt by ranges of key and order, so a key that holds any share of the rows is spread
    (numbering.with_neighbours). A null key repeats nothing, and a row after one with a null id is not reported.
    """
    way = order or [id_col]
    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), *(F.col(c).alias(f"o{n}") for n, c in enumerate(way)), F.col(id_col).alias("v"))
    placed = with_neighbours(named, "k", [f"o{n}" for n in range(len(way))], "v")
    return placed.where("previous IS NOT NULL").select(F.col("k").alias(key), F.col("v").alias("id"), F.col("previous").alias("previous_id"), F.col("first").alias("first_id"))


def conflicts(df: DataFrame, key: str, label_key: str, id_col: str) -> DataFrame:
    """Keys with more than one label: (key, labels, rows, first_id)."""
    return df.groupBy(key).agg(F.countDistinct(label_key).alias("labels"), F.count(F.lit(1)).alias("rows"), F.min(id_col).alias("first_id")).where("labels > 1")


def leakage(df: DataFrame, key: str, split_col: str) -> DataFrame:
    """Keys in more than one split: (key, splits, rows)."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(split_col)).alias("splits"), F.count(F.lit(1)).alias("rows")).where(F.size("splits") > 1)


def label_distribution(df: DataFrame, vocabulary: DataFrame, fields: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, field, label, n) for every label of vocabulary(field, label), zero where none occurs; other labels are left out."""
    by = by or []
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields))).alias("x")).select(*by, "x.*")
    counts = long.groupBy(*by, "field", "label").agg(F.count(F.lit(1)).alias("n"))
    frame = vocabulary.select("field", "label")
    if by:
        frame = df.select(*by).distinct().crossJoin(frame)  # groups times a closed vocabulary
    return frame.join(counts, [*by, "field", "label"], "left").select(*by, "field", "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def set_digest(df: DataFrame, key: str, by: list[str] | None = None, distinct: bool = True) -> DataFrame:
    """sha256 of the sorted keys, each ended by LF. One value gathers all keys of a group; see prefix_digest for many."""
    if distinct:
        df = df.select(*(by or []), key).distinct()
    return df.groupBy(*(by or [])).agg(F.count(key).alias("keys"), F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(key)), "\n"), F.lit("\n")), 256).alias("digest"))


def prefix_digest(df: DataFrame, key: str, digits: int = 3, by: list[str] | None = None) -> DataFrame:
    """A digest of digests for very many hexadecimal keys: one per prefix, then one over prefixes. Not equal to set_digest."""
    by = by or []
    parts = set_digest(df.withColumn("prefix", F.substring(key, 1, digits)), key, [*by, "prefix"])
    return parts.groupBy(*by).agg(F.sum("keys").alias("keys"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digest"))


def validate_dataset(df: DataFrame, id_col: str, key: str, label_key: str, split_col: str, splits: list[str]) -> DataFrame:
    """All violations of a dataset: (check_ordinal, check, key, detail). The first error is the smallest ordinal."""
    row = lambda n, name, d, k, detail: d.select(F.lit(n).alias("check_ordinal"), F.lit(name).alias("check"), F.col(k).cast("string").alias("key"), detail.cast("string").alias("detail"))
    wanted = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    empty = wanted.join(df.select(F.col(split_col).alias("split")).distinct(), "split", "left_anti")
    same_id = df.groupBy(id_col).count().where("count > 1")
    return (
        row(0, "split_missing", empty, "split", F.lit("no rows"))
        .unionByName(row(1, "conflicting_labels", conflicts(df, key, label_key, id_col), key, F.col("first_id")))
        .unionByName(row(2, "duplicate_id", same_id, id_col, F.col("count")))
        .unionByName(row(3, "duplicate_input", duplicates(df, key, id_col), "id", F.col("first_id")))
        .unionByName(row(4, "cross_split_leakage", leakage(df, key, split_col), key, F.array_join("splits", ",")))
    )


def containment(docs: DataFrame, items: DataFrame, block: int = ITEMS) -> DataFrame:
    """(item_id, doc_id) for documents whose normalised text holds an item's; an empty item is in none.

    Items are written in blocks of about block rows; a task reads a block, builds one automaton over the items' first
    PATTERN characters and walks each document once, whatever the items' lengths. A longer item is then compared whole. So
    texts are not shuffled, a task holds one block, and documents are walked once for every block of items. Repeated items and
    documents are each reported as often as they come, a document that holds an item several times once; null texts play no part.
    """
    bodies = lambda d, i: d.select(i, normalize_text("text", fold=True).alias("body")).where("body <> ''")
    spark, path = docs.sparkSession, new_folder(docs.sparkSession, "items")
    known = bodies(items, "item_id").withColumn("nth", F.monotonically_increasing_id())
    known.write.parquet(path)
    stored = spark.read.schema(known.schema).parquet(path)
    blocks = -(-stored.count() // block)
    by_block = f"{path}-blocks"
    stored.withColumn("block", F.pmod(F.xxhash64("nth"), F.lit(max(blocks, 1)))).repartition("block").write.partitionBy("block").parquet(by_block)
    schema = StructType([StructField("item_id", items.schema["item_id"].dataType), StructField("doc_id", docs.schema["doc_id"].dataType)])
    found, source = spark.createDataFrame([], schema), bodies(docs, "doc_id")
    for n in range(blocks):
        found = found.unionByName(source.mapInArrow(_walker(f"{by_block}/block={n}"), schema))
    return found


def _walker(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work for one block of items: (doc_id, body) to (item_id, doc_id)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        store, top = open_store(folder)
        names = [f.path for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        held = pa.concat_tables([pq.read_table(store.open_input_file(n), columns=["item_id", "body"]) for n in names]) if names else None
        if held is None or not held.num_rows:
            return
        ids, texts = held["item_id"].combine_chunks(), held["body"].to_pylist()
        starts: dict[str, list[int]] = {}
        for place, text in enumerate(texts):
            starts.setdefault(text[:PATTERN], []).append(place)
        automaton = ahocorasick.Automaton()
        for start, places in starts.items():
            automaton.add_word(start, places)
        automaton.make_automaton()
        for batch in batches:
            rows, hits = [], []
            for row, body in enumerate(batch.column(1)):
                text, seen = body.as_py(), set()
                for _, places in automaton.iter(text):
                    seen.update(places)
                true = [p for p in sorted(seen) if len(texts[p]) <= PATTERN or texts[p] in text]
                rows += [row] * len(true)
                hits += true
            if rows:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(hits)), batch.column(0).take(pa.array(rows))], names=["item_id", "doc_id"])

    return walk


def full_diff(declared: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows where two keyed tables differ: (keys, status: missing, extra or changed, declared, actual)."""
    a, b = declared.select(*keys, F.col(value).alias("declared"), F.lit(1).alias("in_a")), actual.select(*keys, F.col(value).alias("actual"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(~F.col("declared").eqNullSafe(F.col("actual")), "changed")
    return a.join(b, keys, "full").withColumn("status", status).where("status IS NOT NULL").select(*keys, "status", "declared", "actual")


def same_population(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """(only_a, only_b): how many ids each side has alone; both 0 for equal populations."""
    both = a.select(id_col).distinct().withColumn("a", F.lit(1)).join(b.select(id_col).distinct().withColumn("b", F.lit(1)), id_col, "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def missing_members(values: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Members of the vocabulary that do not occur, and values outside it: (column, side)."""
    v, d = values.select(column).distinct(), vocabulary.select(column).distinct()
    return d.join(v, column, "left_anti").withColumn("side", F.lit("missing")).unionByName(v.join(d, column, "left_anti").withColumn("side", F.lit("extra")))


def noise_plan(df: DataFrame, id_col: str, label_col: str, labels: list[str], fraction: float, seed: int, rows: int | None = None) -> DataFrame:
    """Exactly round(rows * fraction) rows (half to even), picked by sha256(seed:id), each moved to the next label.

    (id, original, corrupted), the plan of a label-noise experiment; a label that is null or not in labels becomes null.
    rows defaults to the table's count.
    """
    k = round((df.count() if rows is None else rows) * fraction)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    known = F.array(*map(F.lit, labels))
    place = F.array_position(known, F.col(label_col).cast("string"))
    moved = F.when(place > 0, F.element_at(known, (place % len(labels) + 1).cast("int")))
    return df.orderBy(order, id_col).limit(k).select(F.col(id_col).alias("id"), F.col(label_col).alias("original"), moved.alias("corrupted"))


def limited(df: DataFrame, id_col: str, n: int | None) -> tuple[DataFrame, Column]:
    """The first n rows by id and whether that leaves rows out."""
    return (df, F.lit(False)) if n is None else (df.orderBy(id_col).limit(n), F.lit(df.count() > n))


def plan_digest(plan: DataFrame) -> DataFrame:
    """(keys, digest) of a label-noise plan: a digest of digests over its rows, whatever their order."""
    row = F.sha2(F.to_json(F.struct("corrupted", F.col("id").cast("string").alias("id"), "original")), 256)
    return prefix_digest(plan.select(row.alias("k")), "k")
