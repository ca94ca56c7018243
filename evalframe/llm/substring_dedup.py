"""Repeated passages by seed and extend.

Seeds: the winnowed anchor of a window is its leftmost smallest hash of ANCHOR words, so two documents that share a
window share its anchor, and documents are joined on anchors. A unit is a run of windows of one document with the same
anchor; anchors that only one document holds end there.

Extension goes both ways from a shared anchor. First over the unit as a whole: documents with the same words there
repeat all of it, and only the first holder of each distinct unit goes on. Then over half a window to the left or to
the right: a window reaches that far on one of its sides, so where no other unit has the same words there, nothing is
repeated on that side. What is left is extended to whole windows, each way that the anchor can lie in one. Overlapping
repeats of a document merge into maximal ones.

Counts and smallest ids are all that is gathered for an anchor, unit, half or window, so a passage that many documents
share is reduced before it is shuffled, and no pairs of documents are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stash
from .wordhash import BASES, Powers, Runs, WordHashes

ANCHOR = 12
#: Words that are hashed at once; a longer text is taken on its own.
CHUNK = 200_000


def _leftmost_min(x: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost smallest value of each run of w values, by doubling the runs' width."""
    at, width = np.arange(len(x)), 1
    while width < w:
        step = min(width, w - width)
        left, right = x[:-step], x[step:]
        later = right < left
        x, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        width += step
    return at


class Units:
    """Units of several documents: maximal runs of windows with their anchor in one place."""

    def __init__(self, window: int) -> None:
        self.window, self.anchor = window, min(ANCHOR, window)
        self.reach = window - self.anchor  # words of a window beside its anchor
        self.half = (self.reach + 1) // 2  # a window has so many words on the left of its anchor, or right on its right
        self.right = self.reach - self.half + 1
        self.words, self.powers = WordHashes(), [Powers(b) for b in BASES]

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of the first text, word hashes of a row of texts, and where each text's words end."""
        first, ends, hashes, held = 0, [], [], 0
        for n, text in enumerate(texts):
            tokens = (text.as_py() or "").encode().split()
            hashes.append(self.words.of(tokens))
            held += len(tokens)
            ends.append(held)
            if held >= CHUNK:
                yield first, np.concatenate(hashes), np.array(ends)
                first, ends, hashes, held = n + 1, [], [], 0
        if ends:
            yield first, np.concatenate(hashes), np.array(ends)

    def seeds(self, hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each unit: text, anchor, hash of all its words, of its left and right half (0: not in the unit), first window, words before the anchor there, windows."""
        begins = np.r_[0, ends[:-1]]
        windows = np.maximum(ends - begins - self.window + 1, 0)
        of = np.repeat(np.arange(len(ends)), windows)
        if not len(of):
            return (np.zeros(0, np.int64),) * 8
        start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[of]
        runs, gram = Runs(hashes, self.powers[0]), np.arange(len(hashes) - self.anchor + 1)
        grams = runs.hash(gram, gram + self.anchor).view(np.int64)
        place = _leftmost_min(grams, self.reach + 1)[start]
        head = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        many = np.diff(np.r_[head, len(place)])
        first, at, of = start[head], place[head], of[head]
        whole = runs.hash(first, first + many - 1 + self.window).view(np.int64)
        lead = at - first
        keys = []
        for there, low, high in ((lead >= self.half, at - self.half, at + self.anchor), (lead - many + 1 < self.half, at, at + self.anchor + self.right)):
            key = runs.hash(np.where(there, low, at), np.where(there, high, at)) >> np.uint64(33)
            keys.append(np.where(there, key.astype(np.int64) + 1, 0))
        return of, grams[at], whole, keys[0], keys[1], first - begins[of], lead, many

    def window_hashes(self, starts: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        return [Runs(hashes, p).hash(starts, starts + self.window).view(np.int64) for p in self.powers]


def _seeds(docs: DataFrame, window: int) -> DataFrame:
    """(id, version, anchor, words_hash, left_key, right_key, first, lead, many) of each unit of each document."""
    names = "version int, anchor long, words_hash long, left_key int, right_key int, first int, lead int, many int"
    schema = StructType([docs.schema["id"], *StructType.fromDDL(names).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(window)
        for batch in batches:
            for row, hashes, ends in units.chunks(batch.column(2)):
                of, anchor, whole, *rest = units.seeds(hashes, ends)
                at = pa.array(of + row)
                columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor), pa.array(whole), *(pa.array(x.astype(np.int32)) for x in rest)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _windows(open_docs: DataFrame, window: int) -> DataFrame:
    """(id, version, start, h1, h2) of each window whose start lies in one of the row's stretches (from, to)."""
    schema = StructType([open_docs.schema["id"], *StructType.fromDDL("version int, start int, h1 long, h2 long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(window)
        for batch in batches:
            wanted = batch.column(3)
            for row, hashes, ends in units.chunks(batch.column(2)):
                begins = np.r_[0, ends[:-1]]
                lists = wanted.slice(row, len(ends))
                of = np.repeat(np.arange(len(ends)), [len(x) for x in lists])
                spans = lists.flatten()
                low, high = (spans.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (0, 1))
                many = np.maximum(high - low, 0)
                starts = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
                of = np.repeat(of, many)
                h1, h2 = units.window_hashes(starts + begins[of], hashes)
                at = pa.array(of + row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(starts.astype(np.int32)), pa.array(h1), pa.array(h2)], names=schema.names)

    return open_docs.mapInArrow(run, schema)


def _cut(docs: DataFrame) -> DataFrame:
    """Take the spans (start, end) out of each text: (id, n_words, n_removed, repeats, kept_text)."""
    schema = StructType([docs.schema["id"], *StructType.fromDDL("n_words long, n_removed long, repeats array<struct<start: int, end: int>>, kept_text string").fields])
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, repeats, kept = [], [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                tokens, merged = (text.as_py() or "").encode().split(), []
                counts.append(len(tokens))
                for s in sorted(spans.as_py() or (), key=lambda s: s["start"]):
                    if merged and s["start"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                    else:
                        merged.append(s)
                removed.append(sum(s["end"] - s["start"] for s in merged))
                edges = [0, *(s[e] for s in merged for e in ("start", "end")), len(tokens)]
                repeats.append(merged)
                kept.append(b" ".join(t for a, b in zip(edges[::2], edges[1::2], strict=True) for t in tokens[a:b]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(repeats, pa.list_(span)), pa.array(kept, pa.string())], names=schema.names)

    return docs.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """(id_col, n_words, n_removed, repeats, kept_text) for every row of docs.

    A word is removed when some window of window words over it also starts in a document with a smaller id; repeats
    holds the maximal runs of such words (first word, end), kept_text the other words joined by one space. Windows are
    judged on the input. Repeats within one document, or between rows of one id, stay. A null text has no words and an
    empty kept_text. Texts below window words are kept whole. Rows with a null id are kept whole. Words are compared by
    128 hashed bits; different texts under one id are cut each on its own. Extra columns are not looked at.
    """
    source = docs.select(F.col(id_col).alias("id"), F.hash(text_col).alias("version"), F.col(text_col).alias("text"))
    seeds = stash(_seeds(source.where("id IS NOT NULL"), window))
    shared = stash(seeds.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor"))
    live = stash(seeds.join(shared, "anchor", "left_semi"))

    # the unit as a whole
    same = F.min("left_key").alias("left_key"), F.min("right_key").alias("right_key")  # equal in equal units
    held = stash(live.groupBy("anchor", "words_hash").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), *same))
    several = (F.min("words_hash") < F.max("words_hash")) & (F.min("first_id") < F.max("first_id"))
    mixed = stash(held.groupBy("anchor").agg(several.alias("several")).where("several").select("anchor"))

    # half a window to one side
    sides = held.join(mixed, "anchor", "left_semi").select(
        "anchor", "words_hash", "first_id", F.posexplode(F.array("left_key", "right_key")).alias("side", "key"),
    ).where("key > 0")
    met = stash(sides.groupBy("anchor", "side", "key").agg(several.alias("several")).where("several").select("anchor", "side", "key"))
    open_units = sides.join(met, ["anchor", "side", "key"], "left_semi").groupBy("anchor", "words_hash").agg(
        F.min("first_id").alias("first_id"), (F.min("side") == 0).alias("go_left"), (F.max("side") == 1).alias("go_right"),
    )
    wanted = stash(
        held.where("first_id < last_id").select("anchor", "words_hash", F.col("first_id").alias("seen"))
        .join(open_units, ["anchor", "words_hash"], "full").select("anchor", "words_hash", F.coalesce("seen", "first_id").alias("first_id"), "go_left", "go_right")
    )
    half = Units(window).half
    turn = F.col("first") + F.col("lead") - half + 1  # from this window on, less than half a window lies to the left
    end = F.col("first") + F.col("many")
    found = stash(
        live.join(wanted, ["anchor", "words_hash"]).groupBy("id", "version").agg(
            F.collect_set(F.when(F.col("first_id") < F.col("id"), F.struct(F.col("first").alias("start"), (end + window - 1).alias("end")))).alias("whole"),
            F.collect_set(F.when((F.col("first_id") == F.col("id")) & F.coalesce(F.col("go_left") | F.col("go_right"), F.lit(False)), F.struct(
                F.when(F.col("go_left"), F.col("first")).otherwise(F.greatest("first", turn)).alias("from"),
                F.when(F.col("go_right"), end).otherwise(F.least(end, turn)).alias("to"),
            ))).alias("open"),
        )
    )

    # whole windows
    open_docs = source.join(found.where("size(open) > 0").select("id", "version", "open"), ["id", "version"]).select("id", "version", "text", "open")
    windows = stash(_windows(open_docs, window))
    first = stash(windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h1", "h2", "first"))
    starts = windows.join(first, ["h1", "h2"]).where("first < id").groupBy("id", "version").agg(
        F.collect_set(F.struct("start", (F.col("start") + window).cast("int").alias("end"))).alias("some")
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = found.where("size(whole) > 0").select("id", "version", "whole").join(starts, ["id", "version"], "full").select(
        "id", "version", F.concat(F.coalesce("whole", none), F.coalesce("some", none)).alias("spans")
    )
    return _cut(source.join(spans, ["id", "version"], "left").select("id", "text", "spans")).withColumnRenamed("id", id_col)
