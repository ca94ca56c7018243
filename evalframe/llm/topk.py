"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Candidates are dealt into parts, and blocks of queries are sent to each part. There each dimension is a list of
candidates sorted by component. For a query, all lists are read in step from the end that scores higher. What has been
read gives each candidate a lower bound (unread components at the far end of their list) and an upper bound (unread
components at the list's present place). Reading stops when few candidates have an upper bound that reaches the k-th
best lower bound or score found so far; outsiders can no longer qualify, and the scores of the rest are resolved.
A task takes its candidates in growing blocks and carries the k-th score on, so the long lists are left early.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import stash
from .embedding_dedup import valid_vectors
from .grouped import groups, matrix

QUERY_BLOCK, CANDIDATE_BLOCK, BLOCKS_A_PART = 1024, 4096, 8
#: Rows of the first block of a part; each later one is as long as all before it, up to CANDIDATE_BLOCK.
FIRST_BLOCK = 128
#: Shares of the lists after which the bounds are looked at, and the share of candidates that may be left to resolve.
DEPTHS, LEFT = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9), 0.2


class SortedLists:
    """The candidates of one block, with a sorted list for each dimension. Whole numbers that single floats hold exactly stay in them."""

    def __init__(self, values: np.ndarray, ids: np.ndarray, largest_query: float) -> None:
        largest = values.shape[1] * largest_query * float(np.abs(values).max(initial=0))
        self.kind = np.float32 if largest < 1 << 24 else np.float64
        self.plain, self.wide = largest >= 1 << 51, largest >= 1 << 62  # bounds in doubles would err; sums may leave 64 bits
        self.values, self.whole, self.ids, self.order = values.astype(self.kind), values, ids, np.argsort(values, axis=0, kind="stable")
        self.lowest, self.highest = self.values.min(0), self.values.max(0)

    def _read(self, top: np.ndarray, bottom: np.ndarray, start: int, end: int) -> None:
        """Read places start to end of each list from both ends: what each value has is copied to top and bottom."""
        n, dims = len(self.ids), np.arange(self.values.shape[1])
        for part, into in ((self.order[n - end : n - start], top), (self.order[start:end], bottom)):
            into[part, dims] = self.values[part, dims]

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """For each query, places and scores of the k best candidates but those with its id (ties to the smaller id), and how deep it read.

        All queries read the same lists: from the top where a component is positive, from the bottom where it is
        negative. top and bottom hold what has been read and NaN elsewhere. Candidates below reach, a query's k-th
        score found elsewhere, may be left out.
        """
        n, found, depths = len(self.ids), [None] * len(queries), np.full(len(queries), len(self.ids))
        up, down = np.maximum(queries, 0).T.astype(self.kind), np.minimum(queries, 0).T.astype(self.kind)
        mine, reach, open_ones, start = self.ids[:, None] == own[None, :], reach.astype(np.float64), np.arange(len(queries)), 0
        top, bottom = np.full(self.values.shape, np.nan, self.kind), np.full(self.values.shape, np.nan, self.kind)
        dims = np.arange(self.values.shape[1])
        for share in DEPTHS if n > 4 * k and not self.plain else ():
            depth = int(n * share)
            self._read(top, bottom, start, depth)
            start = depth
            blind = open_ones[np.isneginf(reach[open_ones])]
            if len(blind):  # lower bounds: what is unread counts at the list's far end
                lower = np.where(np.isnan(top), self.lowest, top) @ up[:, blind] + np.where(np.isnan(bottom), self.highest, bottom) @ down[:, blind]
                least = np.partition(np.where(mine[:, blind], -np.inf, lower), -k, axis=0)[-k]
            else:
                least = reach[:0]
            # upper bounds: what is unread counts at the list's present place
            high, low = self.values[self.order[n - depth - 1], dims], self.values[self.order[depth], dims]
            floor = reach.copy()
            floor[blind] = least
            upper = np.where(np.isnan(top), high, top) @ up[:, open_ones] + np.where(np.isnan(bottom), low, bottom) @ down[:, open_ones]
            able = (upper >= floor[open_ones] - 0.5) & ~mine[:, open_ones]
            few = able.sum(0) <= LEFT * n
            for c in np.flatnonzero(few):
                found[open_ones[c]] = np.flatnonzero(able[:, c])
            depths[open_ones[few]] = depth
            open_ones = open_ones[~few]
            if not len(open_ones):
                break
        out = []
        for q, alive in enumerate(found):
            alive = np.flatnonzero(~mine[:, q]) if alive is None else alive
            scores = _products(self.whole[alive], queries[q]) if self.wide else self.whole[alive] @ queries[q]
            best = np.lexsort((self.ids[alive], -scores))[:k]
            out.append((alive[best], scores[best], int(depths[q])))
        return out


def _products(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size; one that is no 64-bit number is an error."""
    found = values.astype(object) @ query.astype(object)
    if any(abs(x) >= 1 << 63 for x in found):
        raise OverflowError("a score does not fit into 64 bits")
    return found.astype(np.int64)


def _growing(n: int, seen: int) -> Iterator[slice]:
    """Slices of n rows that grow with what has been seen before."""
    start = 0
    while start < n:
        size = min(n - start, max(FIRST_BLOCK, seen + start))
        yield slice(start, start + size)
        start += size


def top_k(df: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 64, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK, with_depth: bool = False) -> DataFrame:
    """For each row of queries, the k rows of df with the highest integer inner product: (query_id, rank, vec_id, score).

    Components become floor(scale * x). Rows with the query's own id are left out; fewer than k others give fewer rows;
    ties go to the smaller id. Vectors that are null or empty or hold null or non-finite components take no part, nor do
    rows with a null id, and vectors only meet vectors of their length. Repeated query ids count once (their smallest
    vector), repeated candidate rows once each. Every query meets every candidate. with_depth adds read, the share of
    its lists that a query's search in the row's part read, entry by entry, before it could stop.

    Scores are exact whatever the components' size; a component or a score that does not fit into 64 bits is an error.
    Blocks whose products may reach 2^51 are scored without bounds, which doubles could not hold exactly.
    """
    scaled = lambda x: x.cast("double") * scale
    outside = lambda x: (F.abs(scaled(x)) >= 2.0**63) & (F.abs(scaled(x)) < float("inf"))
    whole = F.transform("vec", lambda x: F.when(outside(x), F.raise_error("a component does not fit into 64 bits").cast("long")).otherwise(F.floor(scaled(x)).cast("long")))
    able = lambda x: valid_vectors(x, id_col, vec_col).where("id IS NOT NULL").select("id", whole.alias("vec"), F.size("vec").alias("dims"))
    cand, asked = stash(able(df)), stash(able(queries).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("dims", F.size("vec")))
    c_blocks, q_blocks = -(-cand.count() // candidate_block) or 1, -(-asked.count() // query_block) or 1
    parts = -(-c_blocks // BLOCKS_A_PART)
    columns = ["dims", "q", "part", "c", "id", "vec"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    placed = cand.withColumns({"c": F.pmod(F.xxhash64("id"), F.lit(c_blocks)), "q": every(q_blocks)}).withColumn("part", F.col("c") % parts)
    asking = asked.withColumns({"q": F.pmod(F.xxhash64("id"), F.lit(q_blocks)), "part": every(parts), "c": F.lit(-1).cast("long")})
    rows = (
        placed.select(*columns).unionByName(asking.select(*columns))
        .repartitionById(q_blocks * parts, (F.col("q") * parts + F.col("part")).cast("int")).sortWithinPartitions("dims", "q", "part", "c")
    )
    kind = df.schema[id_col].dataType
    schema = StructType([StructField("query_id", kind), StructField("vec_id", kind), *StructType.fromDDL("score long, read double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups come as the queries of a task (c = -1), then its candidate blocks one by one."""
        task, asked_ids, asked_values, kept, read, seen = None, np.zeros(0), np.zeros((0, 0)), [], np.zeros(0), 0

        def results() -> Iterator[pa.RecordBatch]:
            many = [len(ids) for ids, _ in kept]
            if sum(many):
                columns = np.repeat(asked_ids, many), np.concatenate([i for i, _ in kept]), np.concatenate([s for _, s in kept]), np.repeat(read / max(seen, 1), many)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (id_type, id_type, pa.int64(), pa.float64()), strict=True)], names=schema.names)

        for g in groups(batches, 4):
            now, id_type = tuple(g.column(n)[0].as_py() for n in range(3)), g.column(4).type
            values, ids = matrix(g.column(5)), g.column(4).to_numpy()
            if now != task:
                yield from results()
                task, asked_ids, kept, read, seen = now, ids[:0], [], np.zeros(0), 0
            if g.column(3)[0].as_py() < 0:
                asked_ids, asked_values, read = ids, values, np.zeros(len(ids))
                kept = [(ids[:0], values[:0, 0])] * len(ids)
                continue
            for part in _growing(len(ids), seen) if len(asked_ids) else ():
                lists = SortedLists(values[part], ids[part], float(np.abs(asked_values).max()))
                reach = np.array([x[-1] if len(x) == k else -np.inf for _, x in kept])
                for q, (at, score, depth) in enumerate(lists.top(asked_values, asked_ids, k, reach)):
                    both, total = np.concatenate([kept[q][0], ids[part][at]]), np.concatenate([kept[q][1], score])
                    best = np.lexsort((both, -total))[:k]
                    kept[q] = both[best], total[best]
                    read[q] += depth
                seen += len(lists.ids)
        yield from results()

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = rows.mapInArrow(run, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", *(["read"] if with_depth else []))
