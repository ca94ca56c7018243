"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations.

A rotation is three rounds of random signs and a Walsh-Hadamard transform; the hash is the nearest signed axis. A table
joins HASHES of them into a bucket. Each vector is stored in its own bucket of each table and also probes the buckets
of its next nearest axes. Vectors that meet in a bucket are compared in double precision; a pair counts only in the
first bucket where it meets, so link counts need no list of pairs. Equal vectors are one vertex with a count. Buckets of
many vectors are compared in pairs of blocks, each a task's small matrix product.

Buckets are gone through twice. First only ids and signs meet there: a vector's 128 signed bits under one more rotation
tell whether some other vector of the bucket may be near enough. Only rows with such a partner fetch their vectors and
codes and are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import pin, stash
from .components import connected_components
from .grouped import groups, matrix, whole_groups

TABLES, HASHES, PROBES, BLOCK = 10, 2, 3, 1024
#: Bits of a vector's signs, and how many standard deviations more of them than expected may differ at the threshold: the
#: chance to miss a pair there is below 1e-7 by the exact binomial tail, and falls fast above it.
SIGNS, SLACK = 128, 6


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows whose vector has at least one component and only finite ones."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where(F.size("vec") > 0).where(F.coalesce(finite, F.lit(False)))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, orthonormal; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def codes(unit: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = 11) -> np.ndarray:
    """Bucket numbers (rows, tables, 1 + probes): the own bucket first, then probes by how little they lose."""
    width = 1 << (max(unit.shape[1], probes + 1, 2) - 1).bit_length()
    padded = np.zeros((len(unit), width), np.float32)
    padded[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    out = np.zeros((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        tops, axes = [], []
        for _ in range(hashes):
            x = padded
            for _ in range(3):
                x = hadamard(x * rng.choice(np.array([-1, 1], np.float32), width))
            size = np.abs(x)
            near = np.argsort(-size, axis=1, kind="stable")[:, : probes + 1]
            tops.append(np.take_along_axis(size, near, 1))
            axes.append(2 * near + (np.take_along_axis(x, near, 1) < 0))
        out[:, t, 0] = sum(a[:, 0] * (2 * width) ** k for k, a in enumerate(axes))
        # a probe changes one of the hashes to its next nearest axes; the smallest losses come first
        lost = np.concatenate([s[:, :1] - s[:, 1:] for s in tops], axis=1)
        moved = np.concatenate([out[:, t, :1] + (a[:, 1:] - a[:, :1]) * (2 * width) ** k for k, a in enumerate(axes)], axis=1)
        pick = np.argsort(lost, axis=1, kind="stable")[:, :probes]
        out[:, t, 1:] = np.take_along_axis(moved, pick, 1)
    return out


def signs(unit: np.ndarray, seed: int = 12) -> np.ndarray:
    """SIGNS bits of each row as two integers: on which side of so many random planes the vector lies."""
    planes = np.random.default_rng(seed).normal(size=(unit.shape[1], SIGNS)).astype(np.float32)
    return np.packbits(unit.astype(np.float32) @ planes > 0, axis=1).view(np.int64)


def most_unlike(cosine: float) -> int:
    """Signs that may differ between vectors at this cosine."""
    share = np.arccos(min(1.0, max(-1.0, cosine))) / np.pi
    return int(np.ceil(SIGNS * share + SLACK * np.sqrt(SIGNS * share * (1 - share)))) + 1


def _first_meeting(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For rows of codes x and y: the first (table, bucket) where they meet, as table and bucket columns."""
    tables = x.shape[1]
    none = np.iinfo(np.int64).max
    best = np.full(len(x), none)
    for t in range(tables):
        a, b = x[:, t], y[:, t]
        there = np.where((b == a[:, :1]).any(1), a[:, 0], none)  # y is, or looks, where x is stored
        here = np.where((a == b[:, :1]).any(1), b[:, 0], none)
        bucket = np.minimum(there, here)
        best = np.where((best == none) & (bucket != none), t * (1 << 40) + bucket, best)
    return best


def _local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest vertex of each vertex's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def embedding_links(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row of df.

    Pairs that meet in some bucket link when their cosine, in double precision, is at least cosine; none links below
    it. n_links counts the other rows linked directly, component_id is the smallest id reachable, kept tells whether
    that is the row itself. Null, empty or zero vectors and those with null or non-finite components link with nothing,
    and so do vectors of different lengths with each other. Repeated rows are separate vectors with equal ids. Extra
    columns are not looked at.
    """
    valid = valid_vectors(df, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    one = stash(valid.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    kind = one.schema["id"].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2)])
            for d in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == d)))
                x = matrix(part.column(2)).astype(np.float64)
                x /= np.linalg.norm(x, axis=1)[:, None]
                found, side = codes(x, tables, hashes, probes), signs(x)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * tables * (1 + probes), pa.int32()), pa.array(found.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, flat, pa.array(side[:, 0]), pa.array(side[:, 1])], names=[*part.schema.names, "codes", "signs1", "signs2"])

    placed = stash(one.select("id", "n", "vec").mapInArrow(place, StructType([one.schema["id"], one.schema["n"], one.schema["vec"], *StructType.fromDDL("codes array<int>, signs1 long, signs2 long").fields])))
    each = 1 + probes
    spots = placed.select(F.size("vec").alias("dims"), "id", "signs1", "signs2", F.posexplode("codes").alias("at", "code")).select(
        "dims", (F.floor(F.col("at") / each) * (1 << 40) + F.col("code")).alias("bucket"), (F.col("at") % each == 0).alias("stored"), "id", "signs1", "signs2"
    )
    crowded = stash(spots.groupBy("dims", "bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")).where("blocks > 1"))

    def dealt(rows: DataFrame, *columns: str) -> DataFrame:
        """Rows sorted by bucket; any two of a bucket meet in one group (dims, bucket, i, j)."""
        own = rows.join(crowded, ["dims", "bucket"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
        pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        return pairs.select("dims", "bucket", "i", "j", "own", "stored", "id", *columns).repartition("dims", "bucket", "i", "j").sortWithinPartitions("dims", "bucket", "i", "j")

    unlike = most_unlike(cosine)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with another of their bucket whose signs leave hope."""
        for g in whole_groups(batches, 4):
            keys = [g.column(c).to_numpy() for c in range(4)]
            own, stored, *side = (g.column(c).to_numpy() for c in (4, 5, 7, 8))
            side, across = [x.view(np.uint64) for x in side], keys[2] != keys[3]
            head = np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])
            size = np.diff(np.r_[head, g.num_rows])
            after = np.repeat(head + size, size) - np.arange(g.num_rows) - 1  # rows of the group that follow
            hope, step, x = np.zeros(g.num_rows, bool), 1, np.flatnonzero(after)
            while len(x):
                y = x + step
                apart = sum(np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) for bits in side)
                near = (apart <= unlike) & (stored[x] | stored[y]) & (~across[x] | (own[x] != own[y]))
                hope[x[near]] = hope[y[near]] = True
                step += 1
                x = x[after[x] >= step]
            if hope.any():
                yield from g.select(["dims", "bucket", "stored", "id"]).filter(pa.array(hope)).to_batches()

    few = dealt(spots, "signs1", "signs2").mapInArrow(sieve, StructType([spots.schema[c] for c in ("dims", "bucket", "stored", "id")])).distinct()
    rows = dealt(few.join(placed.select("id", "n", "vec", "codes"), "id"), "n", "vec", "codes")
    out_schema = StructType([StructField("id", kind), StructField("root", kind), *StructType.fromDDL("n_links long").fields])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 4):
            if g.num_rows < 2:
                continue
            bucket, i, j = (g.column(k)[0].as_py() for k in range(1, 4))
            own, stored = g.column(4).to_numpy(), g.column(5).to_numpy()
            weight, found = g.column(7).to_numpy(), matrix(g.column(9)).astype(np.int64).reshape(g.num_rows, tables, 1 + probes)
            x = matrix(g.column(8)).astype(np.float64)
            x /= np.linalg.norm(x, axis=1)[:, None]
            hits = np.triu(x @ x.T >= cosine, 1) & (stored[:, None] | stored[None, :])
            if i != j:
                hits &= own[:, None] != own[None, :]
            a, b = np.nonzero(hits)
            keep = np.concatenate([np.zeros(0, bool), *(
                _first_meeting(found[a[s : s + 65536]], found[b[s : s + 65536]]) == bucket for s in range(0, len(a), 65536)
            )])
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            links = np.bincount(a, weight[b], g.num_rows) + np.bincount(b, weight[a], g.num_rows)
            root, linked = _local_roots(g.num_rows, a, b), np.flatnonzero(links)
            ids = g.column(6).combine_chunks()
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(linked)), ids.take(pa.array(root[linked])), pa.array(links[linked].astype(np.int64))], names=["id", "root", "n_links"])

    partial = pin(rows.mapInArrow(compare, out_schema))
    labels = connected_components(partial, "id", "root")
    counts = partial.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    linked = counts.join(labels, "id", "left")
    groups_of = one.join(linked, "id", "left").select("vec", (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    rest = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    out = rest.join(groups_of, "vec", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
    )
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
