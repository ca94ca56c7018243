"""Merkle manifest of a table: binary hash trees by nested-struct rollup, with an inclusion proof for every leaf.

Leaves are ranked within their tree; the binary digits of the rank are key columns. Within a block of 2**BITS leaves
the digits are grouped away one after the other, lowest first, each time nesting the two children's structs in their
parent's: all of a block's groupings share one exchange. The blocks' roots are the leaves of the next, far smaller
rollup, until one node a tree is left. Proofs come from the nested structs alone: on the way back each block gets the
path above it by union and grouping, and one transform and explode emits every leaf with its whole path.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: A block holds 2**BITS nodes: that bounds every nested struct.
BITS = 8
NULL = "-"
PATH = "array<struct<hash:string,right:boolean>>"


def field(text: Column) -> Column:
    """A value as it enters a leaf: its UTF-8 byte count, a colon and the value; `-` for null."""
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit(NULL))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def ranked(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """df plus rank, every row's place (from 0) among its tree's rows by order, nulls first, and n, the tree's size; stored.

    Rows are dealt by range; numbers within a range follow from row ids, ranges continue from the few totals of those
    before them. So a tree that holds most rows, or all, is ranked by all tasks; so are rows alike in every column.
    """
    keys = [*(F.col(c).asc_nulls_first() for c in (tree, *order)), F.col("__ef_tie")]
    dealt = df.withColumn("__ef_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__ef_tie")
    rows = stash(dealt.withColumns({"__ef_row": F.monotonically_increasing_id(), "__ef_part": F.spark_partition_id()}))
    whole = Window.partitionBy("__ef_tree")
    before = whole.orderBy("__ef_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(F.col("__ef_part").alias("__ef_run"), F.col(tree).alias("__ef_tree")).agg(F.min("__ef_row").alias("__ef_first"), F.count(F.lit(1)).alias("__ef_n"))
    runs = runs.withColumns({"__ef_before": F.coalesce(F.sum("__ef_n").over(before), F.lit(0)), "n": F.sum("__ef_n").over(whole)}).drop("__ef_n")
    placed = rows.join(runs, (F.col("__ef_part") == F.col("__ef_run")) & F.col(tree).eqNullSafe(F.col("__ef_tree")))
    return placed.withColumn("rank", F.col("__ef_row") - F.col("__ef_first") + F.col("__ef_before")).drop("__ef_row", "__ef_part", "__ef_run", "__ef_tree", "__ef_first", "__ef_before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, n, block, hash, kids): nodes (tree, n, rank, hash, row) rolled up to one nested struct for each 2**BITS."""
    digits = [f"CAST(shiftright(rank, {j}) & 1 AS TINYINT) AS d{j}" for j in range(BITS)]
    up = nodes.selectExpr("tree", "n", f"shiftright(rank, {BITS}) AS block", *digits, "hash", "row AS kids").repartition("tree", "block")
    for j in range(BITS):
        run = F.expr(f"sort_array(collect_list(named_struct('d', d{j}, 'hash', hash, 'kids', kids)))")
        up = up.groupBy("tree", "block", *(f"d{i}" for i in range(j + 1, BITS))).agg(F.max("n").alias("n"), run.alias("kids"))
        # A run of one is hashed too while its tree has several nodes on this level; the last node of a tree passes on.
        up = up.selectExpr("*", f"CASE WHEN n > {1 << j} THEN sha2(array_join(kids.hash, ''), 256) ELSE kids[0].hash END AS hash")
    return up.select("tree", "n", "block", "hash", "kids")


def _unfold(kids: str, level: int, above: str, number: str) -> str:
    """Array of (number, path, hash, row) of the leaves below; a path has a step for each level of its tree, lowest first."""
    k = f"k{level}"
    step = f"named_struct('hash', IF(size({kids}) = 2, get({kids}, 1 - {k}.d).hash, NULL), 'right', {k}.d = 1)"
    path = f"concat(IF(n > {1 << level}, array({step}), CAST(array() AS {PATH})), {above})"
    here = f"({number} * 2 + {k}.d)"
    if level:
        return f"flatten(transform({kids}, {k} -> {_unfold(f'{k}.kids', level - 1, path, here)}))"
    return f"transform({kids}, {k} -> named_struct('number', {here}, 'path', {path}, 'hash', {k}.hash, 'row', {k}.kids))"


def _proved(nodes: DataFrame, most: int, finish: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """nodes (tree, n, rank, hash, row) with path, sub and root. most: size of the largest tree; finish: the same of the trees' last nodes."""
    blocks = stash(_blocks(nodes))
    ends = blocks.select("tree", F.ceil(F.col("n") / (1 << BITS)).cast("long").alias("n"), F.col("block").alias("rank"), "hash", F.lit(None).cast("boolean").alias("row"))
    above = finish(ends) if most <= 1 << BITS else _proved(ends, -(-most >> BITS), finish)
    both = blocks.drop("hash").unionByName(above.select("tree", F.col("rank").alias("block"), "path", "sub", "root"), allowMissingColumns=True)
    whole = both.groupBy("tree", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "kids", "path", "sub", "root")))
    leaves = whole.select("tree", "n", "sub", "root", F.explode(F.expr(_unfold("kids", BITS - 1, "path", "block"))).alias("x"))
    return leaves.select("tree", "n", F.col("x.number").alias("rank"), "x.hash", "x.row", "x.path", "sub", "root")


def _top(ends: DataFrame) -> DataFrame:
    """The same for the single node above all trees: its hash is the root, nothing is above it."""
    return ends.select("tree", "rank", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("sub"), F.col("hash").alias("root"))


def _forest(ends: DataFrame) -> DataFrame:
    """The trees' subroots are the leaves of one more tree, in the order of their trees' keys."""
    roots = ranked(ends.select(F.lit(0).alias("all"), F.struct("tree", F.col("hash").alias("sub")).alias("row"), "tree", "hash"), "all", ["tree"])
    trees = roots.agg(F.max("n")).first()[0] or 1  # one number
    top = _proved(roots.select(F.col("all").alias("tree"), "n", "rank", "hash", "row"), trees, _top)
    return top.select("row.tree", F.lit(0).cast("long").alias("rank"), "path", "row.sub", "root")


def manifest(df: DataFrame, fields: list[str], tree_col: str, order_col: str, altered: dict[str, Column] | None = None) -> DataFrame:
    """order_col, leaf, altered_leaf, subroot, root and path of every row of df, a leaf of the tree of its tree_col value.

    A leaf is the digest of the fields; a tree's leaves ascend by order_col (nulls first; equal ones by leaf), every two
    neighbours become their digest until one is left, a lone last one becomes its own digest. The subroots, by tree_col
    (nulls first, by UTF-8 bytes), make the root in the same way. path lists steps (hash, right) from the leaf to the
    root: the sibling's hash, null where there is none, and whether the leaf's side is the right one. altered gives other
    values for some fields, for leaves that a check must refuse (altered_leaf; without it the leaf).

    Repeated rows are leaves of their own, a null tree_col is a tree, null and empty fields differ, an empty table gives no
    rows; other columns of df play no part. A text is hashed where it is read and never shuffled.
    """
    spoilt = altered or {}
    parts = lambda changed: [field(changed.get(c, F.col(c)).cast("string")) for c in fields]
    leaves = stash(df.select(F.col(tree_col).alias("tree"), F.struct(F.col(order_col).alias("id")).alias("key"), digest(*parts({})).alias("hash"), digest(*parts(spoilt)).alias("altered")))
    numbered = ranked(leaves, "tree", ["key", "hash"])
    most = numbered.agg(F.max("n")).first()[0] or 1  # one number
    nodes = numbered.select("tree", "n", "rank", "hash", F.struct("key.id", "altered").alias("row"))
    return _proved(nodes, most, _forest).select(
        F.col("row.id").alias(order_col), F.col("hash").alias("leaf"), F.col("row.altered").alias("altered_leaf"), F.col("sub").alias("subroot"), "root", "path"
    )


def proof_digest(path: Column) -> Column:
    """Digest of a proof's siblings, lowest first."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["hash"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    up = lambda at, s: F.when(s["hash"].isNull(), F.sha2(at, 256)).when(s["right"], F.sha2(F.concat(s["hash"], at), 256)).otherwise(F.sha2(F.concat(at, s["hash"]), 256))
    return F.aggregate(path, leaf, up)
