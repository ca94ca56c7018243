"""Contiguous shards of near-equal size, from prefix sums over the whole table.

No row passes through a single task: rows are dealt by range, each range is summed, the few range totals are
accumulated, and each range then continues from its own offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pin


def assign_shards(df: DataFrame, size_col: str, order_cols: list[str], shards: int = 16, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """Add shard (0 .. shards-1) and slot (position in its shard, gapless from 0) to every row of df.

    Rows are laid out by order_cols (nulls first); a row goes to the shard in whose share of the total size its middle
    falls, so each shard's size differs from the mean by less than the largest row. Null or negative sizes count as 0;
    if all sizes are 0 every row goes to shard 0. Rows with equal order_cols are told apart by their place in the input,
    so that a key which holds most rows is still spread over tasks. Columns of the names it adds are replaced.
    Extra columns stay. An empty table gives an empty table.
    """
    spare = "__ef_"
    size = F.greatest(F.coalesce(F.col(size_col).cast("long"), F.lit(0)), F.lit(0))
    base = df.drop(*(c for c in (shard_col, slot_col) if c not in (size_col, *order_cols)))
    numbered = base.withColumns({f"{spare}size": size, f"{spare}tie": F.monotonically_increasing_id()})
    keys = [*order_cols, f"{spare}tie"]
    ranged = pin(numbered.repartitionByRange(*keys).withColumn(f"{spare}part", F.spark_partition_id()))

    # One row for each range: as many as there are partitions.
    before = Window.orderBy(f"{spare}part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        ranged.groupBy(f"{spare}part").agg(F.sum(f"{spare}size").alias("b"), F.count(F.lit(1)).alias("n"))
        .select(
            f"{spare}part",
            F.coalesce(F.sum("b").over(before), F.lit(0)).alias(f"{spare}from_size"),
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{spare}from_row"),
            F.sum("b").over(Window.partitionBy()).alias(f"{spare}total"),
        )
    )
    within = Window.partitionBy(f"{spare}part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(totals), f"{spare}part").withColumns({
        f"{spare}start": F.col(f"{spare}from_size") + F.coalesce(F.sum(f"{spare}size").over(within), F.lit(0)),
        f"{spare}row": F.col(f"{spare}from_row") + F.count(F.lit(1)).over(within),
    })
    cut = F.expr(f"CASE WHEN {spare}total = 0 THEN 0 ELSE least({shards - 1}L, ((2 * {spare}start + {spare}size) * {shards}) div (2 * {spare}total)) END")
    placed = placed.withColumn(shard_col, cut.cast("int"))
    first = placed.groupBy(shard_col).agg(F.min(f"{spare}row").alias(f"{spare}first"))  # one row a shard
    out = placed.join(F.broadcast(first), shard_col).withColumn(slot_col, F.col(f"{spare}row") - F.col(f"{spare}first"))
    return out.select(*(c for c in df.columns if c not in (shard_col, slot_col) or c in (size_col, *order_cols)), shard_col, slot_col)


def write_shards(df: DataFrame, path: str, shard_col: str = "shard", slot_col: str = "slot") -> None:
    """Write one folder for each shard, rows in slot order within each file."""
    df.repartitionByRange(shard_col, slot_col).sortWithinPartitions(shard_col, slot_col).write.partitionBy(shard_col).parquet(path)
