"""Global order without a global sort in one task: rows dealt by range, and what one range hands to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import new_folder

#: The column that holds a row's range, in ranged() and in what is built on it.
RANGE = "__ef_range"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, evaluated once: written to the shared folder and read back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df plus RANGE, rising with order: the rows of a smaller range come before those of a larger one.

    The ranges are Spark's (spark.sql.shuffle.partitions of them) and are stored with the rows, so they stay the same
    however often the result is read. Spark samples df for their limits, which evaluates it once more: store a costly df
    first. Rows that are equal in all of order share a range, so order should tell rows apart.
    """
    return stored(df.repartitionByRange(*order).withColumn(RANGE, F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list[str], name: str, by: str | None = None) -> DataFrame:
    """df plus name: 0, 1, 2, ... in the order of the columns order, gapless; within each value of by if given (null is one).

    Ranges are numbered each by itself and shifted by the rows before them, so a group or a table of any size is spread
    over all ranges. Rows that order does not tell apart are numbered in any order. A tiny table of ranges (and of
    groups' first numbers) is joined; Spark broadcasts it by its size.
    """
    way = [*([by] if by else []), *order]
    dealt = ranged(df, way)
    sizes = dealt.groupBy(RANGE).agg(F.count(F.lit(1)).alias("__ef_n"))  # one row a range
    before = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(RANGE, F.coalesce(F.sum("__ef_n").over(before), F.lit(0)).alias("__ef_before"))
    place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*way)) - 1
    out = dealt.withColumn(name, place).join(offsets, RANGE).withColumn(name, (F.col(name) + F.col("__ef_before")).cast("long")).drop(RANGE, "__ef_before")
    if by is None:
        return out
    counts = dealt.groupBy(F.col(by).alias("__ef_by"), RANGE).agg(F.count(F.lit(1)).alias("__ef_n"))
    # A group's first number: the rows of the ranges before its first one, and those of smaller groups within that.
    inside = Window.partitionBy(RANGE).orderBy("__ef_by").rowsBetween(Window.unboundedPreceding, -1)
    at = counts.withColumn("__ef_in", F.coalesce(F.sum("__ef_n").over(inside), F.lit(0))).join(offsets, RANGE)
    starts = at.groupBy("__ef_by").agg(F.min(F.col("__ef_before") + F.col("__ef_in")).alias("__ef_start"))
    return out.join(starts, F.col(by).eqNullSafe(F.col("__ef_by"))).withColumn(name, F.col(name) - F.col("__ef_start")).drop("__ef_by", "__ef_start")


def with_neighbours(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df's rows (key, order and value) plus previous and first: value of the row of the same key before, in order (null for
    the first), and of the key's first row.

    A key's rows may lie in many ranges. A range hands on the last value that it has of its last key; the ranges at whose
    edges a key is cut are one row each, so any share of rows may have one key. Rows that order does not tell apart
    go by value. Rows with a null key must be left out before.
    """
    dealt = ranged(stored(df.select(*dict.fromkeys([key, *order, value])), "keyed"), [key, *order])
    me = F.struct(*(F.col(c).alias(f"o{n}") for n, c in enumerate(order)), F.col(value).alias("v"))
    edges = dealt.groupBy(RANGE).agg(F.min(key).alias("low"), F.max(key).alias("high"))  # one row a range
    cut = edges.withColumn("next", F.lead("low").over(Window.orderBy(RANGE))).where("high = next").select(F.col("high").alias(key)).distinct()
    cut = stored(cut, "cut")
    pieces = dealt.join(cut, key, "left_semi").groupBy(key, RANGE).agg(F.min(me).alias("head"), F.max(me).alias("tail"))
    along = Window.partitionBy(key).orderBy(RANGE)
    handed = stored(pieces.select(key, RANGE, F.lag("tail").over(along)["v"].alias("__ef_previous"), F.first("head").over(along)["v"].alias("__ef_first"), (F.row_number().over(along) > 1).alias("__ef_later")), "handed")
    here = Window.partitionBy(RANGE, key).orderBy(*order, value)
    out = dealt.select("*", F.row_number().over(here).alias("__ef_place"), F.lag(value).over(here).alias("__ef_lag"), F.first(value).over(here).alias("__ef_head")).join(handed, [key, RANGE], "left")
    later = F.coalesce("__ef_later", F.lit(False))
    return out.select(
        *dict.fromkeys([key, *order, value]),
        F.when(later & (F.col("__ef_place") == 1), F.col("__ef_previous")).otherwise(F.col("__ef_lag")).alias("previous"),
        F.when(later, F.col("__ef_first")).otherwise(F.col("__ef_head")).alias("first"),
    )
