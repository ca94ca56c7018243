"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id in links; component_id is the smallest id reachable.

    Labels start as the smallest neighbour and shrink by neighbour minimum and pointer jumping until none changes, so
    the number of rounds follows the logarithm of a path's length. A hub's links are reduced by partial aggregation,
    and its join partition can be split, so no task needs a whole neighbourhood. Each round is checkpointed. Links with
    a null end and loops on one id are ignored.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = pin(links.union(links.select("b", "a")).distinct())
    labels = pin(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("c")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        lower = pin(lower)
        of = lower.select(F.col("id").alias("c"), F.col("c").alias("next"))
        labels = pin(lower.join(of, "c").select("id", "old", F.least("c", "next").alias("c")))
        if labels.where("c < old").isEmpty():
            return labels.select("id", F.col("c").alias("component_id"))
        labels = labels.select("id", "c")
