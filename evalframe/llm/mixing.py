"""Mix sources to target weights by exact block quotas and a multivariate hypergeometric splitting tree.

Documents of a source are dealt into blocks by a hash of their id (a random permutation cut into blocks of about equal
size). Each source's target becomes a number of block copies. A binary tree over the output shards splits the vector
of quotas: at each node, the counts that go left are one draw from the multivariate hypergeometric distribution, so
leaves hold exact quotas that add up. Each source's permuted block copies are then cut along its leaf quotas: shards
get disjoint blocks, and a shard shuffles its documents locally. Only counts pass through the tree; documents meet one
table of block copies in one join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash60, n_words, pin

#: Blocks of the whole corpus; a source of a third of all words has a third of them. A small source has LEAST_BLOCKS.
BLOCKS, LEAST_BLOCKS = 4096, 64
#: Sources whose counts are drawn in one array; more are drawn group by group.
GROUP = 256


def source_targets(sizes: DataFrame, source_col: str = "source", size_col: str = "source_size", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Add weight, total and target to one row for each source.

    Sources by code point, null last, weigh weights, repeating. Together they get the total of all sizes, each at most
    max_epochs times its own; what exceeds that is shared among the rest by weight until none is above. Solved in one
    pass: in the order of cap / weight, a source is capped when its cap is at most its share of what smaller ones leave.
    One row a source, so a window over all of them is small.
    """
    everyone, by_name = Window.partitionBy(), Window.orderBy(F.col(source_col).asc_nulls_last())
    ranked = sizes.withColumn("place", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    ).withColumns({"total": F.sum(size_col).over(everyone), "cap": F.col(size_col) * max_epochs})
    up_to = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumn(
        "level",
        (F.col("total") - F.coalesce(F.sum("cap").over(up_to), F.lit(0))).cast("double")
        / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(up_to), F.lit(0))),
    ).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    water = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("place")))).over(everyone)
    return level.withColumn("target", F.when(F.col("free"), water * F.col("weight")).otherwise(F.col("cap").cast("double"))).drop("level", "free", "cap")


def _ln_factorial(n: str) -> str:
    """SQL for ln(n!): exact below 16, Stirling's series above."""
    low = ", ".join(f"{math.lgamma(k + 1)!r}D" for k in range(16))
    return f"(CASE WHEN {n} < 16 THEN element_at(array({low}), cast({n} + 1 AS int)) ELSE {n} * ln({n}) - {n} + 0.5D * ln(2 * pi() * {n}) + 1 / (12D * {n}) - 1 / (360D * {n} * {n} * {n}) END)"


def _split_left(seed: int) -> str:
    """SQL over a node's quotas (array of source and quota) and cap_left: the array of counts that go left.

    Source by source, the count is drawn given what is still wanted, by walking the hypergeometric distribution's
    cumulated weights to a uniform number that depends on the seed, the node and the source. Weights are taken within
    10 standard deviations of the mode.
    """
    lf = _ln_factorial
    # u: successes (this source), v: failures (later sources), w: draws still wanted
    weight = f"exp(-({lf('x')} + {lf('(s.q - x)')} + {lf('(s.w - x)')} + {lf('(s.rest - s.q - s.w + x)')}) + s.top)"
    top = f"({lf('s.mode')} + {lf('(s.q - s.mode)')} + {lf('(s.w - s.mode)')} + {lf('(s.rest - s.q - s.w + s.mode)')})"
    uniform = f"(cast(conv(substring(md5(concat_ws(':', '{seed}', lo, hi, e.place)), 1, 13), 16, 10) AS double) / 4503599627370496D)"
    drawn = f"""
      element_at(transform(array(named_struct('q', e.q, 'w', a.w, 'rest', a.rest)), t ->
        element_at(transform(array(named_struct('q', t.q, 'w', t.w, 'rest', t.rest,
            'lo', greatest(0L, t.w - (t.rest - t.q)), 'hi', least(t.q, t.w),
            'mode', least(least(t.q, t.w), greatest(greatest(0L, t.w - (t.rest - t.q)), cast(floor((t.q + 1D) * (t.w + 1D) / (t.rest + 2D)) AS bigint))),
            'reach', cast(10 + 10 * sqrt(t.w * (t.q / greatest(t.rest, 1D)) * (1 - t.q / greatest(t.rest, 1D))) AS bigint))), m ->
          element_at(transform(array(named_struct('q', m.q, 'w', m.w, 'rest', m.rest, 'mode', m.mode, 'top', 0D, 'lo', greatest(m.lo, m.mode - m.reach), 'hi', least(m.hi, m.mode + m.reach))), r ->
            element_at(transform(array(named_struct('q', r.q, 'w', r.w, 'rest', r.rest, 'mode', r.mode, 'lo', r.lo, 'hi', r.hi, 'top', {top.replace('s.', 'r.')})), s ->
              element_at(transform(array(transform(sequence(s.lo, s.hi), x -> {weight})), ws ->
                least(s.hi, s.lo + aggregate(ws, named_struct('left', {uniform} * aggregate(ws, 0D, (b, y) -> b + y), 'n', 0L),
                  (b, y) -> CASE WHEN b.left >= y THEN named_struct('left', b.left - y, 'n', b.n + 1) ELSE named_struct('left', -1D, 'n', b.n) END, b -> b.n))), 1)), 1)), 1)), 1)), 1)"""
    return f"""aggregate(quotas, named_struct('w', cap_left, 'rest', total, 'out', cast(array() AS array<bigint>)),
      (a, e) -> element_at(transform(array({drawn}), d -> named_struct('w', a.w - d, 'rest', a.rest - e.q, 'out', concat(a.out, array(d)))), 1), a -> a.out)"""


def split_quotas(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Split exact quotas (place, q: long, one row a source) among shards 0 .. shards-1: (shard, place, q).

    For each source the shards' counts add up to its quota, and each shard gets its share of all blocks, rounded. At each
    node a draw over groups of GROUP sources comes first, then one within each group
    for what the group got, which is the same distribution; so an array holds one entry a group, or one a group's source.
    """
    entry = F.struct("place", F.col("q").cast("long").alias("q"))
    nodes = (
        quotas.select(F.floor((F.col("place") - 1) / GROUP).cast("int").alias("group"), entry.alias("e"))
        .groupBy("group").agg(F.array_sort(F.collect_list("e")).alias("quotas")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "group", "quotas")
    )
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        sized = nodes.withColumn("mid", F.expr("(lo + hi) div 2").cast("int")).withColumn("total", F.expr("aggregate(quotas, 0L, (b, e) -> b + e.q)"))
        # group numbers below 0 keep the groups' random numbers apart from the sources'
        above = sized.groupBy("lo", "mid", "hi").agg(F.array_sort(F.collect_list(F.struct((-1 - F.col("group")).alias("place"), F.col("total").alias("q")))).alias("quotas"), F.sum("total").alias("total"))
        above = above.withColumn("cap_left", F.expr("cast((total * (mid - lo) + (hi - lo) div 2) div (hi - lo) AS bigint)")).withColumn("got", F.expr(_split_left(seed)))
        caps = above.select("lo", "hi", F.explode(F.arrays_zip(F.col("quotas.place").alias("place"), F.col("got").alias("got"))).alias("x")).select("lo", "hi", (-1 - F.col("x.place")).alias("group"), F.col("x.got").alias("cap_left"))
        both = pin(sized.join(caps, ["lo", "hi", "group"]).withColumn("go_left", F.expr(_split_left(seed))).select("lo", "mid", "hi", "group", "quotas", "go_left"))
        left = both.select("lo", F.col("mid").alias("hi"), "group", F.expr("transform(quotas, (e, i) -> named_struct('place', e.place, 'q', go_left[i]))").alias("quotas"))
        right = both.select(F.col("mid").alias("lo"), "hi", "group", F.expr("transform(quotas, (e, i) -> named_struct('place', e.place, 'q', e.q - go_left[i]))").alias("quotas"))
        nodes = left.where("hi > lo").unionByName(right)  # a single shard passes on as its own right half
    return nodes.select(F.col("lo").alias("shard"), F.explode("quotas").alias("e")).select("shard", "e.place", "e.q")


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, shards: int = 16, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, blocks: int = BLOCKS, seed: int = 7) -> DataFrame:
    """docs plus size, source_size, target and takes (array of copy and shard: one entry for each time the mix takes it).

    size: a document's size, by default its number of words (null text: 0). Each source's taken size differs from its
    target by half a block at most (a block holds about 1 / blocks of the corpus or 1 / 64 of its source, whichever is less,
    or one document if that is more); no
    document is taken more than max_epochs times. The same input gives the same mix. A null source is a source, last in
    order; a null id is dealt like any other. Repeated rows of one id share a block. Columns of the added names are replaced.
    """
    base = docs.drop(*(c for c in ("size", "source_size", "target", "takes") if c in docs.columns and c not in (id_col, text_col, source_col)))
    sized = base.withColumns({"size": n_words(text_col) if size is None else size, "__ef_source": F.col(source_col)})
    sources = source_targets(sized.groupBy("__ef_source").agg(F.sum("size").alias("source_size")), "__ef_source", weights=weights, max_epochs=max_epochs)
    per_block = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(blocks)))
    sources = pin(sources.withColumn("n_blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / per_block)).cast("long")))
    few = sources.count() <= 100_000
    small = F.broadcast if few else (lambda x: x)
    place = sources.select(F.col("__ef_source").alias("__ef_s"), F.col("place").alias("__ef_place"), "source_size", "target", F.col("n_blocks").alias("__ef_n"))
    dealt = (
        sized.join(small(place), F.col("__ef_source").eqNullSafe(F.col("__ef_s"))).drop("__ef_s", "__ef_source")
        .withColumn("__ef_block", F.pmod(hash60(F.lit(seed), id_col), F.col("__ef_n"))).drop("__ef_n")
    )

    # At most one row for each block and copy.
    block = dealt.groupBy("__ef_place", "__ef_block").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    permuted = Window.partitionBy("__ef_place").orderBy(hash60(F.lit(seed), F.lit("order"), "__ef_place", "__ef_block"), "__ef_block")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    block = block.withColumn("middle", F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("words") / 2.0)
    block = block.withColumn("copies", F.least(F.lit(max_epochs), full + F.when(F.col("middle") <= F.col("target") - full * F.col("source_size"), 1).otherwise(0)).cast("int"))
    units = pin(block.where("copies > 0").select(F.col("__ef_place").alias("place"), F.col("__ef_block").alias("block"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")))

    leaves = split_quotas(units.groupBy("place").agg(F.count(F.lit(1)).alias("q")), shards, seed)
    so_far = Window.partitionBy("place").orderBy("shard")
    edges = (
        leaves.withColumn("end", F.sum("q").over(so_far)).groupBy("place")
        .agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends"))
    )
    drawn = Window.partitionBy("place").orderBy(hash60(F.lit(seed), F.lit("draw"), "place", "block", "copy"), "block", "copy")
    shard_of = F.size(F.filter("ends", lambda e: e["end"] <= F.col("at")))
    takes = (
        units.withColumn("at", F.row_number().over(drawn) - 1).join(edges, "place").withColumn("shard", shard_of)
        .groupBy(F.col("place").alias("__ef_place"), F.col("block").alias("__ef_block"))
        .agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("takes"))
    )
    out = dealt.join(small(takes), ["__ef_place", "__ef_block"], "left")
    none = F.array().cast("array<struct<copy:int,shard:int>>")
    return out.select(*(F.col(c) for c in base.columns), "size", "source_size", "target", F.coalesce("takes", none).alias("takes"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each document as often as it is taken, with mix_shard, mix_copy and mix_order (a local shuffle key).

    Documents that are not taken are absent, null and empty texts too where their block is not; repeated rows of one id
    are taken alike, and share mix_order. Columns of the added names are replaced, other columns stay.
    """
    id_col, seed = how.get("id_col", "doc_id"), how.get("seed", 7)
    plan = plan_mix(docs.drop("mix_shard", "mix_copy", "mix_order"), **how)
    kept = [c for c in plan.columns if c not in ("size", "source_size", "target", "takes") or c in docs.columns]
    taken = plan.select(*kept, F.explode("takes").alias("__ef_take"))
    return taken.select(
        *(c for c in kept), F.col("__ef_take.shard").alias("mix_shard"), F.col("__ef_take.copy").alias("mix_copy"),
        hash60(F.lit(seed), F.lit("shuffle"), F.col("__ef_take.shard"), id_col, F.col("__ef_take.copy")).alias("mix_order"),
    )


def laid_out(mixed: DataFrame) -> DataFrame:
    """The mix by shards, each in shuffled order."""
    return mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """One folder for each shard, its documents in shuffled order. An empty mix writes no shard."""
    laid_out(mixed).write.partitionBy("mix_shard").parquet(path)
