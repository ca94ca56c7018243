"""Prefix trie of conversations, built as a z-fast trie in batches.

Every prefix of a conversation has a 16-byte chained hash. The distinct conversations (copies are counted first) enter
the trie in rounds. In each round a group of conversations - those that leave the trie at one point with one next turn -
takes up to BATCH of its members, by random order, into a z-fast trie: a dictionary from the hash at each compacted
node's two-fattest depth to the node. All others of the group find their exit node by fat binary search and form the
next round's groups, so groups shrink by a factor of about BATCH / log n a round. Large groups are dealt to many tasks, each
with its own copy of the batch's trie. Edges are expanded and summed with joins and windows once all are placed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

#: Conversations of a group that enter its trie in one round; members of a group that one task locates.
BATCH, MEMBERS = 256, 4096
WIDTH = 16


def two_fattest(low: int, high: int) -> int:
    """The number in (low, high] that the largest power of two divides."""
    return (-1 << ((low ^ high).bit_length() - 1)) & high


class ZFastTrie:
    """A compacted trie over sequences that all share their first start elements, as packed prefix hashes.

    Node i ends the edge (top[i], bottom[i]] of the sequence owner[i]. Every sequence owns the part of its path that it
    added: what lies below its exit point.
    """

    def __init__(self, start: int) -> None:
        self.start = start
        self.top: list[int] = []
        self.bottom: list[int] = []
        self.owner: list[int] = []
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}
        self.paths: list[bytes] = []
        self.ids: list[int] = []
        self.exits: list[tuple[int, int]] = []  # (owner or -1 above the trie, depth)

    @staticmethod
    def at(path: bytes, depth: int) -> bytes:
        return path[WIDTH * (depth - 1) : WIDTH * depth]

    def locate(self, path: bytes) -> tuple[int, int, int]:
        """(depth where the sequence leaves the trie, owner of that place or -1, node whose edge it leaves or -1 at a node)."""
        length, here, node = len(path) // WIDTH, self.start, -1
        while True:
            low, high, leaving = here, length, -1
            while low < high:
                f = two_fattest(low, high)
                found = self.handles.get(self.at(path, f))
                if found is None:
                    high = f - 1
                    continue
                end = self.bottom[found]
                if end <= length and self.at(path, end) == self.at(self.paths[self.owner[found]], end):
                    low = here = end
                    node = found
                else:
                    leaving = found
                    break
            if leaving < 0:  # no handle is met: perhaps the next edge is left before its handle
                leaving = self.first.get(self.at(path, here + 1), -1) if here < length else -1
                if leaving < 0:
                    return here, self.owner[node] if node >= 0 else -1, -1
            other, low, high = self.paths[self.owner[leaving]], self.top[leaving] + 1, min(self.bottom[leaving], length)
            while low < high:  # the last depth at which both paths agree; they do at the edge's first
                middle = (low + high + 1) // 2
                if self.at(path, middle) == self.at(other, middle):
                    low = middle
                else:
                    high = middle - 1
            if low < self.bottom[leaving]:
                return low, self.owner[leaving], leaving
            here, node = low, leaving

    def _place(self, node: int) -> None:
        path = self.paths[self.owner[node]]
        self.handles[self.at(path, two_fattest(self.top[node], self.bottom[node]))] = node
        self.first[self.at(path, self.top[node] + 1)] = node

    def insert(self, name: int, path: bytes) -> None:
        """Add a sequence that differs from all before."""
        depth, owner, edge = self.locate(path)
        length, number = len(path) // WIDTH, len(self.ids)
        self.ids.append(name)
        self.paths.append(path)
        self.exits.append((owner, depth))
        if edge >= 0:  # split: the old node keeps the lower part, a new one ends the upper part
            other = self.paths[self.owner[edge]]
            del self.handles[self.at(other, two_fattest(self.top[edge], self.bottom[edge]))]
            self.top.append(self.top[edge])
            self.bottom.append(depth)
            self.owner.append(self.owner[edge])
            self.top[edge] = depth
            self._place(len(self.top) - 1)
            self._place(edge)
        if depth < length:
            self.top.append(depth)
            self.bottom.append(length)
            self.owner.append(number)
            self._place(len(self.top) - 1)

    def chain(self, owner: int, depth: int) -> list[tuple[int, int]]:
        """(owner's id, depth) of the places on the way from an exit up to the trie's own start."""
        out = []
        while owner >= 0:
            out.append((self.ids[owner], depth))
            owner, depth = self.exits[owner]
        return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, keys, lens) to (id, length, whole, path, lens): each prefix's hash is that of the one before and the turn's key."""
    for batch in batches:
        wholes, paths = [], []
        for keys in batch.column(1).to_pylist():
            at, path = b"", []
            for key in keys:
                at = hashlib.blake2b(at + key, digest_size=WIDTH).digest()
                path.append(at)
            wholes.append(at)
            paths.append(b"".join(path))
        lengths = pa.array([len(p) // WIDTH for p in paths], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), lengths, pa.array(wholes, pa.binary()), pa.array(paths, pa.binary()), batch.column(2)], names=["id", "length", "whole", "path", "lens"])


CHAIN = "array<struct<owner:bigint,depth:int>>"
#: What a round gives; grp names the group in which a conversation goes on, null once it is placed.
ROUND = f"id bigint, path binary, exit int, chain {CHAIN}, grp binary"


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A round's rows (grp, block, member, id, path, exit, chain), sorted: each block's batch first, then the members to locate."""
    chains = pa.list_(pa.struct([("owner", pa.int64()), ("depth", pa.int32())]))
    at, trie, known = None, ZFastTrie(0), {}
    for batch in batches:
        cols = [c.to_pylist() for c in batch.columns]
        out: list[list] = [[], [], [], [], []]
        for grp, block, member, name, path, start, chain in zip(*cols, strict=True):
            if (grp, block) != at:
                at, trie, known = (grp, block), ZFastTrie(start), {}
            if not member:
                known[name] = len(trie.ids)
                trie.insert(name, path)
                continue
            mine = known.get(name)
            if mine is not None:
                owner, depth = trie.exits[mine]
                grp_next = None
            else:
                depth, owner, _ = trie.locate(path)
                grp_next = ZFastTrie.at(path, depth + 1) if depth < len(path) // WIDTH else None
            places = [{"owner": o, "depth": d} for o, d in trie.chain(owner, depth)]
            for column, value in zip(out, (name, path, depth, places + chain, grp_next), strict=True):
                column.append(value)
        if out[0]:
            kinds = (pa.int64(), pa.binary(), pa.int32(), chains, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["id", "path", "exit", "chain", "grp"])


def _placed(distinct: DataFrame) -> DataFrame:
    """(id, exit, chain) of every distinct conversation (id, path); chain holds the places above it, nearest first, the root last."""
    state = distinct.select("id", "path", F.lit(0).alias("exit"), F.expr(f"CAST(array(named_struct('owner', NULL, 'depth', 0)) AS {CHAIN})").alias("chain"), F.substring("path", 1, 0).alias("grp"))
    done = []
    while True:
        order = F.xxhash64("id")
        nth = Window.partitionBy("grp").orderBy(order, "id")
        large = state.groupBy("grp").count().where(F.col("count") > MEMBERS).select(F.col("grp").alias("big"), F.ceil(F.col("count") / MEMBERS).cast("int").alias("blocks"))
        blocks = F.coalesce("blocks", F.lit(1))
        batch = state.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= BATCH).join(large, F.col("grp") == F.col("big"), "left")
        batch = batch.select("grp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(False).alias("member"), order.alias("order"), "id", "path", "exit", "chain")
        members = state.join(large, F.col("grp") == F.col("big"), "left")
        members = members.select("grp", F.pmod(order, blocks).cast("int").alias("block"), F.lit(True).alias("member"), order.alias("order"), "id", "path", "exit", "chain")
        dealt = batch.unionByName(members).repartition("grp", "block").sortWithinPartitions("grp", "block", "member", "order", "id").drop("order")
        after = stash(dealt.mapInArrow(_located, ROUND))
        done.append(after.where("grp IS NULL").select("id", "exit", "chain"))
        state = after.where("grp IS NOT NULL")
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (whole, run, ids), sorted, to (whole, sha256 of all ids of a whole, joined by commas); runs stream through."""
    at, digest = None, None
    for batch in batches:
        wholes, digests = [], []
        for whole, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if whole != at or digest is None:
                if digest is not None:
                    wholes.append(at)
                    digests.append(digest.hexdigest())
                at, digest = whole, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(wholes, pa.binary()), pa.array(digests, pa.string())], names=["whole", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["whole", "ends"])


def _ends(convs: DataFrame) -> DataFrame:
    """(whole, ends): the digest of the ascending ids of the conversations with one whole hash.

    SHA-256 runs through a node's list in order, so it cannot be split: ids are dealt by range and joined to strings first, one
    for each range and node, and only these strings stream through the task of their node, none held longer than it is hashed.
    """
    part = stash(convs.select("whole", "id").repartitionByRange("whole", "id").withColumn("run", F.spark_partition_id()))
    numbered = part.withColumn("piece", (F.row_number().over(Window.partitionBy("whole", "run").orderBy("id")) / MEMBERS).cast("long"))
    texts = numbered.groupBy("whole", "run", "piece").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    runs = texts.select("whole", F.struct("run", "piece").alias("run"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    sorted_ = runs.repartition("whole").sortWithinPartitions("whole", "run").select("whole", F.lit(0).alias("run"), "ids")
    return sorted_.mapInArrow(_joined_ids, "whole binary, ends string")


def build_trie(convs: DataFrame) -> DataFrame:
    """One row for each prefix of the conversations (id, turns array<struct<key binary, len int>>): see prefix_trie."""
    keyed = convs.select("id", F.transform("turns", lambda t: t["key"]).alias("keys"), F.transform("turns", lambda t: t["len"]).alias("lens"))
    hashed = stash(keyed.mapInArrow(_hashed, "id bigint, length int, whole binary, path binary, lens array<int>"))
    copies = hashed.groupBy("whole").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).join(_ends(hashed), "whole")
    distinct = stash(hashed.drop("whole").join(copies.drop("whole"), "id"))
    placed = stash(_placed(distinct).join(distinct.select("id", "length", "lens", "copies", "ends"), "id"))
    own = F.col("length") > F.col("exit")
    mine = F.struct(F.col("id").alias("owner"), F.col("length").alias("depth"))
    way = F.when(own, F.concat(F.array(mine), "chain")).otherwise(F.col("chain"))

    # First what each conversation brings to the places on its way up: itself, its copies, and at its exit a child.
    steps = placed.select("id", "copies", "ends", own.alias("own"), F.posexplode(way).alias("i", "place"))
    marks = steps.groupBy("place.owner", "place.depth").agg(
        F.sum("copies").alias("copies"), F.min("id").alias("least"), F.sum((F.col("own") & (F.col("i") == 1)).cast("long")).alias("hung"),
        F.max(F.when(F.col("i") == 0, F.col("ends"))).alias("ends"),
    )
    nodes = placed.where(own).select("id", F.posexplode("lens").alias("before", "len"), "exit").where("before >= exit").select(F.col("id").alias("owner"), (F.col("before") + 1).alias("depth"), F.col("len").cast("long").alias("len"))
    both = nodes.unionByName(marks, allowMissingColumns=True).repartition("owner").groupBy("owner", "depth").agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("copies"), F.min("least").alias("least"), F.coalesce(F.sum("hung"), F.lit(0)).alias("hung"), F.max("ends").alias("ends"), F.coalesce(F.max("len"), F.lit(0)).alias("len"),
    )
    below = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("owner").orderBy("depth")
    edge = both.withColumns({"n_convs": F.sum("copies").over(below), "conv_id": F.min("least").over(below), "under": F.lead(F.lit(1), 1).over(down)})
    edge = edge.withColumns({
        "saved": F.sum((F.col("n_convs") - 1) * F.col("len")).over(below), "n_children": F.col("hung") + F.coalesce("under", F.lit(0)), "parent": F.lag("conv_id").over(down),
    })
    edge = stash(edge.select("owner", "depth", "conv_id", "n_convs", "n_children", "saved", "ends", "parent"))

    # Then what hangs below: whole edges with their leaves and savings, for every place above them; and the parent across an exit.
    totals = edge.where("owner IS NOT NULL").groupBy(F.col("owner").alias("id")).agg(F.max("saved").alias("saved"), (F.min("n_children") == 0).cast("long").alias("leaf"))
    hanging = placed.where(own).join(totals, "id")
    sums = hanging.select(F.posexplode(way).alias("i", "place"), "saved", "leaf").groupBy("place.owner", "place.depth").agg(
        F.sum(F.when(F.col("i") > 0, F.col("saved"))).alias("hung_saved"), F.sum("leaf").alias("leaves"))
    exits = placed.where(own).select("id", (F.col("exit") + 1).alias("first"), F.col("chain")[0]["owner"].alias("up"), F.col("exit"))
    parents = exits.join(edge.select("owner", "depth", "conv_id"), F.col("up").eqNullSafe(F.col("owner")) & (F.col("exit") == F.col("depth")))
    parents = parents.select(F.col("id").alias("owner"), F.col("first").alias("depth"), F.col("conv_id").alias("across"))
    full = edge.unionByName(sums, allowMissingColumns=True).unionByName(parents, allowMissingColumns=True).repartition("owner").groupBy("owner", "depth").agg(
        *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "n_children", "saved", "ends", "parent", "hung_saved", "leaves", "across")))
    return full.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("across", "parent").alias("parent_conv_id"), "n_convs", "n_children", F.sum(F.coalesce("leaves", F.lit(0))).over(below).alias("n_leaves"),
        (F.col("saved") + F.sum(F.coalesce("hung_saved", F.lit(0))).over(below)).alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


def turns_of(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn", key_cols: tuple[str, ...] = ("role", "text"), text_col: str = "text") -> DataFrame:
    """(id, turns array<struct<order, key, len>>) of every conversation, turns in order: nulls first, equal places by key.

    key is 16 bytes that stand for key_cols (null counts as empty), len the code points of text_col. Rows with a null id belong
    to no conversation and are left out. A conversation is one row: 16 bytes and two numbers a turn, no text.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]
    whole = F.concat(*(x for p in parts[:-1] for x in (F.octet_length(p).cast("string"), F.lit(":"), p)), parts[-1])
    turn = F.struct(F.col(order_col).alias("order"), F.unhex(F.md5(whole.cast("binary"))).alias("key"), F.coalesce(F.char_length(text_col), F.lit(0)).alias("len"))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), turn.alias("turn"))
    return rows.groupBy("id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def prefix_trie(df: DataFrame, id_col: str = "conv_id", order_col: str = "turn", key_cols: tuple[str, ...] = ("role", "text"), text_col: str = "text") -> DataFrame:
    """The trie of all conversations' prefixes: one row a node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conv_id is the smallest conversation that starts with the node's prefix of depth turns; the root has depth 0 and no
    parent. n_leaves and saved_tokens (what sharing a node's last text among n_convs conversations saves, in code points)
    sum over the subtree. ends_sha256 is the digest of the ascending ids that end here, joined by commas. Repeated turns and
    repeated conversations are kept and counted; an empty table has no trie, not even a root; see turns_of for nulls and ties.
    """
    return build_trie(turns_of(df, id_col, order_col, key_cols, text_col))
