"""The last n events of each key, kept by a stream in bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and maps need; set on the session before a stream starts.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SNAPSHOT = "key string, salt int, until timestamp, timestamp timestamp, request_id string"


class _LastN(StatefulProcessor):
    """State of a key: for each open interval its last n events, and the last n of all closed ones."""

    def __init__(self, n: int, every_us: int) -> None:
        self.n, self.every_us = n, every_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "until bigint", "stamps array<bigint>, ids array<string>")
        self.closed = handle.getValueState("closed", "stamps array<bigint>, ids array<string>")

    def _last(self, old: tuple | None, new: list[tuple[int, str]]) -> tuple[list[int], list[str]]:
        both = sorted([*zip(old[0], old[1], strict=True), *new] if old else new)[-self.n :]
        return [s for s, _ in both], [i for _, i in both]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[int, list[tuple[int, str]]] = {}
        for batch in rows:
            for stamp, name in zip(batch["stamp"].tolist(), batch["request_id"].tolist(), strict=True):
                new.setdefault(stamp - stamp % self.every_us + self.every_us, []).append((stamp, name))
            new = {until: sorted(events)[-self.n :] for until, events in new.items()}
        for until, events in new.items():
            known = self.open.getValue((until,)) if self.open.containsKey((until,)) else None
            if known is None:
                self.handle.registerTimer(-(-until // 1000))
            self.open.updateValue((until,), self._last(known, events))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        if not self.open.containsKey((until,)):
            return
        stamps, names = self.open.getValue((until,))
        kept = self._last(self.closed.get() if self.closed.exists() else None, list(zip(stamps, names, strict=True)))
        self.closed.update(kept)
        self.open.removeKey((until,))
        moments = [pd.to_datetime(x, unit="us", utc=True) for x in (until, kept[0])]
        yield pd.DataFrame({"key": key[0], "salt": key[1], "until": moments[0], "timestamp": moments[1], "request_id": kept[1]})

    def close(self) -> None:
        pass


def retained(events: DataFrame, n: int, key: str = "model_selected", every_seconds: int = 3600, late: str = "10 minutes", salts: int = 1) -> DataFrame:
    """A stream of snapshots (key, salt, until, timestamp, request_id): the last n events of each key before the end of each interval.

    A snapshot follows once the watermark passes the interval's end (a timer in event time), in append mode, for intervals in
    which the key had events; events later than late are dropped. The state of a key is n events for each open
    interval and n for all closed ones, whatever the length of the stream. salts spreads a key over that many states and
    tasks, each with its own last n; last_of picks the key's own from their snapshots. Null keys are a key; events without a
    timestamp or request_id belong to no interval and are left out.
    """
    spark = events.sparkSession
    spark.conf.set(*PROVIDER)
    rows = events.where("timestamp IS NOT NULL AND request_id IS NOT NULL").select(
        F.col(key).cast("string").alias("key"), F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int").alias("salt"), "timestamp", F.unix_micros("timestamp").alias("stamp"), "request_id")
    keyed = rows.withWatermark("timestamp", late).groupBy("key", "salt")
    return keyed.transformWithStateInPandas(_LastN(n, every_seconds * 1_000_000), SNAPSHOT, "Append", "EventTime")


def last_of(snapshots: DataFrame, n: int) -> DataFrame:
    """(key, until, rank, timestamp, request_id) from snapshots of all salts: each at most n rows, so an interval is at most n * salts.

    An interval in which a salt had no event has no snapshot of that salt; its last one before stands in.
    """
    ends = snapshots.select("key", "until").distinct()
    mine = snapshots.withColumnsRenamed({"until": "since"})
    spans = snapshots.select("key", "salt", F.col("until").alias("since")).distinct().withColumn("next", F.lead("since").over(Window.partitionBy("key", "salt").orderBy("since")))
    valid = ends.alias("e").join(spans.alias("s"), F.expr("e.key <=> s.key AND s.since <= e.until AND (s.next IS NULL OR e.until < s.next)")).select("e.key", "s.salt", "s.since", "e.until")
    rows = valid.alias("v").join(mine.alias("m"), F.expr("v.key <=> m.key AND v.salt = m.salt AND v.since = m.since")).select("v.key", "v.until", "m.timestamp", "m.request_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key", "until").orderBy(F.desc("timestamp"), F.desc("request_id"))))
    return ranked.where(F.col("rank") <= n).select("key", "until", "rank", "timestamp", "request_id")
