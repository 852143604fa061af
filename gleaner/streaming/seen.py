"""A store of what has been seen: first arrivals, hits and expiry after a time to live, over a stream.

An entry lives for the time to live from its first arrival; each arrival of the key meanwhile is a hit. An arrival after that
closes the entry and opens another, and a timer closes what nothing comes for. `operators.seen.entries` says the same of a
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "key string, kind string, created long, last_seen long, hits long"


class SeenStore(StatefulProcessor):
    """Rows (key, at: microseconds) to `first` rows as they come and `expired` rows as entries end."""

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created long, last_seen long, hits long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.entry.get() if self.entry.exists() else None
        was, now = held, list(held) if held else None
        for at in sorted(r["at"] for r in rows):
            if now and at > now[0] + self.ttl:
                yield self.said(key, "expired", now)
                now = None
            if now:
                now[1], now[2] = max(now[1], at), now[2] + 1
            else:
                now = [at, at, 1]
                yield self.said(key, "first", now)
        if not was or was[0] != now[0]:
            if was:
                self.handle.deleteTimer(self.due(was[0]))
            self.handle.registerTimer(self.due(now[0]))
        self.entry.update(tuple(now))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists():
            held = self.entry.get()
            if self.due(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield self.said(key, "expired", held)

    def due(self, created: int) -> int:
        """The first whole millisecond at which an entry is over."""
        return (created + self.ttl) // 1000 + 1

    def said(self, key, kind: str, entry) -> Row:
        return Row(key=key[0], kind=kind, created=entry[0], last_seen=entry[1], hits=entry[2])

    def close(self) -> None:
        pass


def stream(events: DataFrame, key: str, ts: str, ttl_seconds: float, late: str = "10 minutes") -> DataFrame:
    """first and expired rows of a stream's keys; the state store provider must be RocksDB's."""
    timed = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", late)
    rows = timed.select("key", "ts", F.unix_micros("ts").alias("at")).groupBy("key")
    return rows.transformWithState(statefulProcessor=SeenStore(ttl_seconds), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
