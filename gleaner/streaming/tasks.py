"""Task events: clamped progress, a ring of logs, failure of tasks that fall silent, and an archive some time after the end.

`Task` is what one task's events do, in event time: what became due before an event is put out first, so that results don't
depend on how events are cut into batches. `stream` keeps it as state, a value and a list, with one event-time timer for
what comes due next; `replay` runs a batch, sorted, without gathering a task's events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds of silence after which a running task counts as dead, and from its end to the archive; logs kept.
SILENCE, ARCHIVE, RING = 90, 300, 1000
STATE = "status string, progress double, last long, ended long, logs long, dead boolean"
OUTPUT = "task string, kind string, at long, status string, progress double, logs long, ring array<string>"
SECOND = 1_000_000


class Task:
    """A task's state. Events are created, started, progress (value: 0 to 1), log (message), completed and failed."""

    def __init__(self, silence: float = SILENCE, archive: float = ARCHIVE, ring: int = RING):
        self.silence, self.archive, self.keep = int(silence * SECOND), int(archive * SECOND), ring
        self.reset()

    def reset(self) -> None:
        self.status, self.progress, self.last, self.ended, self.logs, self.dead, self.ring = None, 0.0, None, None, 0, False, []

    def due(self) -> int | None:
        """The last microsecond before something happens without an event, or None."""
        if self.ended is not None:
            return self.ended + self.archive
        return None if self.status is None or self.dead else self.last + self.silence

    def said(self, kind: str, at: int) -> tuple:
        return kind, at, self.status, self.progress, self.logs, list(self.ring) if kind == "archived" else None

    def until(self, at: int) -> Iterator[tuple]:
        """What becomes due before `at`."""
        if self.ended is None and (due := self.due()) is not None and due < at:
            self.status, self.dead = "failed", True
            yield self.said("dead", due)
        if self.ended is not None and (due := self.due()) < at:
            yield self.said("archived", due)
            self.reset()

    def step(self, at: int, event: str, value: float | None, message: str | None) -> Iterator[tuple]:
        yield from self.until(at)
        self.last, self.dead = at if self.last is None else max(self.last, at), False
        if event == "log":
            self.logs += 1
            self.ring = [*self.ring, message or ""][-self.keep :]
            if self.status in (None, "failed") and self.ended is None:
                self.status = "running"
            return
        if event == "progress":
            self.progress = max(0.0, min(1.0, value if value is not None and value == value else 0.0))
        if self.ended is None:
            self.status = {"created": "pending", "completed": "completed", "failed": "failed"}.get(event, "running")
            if event in ("completed", "failed"):
                self.ended = at
                self.progress = 1.0 if event == "completed" else self.progress
        yield self.said("update", at)


def rows_of(events: DataFrame) -> DataFrame:
    """task, at (microseconds), seq, event, value and message from events with ts in place of at; rows without task or time
    are no events."""
    return events.select(F.col("task").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("ts"), "seq", "event", F.col("value").cast("double").alias("value"), "message").where("task is not null and ts is not null")


def replay(events: DataFrame, silence: float = SILENCE, archive: float = ARCHIVE, ring: int = RING, until: int | None = None) -> DataFrame:
    """All rows (OUTPUT) that events give; at the end what is due before `until` (microseconds; all there is without it)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, task, out = None, Task(silence, archive, ring), []
        rest = float("inf") if until is None else until

        def close() -> None:
            for _ in range(2):  # dead, then nothing more; or archived
                out.extend((now, *x) for x in task.until(rest))

        for b in batches:
            for key, at, event, value, message in zip(b["task"], b["at"].tolist(), b["event"], b["value"].tolist(), b["message"], strict=True):
                if key != now:
                    close()
                    now, task = key, Task(silence, archive, ring)
                out.extend((key, *x) for x in task.step(at, event, value, message))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    rows = rows_of(events).select("task", F.unix_micros("ts").alias("at"), "seq", "event", "value", "message")
    return rows.repartition("task").sortWithinPartitions("task", "at", "seq").mapInPandas(run, OUTPUT)


class TaskProcessor(StatefulProcessor):
    def __init__(self, *options):
        self.options = options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value, self.ring = handle, handle.getValueState("task", STATE), handle.getListState("ring", "message string")

    def load(self) -> Task:
        task = Task(*self.options)
        if self.value.exists():
            task.status, task.progress, task.last, task.ended, task.logs, task.dead = self.value.get()
            task.ring = [x[0] for x in self.ring.get()]
        return task

    def save(self, task: Task, was: int | None, kept: list[str]) -> None:
        if task.status is None and task.last is None:
            self.value.clear()
            self.ring.clear()
        else:
            self.value.update((task.status, task.progress, task.last, task.ended, task.logs, task.dead))
            if task.ring and task.ring != kept:
                self.ring.put([(x,) for x in task.ring])
            elif not task.ring:
                self.ring.clear()
        if (due := task.due()) != was:
            if was is not None:
                self.handle.deleteTimer(was // 1000 + 1)
            if due is not None:
                self.handle.registerTimer(due // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        task = self.load()
        was, kept = task.due(), task.ring
        for r in sorted(rows, key=lambda r: (r["at"], r["seq"])):
            for x in task.step(r["at"], r["event"], r["value"], r["message"]):
                yield self.row(key, x)
        self.save(task, was, kept)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        task = self.load()
        was, kept = task.due(), task.ring
        if was is not None and was // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs():
            for x in task.until(was + 1):
                yield self.row(key, x)
            self.save(task, None, kept)  # its timer has gone

    def row(self, key, x: tuple) -> Row:
        return Row(task=key[0], kind=x[0], at=x[1], status=x[2], progress=x[3], logs=x[4], ring=x[5])

    def close(self) -> None:
        pass


def stream(events: DataFrame, silence: float = SILENCE, archive: float = ARCHIVE, ring: int = RING, late: str = "10 minutes") -> DataFrame:
    """The same rows over a stream, `dead` and `archived` as its watermark passes them; later events than it are dropped. The
    state store provider must be RocksDB's."""
    rows = rows_of(events).withWatermark("ts", late).select("task", "ts", F.unix_micros("ts").alias("at"), "seq", "event", "value", "message")
    return rows.groupBy("task").transformWithState(statefulProcessor=TaskProcessor(silence, archive, ring), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
