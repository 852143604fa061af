"""State machines over a key's events in time order: token bucket, circuit breaker and autothrottle.

Each is a class with step(ts, row) -> output. A batch replays a key's events by sorted streaming over partitions, so that a
key's events are never gathered; a stream keeps the class's state per key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TokenBucket:
    """Allows an event where a token is left; tokens refill with time up to a burst."""

    output = "allowed boolean, tokens double"

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst, self.tokens, self.at = rate, burst, burst, None

    def step(self, ts: float, value: float) -> dict[str, Any]:
        if self.at is not None:
            self.tokens = min(self.burst, self.tokens + max(0.0, ts - self.at) * self.rate)
        self.at = ts
        allowed = self.tokens >= 1
        self.tokens -= allowed
        return {"allowed": allowed, "tokens": round(self.tokens, 6)}


class CircuitBreaker:
    """Opens after so many failures in a row, lets one try through after a time, and closes when it succeeds."""

    output = "allowed boolean, state string"

    def __init__(self, threshold: int, timeout: float, limit: float):
        self.threshold, self.timeout, self.limit = threshold, timeout, limit
        self.state, self.failures, self.opened = "closed", 0, 0.0

    def step(self, ts: float, value: float) -> dict[str, Any]:
        if self.state == "open":
            if ts - self.opened < self.timeout:
                return {"allowed": False, "state": "open"}
            self.state = "half_open"
        if value < self.limit:
            self.state, self.failures = "closed", 0
        else:
            self.failures += 1
            if self.state == "half_open" or self.failures >= self.threshold:
                self.state, self.opened = "open", ts
        return {"allowed": True, "state": self.state}


class Autothrottle:
    """Delay that grows by half on slow answers and shrinks by a tenth on fast ones."""

    output = "delay double"

    def __init__(self, start: float, low: float, high: float, slow: float):
        self.delay, self.low, self.high, self.slow = start, low, high, slow

    def step(self, ts: float, value: float) -> dict[str, Any]:
        self.delay = min(self.high, self.delay * 1.5) if value >= self.slow else max(self.low, self.delay * 0.9)
        return {"delay": self.delay}


MACHINES = {"bucket": (TokenBucket, (1 / 3600, 5.0)), "breaker": (CircuitBreaker, (3, 6 * 3600.0, 70.0)), "throttle": (Autothrottle, (1.0, 0.1, 60.0, 80.0))}


def replay(events: DataFrame, kind: str, key: str = "user_id", options: tuple | None = None) -> DataFrame:
    """event_id and the machine's output for every event; partitions hold whole keys, rows come sorted."""
    make, given = MACHINES[kind]
    args = options or given
    names = [f.split()[0] for f in make.output.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, machine = None, None
        for b in batches:
            out = []
            for k, none, ts, value in zip(b["k"].tolist(), b["none"].tolist(), b["t"].tolist(), b["value"].tolist(), strict=True):
                own = None if none else k  # a null key is one key, though pandas' never equals itself
                if machine is None or own != at:
                    at, machine = own, make(*args)
                out.append(machine.step(ts, value))
            yield pd.DataFrame({"event_id": b["event_id"]} | {n: [o[n] for o in out] for n in names})

    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    rows = events.select("event_id", F.col(key).alias("k"), F.col(key).isNull().alias("none"), t, "value").repartition("k").sortWithinPartitions("k", "t", "event_id")
    return rows.mapInPandas(run, f"event_id long, {make.output}")


def stream(events: DataFrame, kind: str, key: str = "user_id", options: tuple | None = None) -> DataFrame:
    """The same machine over a stream; state is the machine's fields as JSON."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    make, given = MACHINES[kind]
    args = options or given
    names = [f.split()[0] for f in make.output.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = make(*args)
        if state.exists:
            machine.__dict__.update(json.loads(state.get[0]))
        rows = pd.concat(list(frames)).sort_values(["t", "event_id"])
        out = [machine.step(t, v) for t, v in zip(rows["t"].tolist(), rows["value"].tolist(), strict=True)]
        state.update((json.dumps(machine.__dict__),))
        yield pd.DataFrame({"event_id": rows["event_id"].tolist()} | {n: [o[n] for o in out] for n in names})

    t = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")
    rows = events.select("event_id", F.col(key).alias("k"), t, "value")
    return rows.groupBy("k").applyInPandasWithState(run, f"event_id long, {make.output}", "state string", "append", GroupStateTimeout.NoTimeout)
