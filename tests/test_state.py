"""Seen-store and task events: streams against batches, expiry, timers, late rows, restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleaner.operators import seen
from gleaner.streaming import folds, tasks, windows
from gleaner.streaming import seen as seen_stream

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key)


def streamed(spark, df, path, files=4):
    """df as a stream of files in order of time, one a batch; a source takes files by the time they were written."""
    cuts = df.select(F.unix_micros("ts").cast("double").alias("t")).approxQuantile("t", [k / files for k in range(1, files)], 0.0)
    held = df.withColumn("__part", sum((F.unix_micros("ts") > c).cast("int") for c in cuts))
    for k in range(files):
        held.where(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_entries(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [("a", at(0)), ("a", at(10)), ("a", at(10)), ("a", at(11)), ("b", at(100)), (None, at(1)), (None, at(1)), ("a", None), ("c", at(90))]
    got = {(r["key"], r["created"], r["last_seen"], r["hits"], r["expired"]) for r in seen.entries(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 600).collect()}
    assert got == {("a", at(0), at(10), 3, True), ("a", at(11), at(11), 1, True), ("b", at(100), at(100), 1, False), (None, at(1), at(1), 2, True), ("c", at(90), at(90), 1, False)}
    assert seen.entries(spark.createDataFrame([], "k string, ts timestamp"), "k", "ts", 600).count() == 0


def test_seen_stream_agrees_with_batch(spark, rocks, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    got = windows.replayed(events, seen_stream.stream(streamed(spark, events, f"{tmp_path}/e"), "user_id", "ts", 3 * 86400), "seen_rows").collect()
    want = [(str(r["user_id"]), r["created"], r["last_seen"], r["hits"], r["closed"]) for r in seen.entries(events, "user_id", "ts", 3 * 86400).select("key", *[F.unix_micros(c).alias(c) for c in ("created", "last_seen")], "hits", "expired").withColumnsRenamed({"key": "user_id", "expired": "closed"}).collect()]
    assert {(r["key"], r["created"]) for r in got if r["kind"] == "first"} == {w[:2] for w in want}
    late = events.agg(F.max(F.unix_micros("ts"))).first()[0] - 600 * 1_000_000  # the watermark at the end
    over = {w[:4] for w in want if w[1] + 3 * 86400 * 1_000_000 < late - 1000}
    expired = {(r["key"], r["created"], r["last_seen"], r["hits"]) for r in got if r["kind"] == "expired"}
    assert over <= expired <= {w[:4] for w in want} and len(over) > 20
    assert all(w[4] for w in want if w[:4] in expired)


def test_seen_stream_goes_on_from_its_checkpoint(spark, rocks, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    source = f"{tmp_path}/in"
    out = f"{tmp_path}/out"

    def run(rows):
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema("k string, ts timestamp").parquet(source)
        q = seen_stream.stream(s, "k", "ts", 3600, "1 minute").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["key"], r["kind"], r["hits"]) for r in spark.read.parquet(out).collect())

    assert run([("a", at(0)), ("b", at(1))]) == [("a", "first", 1), ("b", "first", 1)]
    assert run([("a", at(30))]) == [("a", "first", 1), ("b", "first", 1)]
    # the last row is later than the watermark allows and drops; the entries of a and b end
    assert run([("c", at(200))]) == [("a", "expired", 2), ("a", "first", 1), ("b", "expired", 1), ("b", "first", 1), ("c", "first", 1)]
    assert run([("a", at(2))]) == [("a", "expired", 2), ("a", "first", 1), ("b", "expired", 1), ("b", "first", 1), ("c", "first", 1)]


def test_sketch_and_look_up(spark):
    old = spark.range(0, 3000, 3).select(F.concat(F.lit("k"), "id").alias("k")).union(spark.sql("select cast(null as string)"))
    new = spark.range(0, 3000).select("id", F.concat(F.lit("k"), "id").alias("k")).union(spark.sql("select -1L, cast(null as string)"))
    halves = seen.merged(seen.sketch(old.where("k < 'k2'"), "k"), seen.sketch(old.where("k >= 'k2'"), "k"))
    assert sorted(map(tuple, halves.collect())) == sorted(map(tuple, seen.sketch(old, "k").collect()))
    maybe = {r["id"]: r["m"] for r in new.where("id >= 0").select("id", seen.maybe(F.col("k"), halves).alias("m")).collect()}
    assert all(m for i, m in maybe.items() if i % 3 == 0) and sum(m for i, m in maybe.items() if i % 3) < 20
    got = {r["id"]: r["seen"] for r in seen.looked_up(new, "k", old, "k", halves).collect()}
    assert got == {i: i % 3 == 0 for i in range(3000)} | {-1: False}
    assert {r["seen"] for r in seen.looked_up(new, "k", old.limit(0), "k").collect()} == {False}


KINDS = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'progress' WHEN 'click' THEN 'log' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"


def task_events(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    return e.select(F.col("user_id").alias("task"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.expr(KINDS).alias("event"), (F.col("value") / 40 - 0.3).alias("value"), F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"))


def test_task_stream_agrees_with_batch(spark, rocks, tmp_path):
    events = task_events(spark)
    options = {"silence": 6 * 3600, "archive": 3600, "ring": 2}
    plain = lambda rows: {(r["task"], r["kind"], r["at"], r["status"], round(r["progress"], 9), r["logs"], tuple(r["ring"] or ())) for r in rows}
    last = events.agg(F.max(F.unix_micros("ts"))).first()[0]
    batch = plain(tasks.replay(events, **options, until=last - 600 * 1_000_000).collect())
    stream = plain(windows.replayed(events, tasks.stream(streamed(spark, events, f"{tmp_path}/t", 5), **options), "task_rows").collect())
    assert {x[1] for x in batch} == {"update", "dead", "archived"}
    assert {x for x in stream if x[1] == "update"} == {x for x in batch if x[1] == "update"}
    # timers round up to the next millisecond of the watermark
    assert stream <= batch and all(x[2] > last - 601 * 1_000_000 for x in batch - stream)
    assert {x[4] for x in batch} >= {0.0, 1.0} and all(0 <= x[4] <= 1 for x in batch)


def test_rows_later_than_the_watermark_change_nothing(spark, rocks, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(0, ("t", at(0), 1, "started", None, None)), (1, ("t", at(1), 2, "completed", None, None)), (2, ("u", at(60), 3, "log", None, "x")), (3, ("t", at(0), 4, "failed", None, None)), (4, ("u", at(55), 5, "progress", 7.0, None))]
    schema = "task string, ts timestamp, seq long, event string, value double, message string"
    for k, row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/s/part={k}")
    s = spark.readStream.schema(f"{schema}, part int").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/s").drop("part")
    got = sorted((r["task"], r["kind"], r["status"], r["progress"]) for r in windows.replayed(spark.range(1), tasks.stream(s), "late_rows").collect())
    assert ("t", "archived", "completed", 1.0) in got and ("t", "update", "failed", 0.0) not in got
    assert ("u", "update", "running", 1.0) in got  # late, but not later than the watermark


def test_task_rules(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = [("t", at(0), 1, "created", None, None), ("t", at(10), 2, "progress", -3.0, None), ("t", at(20), 3, "progress", float("nan"), None), *[("t", at(20), 4 + k, "log", None, f"l{k}") for k in range(5)], ("t", at(200), 20, "log", None, None), ("t", at(210), 21, "failed", None, None), ("t", at(600), 22, "started", None, None), (None, at(0), 1, "log", None, None), ("t", None, 1, "log", None, None)]
    got = [(r["kind"], r["status"], r["progress"], r["logs"], r["ring"]) for r in tasks.replay(spark.createDataFrame(e, "task string, ts timestamp, seq long, event string, value double, message string"), ring=3).orderBy("at").collect()]
    assert got == [("update", "pending", 0.0, 0, None), ("update", "running", 0.0, 0, None), ("update", "running", 0.0, 0, None), ("dead", "failed", 0.0, 5, None), ("update", "failed", 0.0, 6, None), ("archived", "failed", 0.0, 6, ["l3", "l4", ""]), ("update", "running", 0.0, 0, None), ("dead", "failed", 0.0, 0, None)]
    assert tasks.replay(task_events(spark).limit(0)).count() == 0


def test_events_of_a_null_user_share_one_bucket(spark):
    rows = [(k, dt.datetime(2024, 1, 1, 0, 0, k), None, 1.0) for k in range(8)] + [(10 + k, dt.datetime(2024, 1, 1, 0, 0, k), 1, 1.0) for k in range(8)]
    got = {r["event_id"]: r["allowed"] for r in folds.replay(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, value double"), "bucket").collect()}
    assert [got[k] for k in range(8)] == [got[10 + k] for k in range(8)] == [True] * 5 + [False] * 3
