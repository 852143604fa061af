"""Queries of the stateful operators, replayed over a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import seen
from ..sources.tables import table
from ..streaming import folds, tasks, windows

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


ORDERED = """o AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"""


@query(f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT event_id, user_id, t, i, true AS allowed, 4.0::DOUBLE AS tokens FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.t, o.i, least(5.0, r.tokens + greatest(0.0, o.t - r.t) / 3600) >= 1,
    least(5.0, r.tokens + greatest(0.0, o.t - r.t) / 3600) - CASE WHEN least(5.0, r.tokens + greatest(0.0, o.t - r.t) / 3600) >= 1 THEN 1 ELSE 0 END
  FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, allowed FROM r
""")
def token_bucket_replay(spark, d):
    return folds.replay(table(spark, d, "events"), "bucket").select("event_id", "allowed")


@query(f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT event_id, user_id, i, CASE WHEN value >= 80 THEN least(60.0, 1.5) ELSE greatest(0.1, 0.9) END::DOUBLE AS delay FROM o WHERE i = 1
  UNION ALL SELECT o.event_id, o.user_id, o.i, CASE WHEN o.value >= 80 THEN least(60.0, r.delay * 1.5) ELSE greatest(0.1, r.delay * 0.9) END FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1)
SELECT event_id, round(delay, 4) AS delay FROM r
""")
def autothrottle_replay(spark, d):
    return folds.replay(table(spark, d, "events"), "throttle").select("event_id", F.round("delay", 4).alias("delay"))


@query(f"""
WITH RECURSIVE {ORDERED}, r AS (
  SELECT event_id, user_id, i, true AS allowed, 'closed' AS state, CASE WHEN value < 70 THEN 0 ELSE 1 END AS failures, 0.0::DOUBLE AS opened FROM o WHERE i = 1
  UNION ALL SELECT event_id, user_id, i, NOT shut,
    CASE WHEN shut THEN 'open' WHEN value < 70 THEN 'closed' WHEN was = 'open' OR failures + 1 >= 3 THEN 'open' ELSE 'closed' END,
    CASE WHEN shut THEN failures WHEN value < 70 THEN 0 ELSE failures + 1 END,
    CASE WHEN NOT shut AND value >= 70 AND (was = 'open' OR failures + 1 >= 3) THEN t ELSE opened END
  FROM (SELECT o.event_id, o.user_id, o.i, o.t, o.value, r.state AS was, r.failures, r.opened, r.state = 'open' AND o.t - r.opened < 21600 AS shut FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, allowed, state FROM r
""")
def breaker_replay(spark, d):
    return folds.replay(table(spark, d, "events"), "breaker")


@query("""
SELECT time_bucket(INTERVAL '30 seconds', ts) - k * INTERVAL '30 seconds' AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events CROSS JOIN range(10) r(k) GROUP BY 1, 2
""")
def sliding_rates(spark, d):
    return windows.rates(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def heartbeat_sessions(spark, d):
    s = windows.sessions(table(spark, d, "events"), "1 hour")
    return s.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


#: Each user's entries live four days.
ALIVE = 4 * 86400


@query(f"""
WITH RECURSIVE r AS (
  SELECT user_id, min(ts) AS created FROM events GROUP BY user_id
  UNION ALL
  SELECT r.user_id, min(e.ts) FROM r JOIN events e ON e.user_id = r.user_id AND e.ts > r.created + INTERVAL {ALIVE} SECOND GROUP BY r.user_id, r.created
)
SELECT r.user_id, r.created, max(e.ts) AS last_seen, count(*) AS hits, r.created + INTERVAL {ALIVE} SECOND < (SELECT max(ts) FROM events) AS expired
FROM r JOIN events e ON e.user_id = r.user_id AND e.ts BETWEEN r.created AND r.created + INTERVAL {ALIVE} SECOND GROUP BY r.user_id, r.created
""")
def seen_entries(spark, d):
    got = seen.entries(table(spark, d, "events"), "user_id", "ts", ALIVE)
    return got.select(F.col("key").alias("user_id"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("created", "last_seen")], "hits", "expired")


@query("""
WITH old AS (SELECT DISTINCT text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 1)
SELECT doc_id, text IS NOT NULL AND text IN (SELECT text FROM old WHERE text IS NOT NULL) AS seen FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 1
""")
def seen_lookup(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    days = [t.where("doc_id % 3 = 0"), t.where("doc_id % 7 = 1")]  # two earlier loads, each with its sketch
    new = t.where("doc_id % 3 <> 0 and doc_id % 7 <> 1")
    return seen.looked_up(new, "hash", days[0].unionByName(days[1]), "hash", seen.merged(*[seen.sketch(x, "hash") for x in days])).select("doc_id", "seen")


#: Conversations as tasks: a turn is an event some seconds after the one before; some fall silent, some fail.
TASK_EVENTS = """
SELECT conv_id AS task, turn AS seq, CASE WHEN turn = 0 THEN 'started' WHEN turn = last THEN CASE WHEN conv_id % 5 = 0 THEN 'failed' ELSE 'completed' END WHEN turn % 2 = 1 THEN 'log' ELSE 'progress' END AS event,
  length(text) / 400e0 - 0.2e0 AS value, md5(text) AS message, conv_id * 7 + turn * 20 + CASE WHEN conv_id % 3 = 0 AND turn = last THEN 100 ELSE 0 END AS second
FROM (SELECT conv_id, turn, coalesce(text, '') AS text, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) AS c
"""
NEVER = 1 << 62


def task_rows(spark, d):
    table(spark, d, "conversations").createOrReplaceTempView("streams_conversations")
    made = spark.sql(TASK_EVENTS.replace("FROM conversations", "FROM streams_conversations").replace("400e0", "400D").replace("0.2e0", "0.2D"))
    return made.withColumn("ts", F.timestamp_seconds(F.col("second")))


@query(f"""
WITH e AS ({TASK_EVENTS}), f AS (SELECT *, lag(second) OVER (PARTITION BY task ORDER BY seq) AS before, count(*) FILTER (event = 'log') OVER w AS logs,
    arg_max(CASE WHEN event = 'progress' THEN greatest(0e0, least(1e0, value)) END, seq) FILTER (event = 'progress') OVER w AS progress FROM e WINDOW w AS (PARTITION BY task ORDER BY seq ROWS UNBOUNDED PRECEDING)
), g AS (
  SELECT task, 'update' AS kind, second AS due, CASE event WHEN 'completed' THEN 'completed' WHEN 'failed' THEN 'failed' ELSE 'running' END AS status, CASE WHEN event = 'completed' THEN 1e0 ELSE coalesce(progress, 0e0) END AS progress, logs, '' AS ring FROM f WHERE event <> 'log'
  UNION ALL SELECT task, 'dead', before + 90, 'failed', coalesce(progress, 0e0), logs - CAST(event = 'log' AS INT), '' FROM f WHERE second - before > 90
  UNION ALL SELECT f.task, 'archived', second + 300, CASE event WHEN 'completed' THEN 'completed' ELSE 'failed' END, CASE WHEN event = 'completed' THEN 1e0 ELSE coalesce(progress, 0e0) END, logs,
    coalesce((SELECT string_agg(l.message, ' ' ORDER BY l.seq) FROM (SELECT e.message, e.seq, row_number() OVER (ORDER BY e.seq DESC) AS r FROM e WHERE e.task = f.task AND e.event = 'log') l WHERE r <= 2), '') FROM f WHERE event IN ('completed', 'failed')
)
SELECT CAST(task AS VARCHAR) AS task, kind, CAST(due AS BIGINT) AS "at", status, round(progress, 6) AS progress, logs, ring FROM g
UNION ALL SELECT CAST(task AS VARCHAR), 'dead', max(second) + 90, 'failed', 0e0, 0, '' FROM e GROUP BY task HAVING bool_and(event NOT IN ('completed', 'failed'))
""")
def task_log(spark, d):
    got = tasks.replay(task_rows(spark, d), ring=2, until=NEVER)
    return got.select("task", "kind", F.floor(F.col("at") / 1_000_000).cast("long").alias("at"), "status", F.round("progress", 6).alias("progress"), "logs", F.coalesce(F.array_join("ring", " "), F.lit("")).alias("ring"))
