"""Queries of date forms, arrays, selectors, site flags, limits and rate adaptation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..sources.tables import table
from .scalars import BASE

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%b %d, %Y') AS short, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%H:%M:%S') AS clock,
  CASE WHEN s < 3600 THEN 'just now' WHEN s < 86400 THEN s // 3600 || ' hours ago' WHEN s < 2592000 THEN s // 86400 || ' days ago' WHEN s < 31536000 THEN s // 2592000 || ' months ago' ELSE s // 31536000 || ' years ago' END AS ago
FROM (SELECT *, CAST(epoch(TIMESTAMP '1999-01-01 00:00:00') - epoch(o_orderdate) AS BIGINT) AS s FROM orders)
""")
def date_forms(spark, d):
    c = F.col("o_orderdate")
    t = table(spark, d, "orders").withColumn("s", F.unix_seconds(F.lit("1999-01-01 00:00:00").cast("timestamp")) - F.unix_seconds(c.cast("timestamp")))
    told = lambda unit, name: F.concat(F.floor(F.col("s") / unit).cast("string"), F.lit(f" {name} ago"))
    ago = F.when(F.col("s") < 3600, "just now").when(F.col("s") < 86400, told(3600, "hours")).when(F.col("s") < 2592000, told(86400, "days")).when(F.col("s") < 31536000, told(2592000, "months")).otherwise(told(31536000, "years"))
    form = lambda f: F.date_format(c, f)
    return t.select("o_orderkey", form("yyyy-MM-dd'T'HH:mm:ss").alias("iso"), form("MMM dd, yyyy").alias("short"), form("yyyy-MM-dd").alias("day"), form("HH:mm:ss").alias("clock"), ago.alias("ago"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp(event_id * 100000 * 1000000) ELSE make_timestamp((1600000000000 + event_id * 1000) * 1000) END AS at_time FROM events")
def epoch_forms(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", dates.epoch(F.when(e % 2 == 0, e * 100000).otherwise(1_600_000_000_000 + e * 1000)).cast("timestamp_ntz").alias("at_time"))


@query("""
SELECT user_id, CASE WHEN gap <= 1 THEN 1.0 WHEN gap <= 7 THEN 0.8 WHEN gap <= 30 THEN 0.6 ELSE 0.3 END::DOUBLE AS score FROM (
  SELECT user_id, date_diff('second', min(ts), max(ts)) // 86400 AS gap FROM events GROUP BY user_id)
""")
def update_frequency(spark, d):
    ts = F.col("ts").cast("timestamp")
    gap = F.floor((F.unix_seconds(F.max(ts)) - F.unix_seconds(F.min(ts))) / 86400)
    t = table(spark, d, "events").groupBy("user_id").agg(gap.alias("gap"))
    return t.select("user_id", F.when(F.col("gap") <= 1, 1.0).when(F.col("gap") <= 7, 0.8).when(F.col("gap") <= 30, 0.6).otherwise(0.3).alias("score"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list_filter(list(trim(lower(role))), lambda x: x <> ''))), ',') AS roles, count(*) AS n FROM conversations GROUP BY conv_id")
def normalize_arrays(spark, d):
    roles = F.array_sort(F.array_distinct(F.filter(F.collect_set(F.trim(F.lower("role"))), lambda x: x != "")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"), F.count("*").alias("n"))


@query(r"""
SELECT page_id, contains(h, 'react') OR contains(h, '__next') AS react, contains(h, 'captcha') OR contains(h, 'cf-') AS guarded, contains(h, 'rel="next"') OR contains(h, 'page=') AS paged, contains(h, 'type="password"') OR contains(h, 'login') AS login FROM (SELECT page_id, lower(html) AS h FROM pages)
""")
def site_flags(spark, d):
    has = lambda *parts: F.reduce(F.array(*[F.lower("html").contains(p) for p in parts]), F.lit(False), lambda a, x: a | x)
    return table(spark, d, "pages").select("page_id", has("react", "__next").alias("react"), has("captcha", "cf-").alias("guarded"), has('rel="next"', "page=").alias("paged"), has('type="password"', "login").alias("login"))


@query("""
SELECT page_id, round(least(1.0, 0.5 + 0.2 * CAST(contains(html, '<title') AS INT) + 0.2 * CAST(contains(html, 'lang=') AS INT) + 0.1 * CAST(length(html) > 2000 AS INT)), 6)::DOUBLE AS confidence,
  CASE WHEN contains(html, '<script') AND length(html) < 500 THEN 'browser' WHEN ends_with(url, '.pdf') THEN 'cloud' ELSE 'http' END AS engine FROM pages
""")
def profile_confidence(spark, d):
    h = F.col("html")
    one = lambda c: c.cast("int")
    score = F.least(F.lit(1.0), 0.5 + 0.2 * one(h.contains("<title")) + 0.2 * one(h.contains("lang=")) + 0.1 * one(F.length(h) > 2000))
    engine = F.when(h.contains("<script") & (F.length(h) < 500), "browser").when(F.col("url").endswith(".pdf"), "cloud").otherwise("http")
    return table(spark, d, "pages").select("page_id", F.round(score, 6).alias("confidence"), engine.alias("engine"))


@query("""
SELECT user_id, hour, CASE WHEN errors > 0.3 OR latency > 60 THEN 0.8 WHEN errors < 0.1 AND latency < 50 THEN 1.1 ELSE 1.0 END::DOUBLE AS factor FROM (
  SELECT user_id, date_trunc('day', ts) AS hour, count(*) FILTER (WHERE event_type = 'error') / count(*) AS errors, avg(value) AS latency FROM events GROUP BY ALL)
""")
def rate_adaptation(spark, d):
    g = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").alias("hour")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("errors"), F.avg("value").alias("latency"))
    return g.select("user_id", "hour", F.when((F.col("errors") > 0.3) | (F.col("latency") > 60), 0.8).when((F.col("errors") < 0.1) & (F.col("latency") < 50), 1.1).otherwise(1.0).alias("factor"))


@query("SELECT event_id, max(CASE WHEN event_type = 'error' THEN epoch_us(ts) + CAST(value AS BIGINT) * 60000000 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > epoch_us(ts) IS TRUE AS held FROM events")
def retry_after(spark, d):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.max(F.when(F.col("event_type") == "error", ts + F.round("value").cast("long") * 60_000_000)).over(w)
    return table(spark, d, "events").select("event_id", F.coalesce(until > ts, F.lit(False)).alias("held"))


@query("SELECT lang, source, n, (n + 999) // 1000 AS pages FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)")
def groupwise_counts(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / 1000).cast("long"))


@query("SELECT doc_id, length(text) // 4 AS tokens, coalesce(nullif(trim(text), ''), source, '') <> '' AS has_content FROM documents WHERE text IS NOT NULL")
def token_costs(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.floor(F.length(c) / 4).cast("long").alias("tokens"), (F.coalesce(F.nullif(F.trim(c), F.lit("")), F.col("source"), F.lit("")) != "").alias("has_content"))


@query(f"SELECT TIMESTAMP '{BASE}' AS base, count(*) AS n FROM events WHERE ts < TIMESTAMP '{BASE}'")
def before_base(spark, d):
    return table(spark, d, "events").where(F.col("ts") < F.lit(BASE).cast("timestamp_ntz")).agg(F.lit(BASE).cast("timestamp_ntz").alias("base"), F.count("*").alias("n"))
