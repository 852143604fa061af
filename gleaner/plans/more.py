"""Queries of selectors, goals, payloads, capabilities, set-level scores and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import arrow, dates, network, prices, schema, text
from ..operators import graph, metrics, records
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT page_id, list_filter([CASE WHEN contains(html, '<script') THEN 'js' END, CASE WHEN contains(html, '<form') THEN 'forms' END, CASE WHEN contains(url, '?') THEN 'query' END], lambda x: x IS NOT NULL)::VARCHAR AS caps FROM pages")
def capability_arrays(spark, d):
    h, u = F.col("html"), F.col("url")
    caps = F.array_compact(F.array(F.when(h.contains("<script"), "js"), F.when(h.contains("<form"), "forms"), F.when(u.contains("?"), "query")))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("["), F.array_join(caps, ", "), F.lit("]")).alias("caps"))


@query("SELECT doc_id, text IS NOT NULL AND trim(text) <> '' AND NOT regexp_matches(lower(text), 'access denied|captcha|not found|forbidden') AS meaningful FROM documents")
def meaningful_result(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", (~text.is_blank(c) & ~F.coalesce(F.lower(c).rlike("access denied|captcha|not found|forbidden"), F.lit(False))).alias("meaningful"))


@query("""
SELECT event_id, ip, n, n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 2130706432 AND 2147483647 OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 0 AND 16777215 AS private
FROM (SELECT event_id, (event_id % 256) || '.' || (event_id % 200) || '.3.' || (event_id % 9) AS ip, (event_id % 256) * 16777216 + (event_id % 200) * 65536 + 3 * 256 + event_id % 9 AS n FROM events)
""")
def private_addresses(spark, d):
    e = F.col("event_id")
    ip = F.concat_ws(".", (e % 256).cast("string"), (e % 200).cast("string"), F.lit("3"), (e % 9).cast("string"))
    return table(spark, d, "events").select("event_id", ip.alias("ip")).select("event_id", "ip", network.number(F.col("ip")).alias("n"), network.private(F.col("ip")).alias("private"))


PART_SCHEMA = {"properties": {"p_size": {"minimum": 5, "maximum": 45}, "p_name": {"minLength": 3}, "p_brand": {"pattern": "^Brand#[1-4]"}}, "required": ["p_name", "p_brand"]}


@query("""
SELECT p_partkey, CAST(p_size < 5 AS INT) + CAST(p_size > 45 AS INT) + CAST(length(p_name) < 3 AS INT) + CAST(NOT regexp_matches(p_brand, '^Brand#[1-4]') AS INT) AS faults FROM part
""")
def schema_validate(spark, d):
    t = table(spark, d, "part")
    return t.select("p_partkey", F.size(schema.faults(PART_SCHEMA, t.columns)).alias("faults"))


@query("SELECT round(avg(CAST(p_size BETWEEN 5 AND 45 AND length(p_name) >= 3 AND regexp_matches(p_brand, '^Brand#[1-4]') AS INT)), 6) AS adherence FROM part")
def schema_adherence(spark, d):
    t = table(spark, d, "part")
    return t.agg(F.round(F.avg((F.size(schema.faults(PART_SCHEMA, t.columns)) == 0).cast("int")), 6).alias("adherence"))


@query("SELECT round(avg(CASE WHEN days <= 1 THEN 1.0 WHEN days <= 7 THEN 0.9 WHEN days <= 30 THEN 0.7 WHEN days <= 90 THEN 0.5 WHEN days <= 365 THEN 0.3 ELSE 0.1 END), 6)::DOUBLE AS freshness FROM (SELECT CAST(floor((epoch(TIMESTAMP '2024-02-15') - epoch(ts)) / 86400) AS BIGINT) AS days FROM events)")
def set_freshness(spark, d):
    return table(spark, d, "events").agg(F.round(F.avg(dates.recency(F.col("ts"), F.lit("2024-02-15 00:00:00").cast("timestamp"))), 6).alias("freshness"))


@query("""
SELECT field, round(present / n, 6) AS presence FROM (SELECT count(*) AS n, count(doc_id) AS doc_id, count(nullif(text, '')) AS text, count(lang) AS lang, count(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id))
UNPIVOT (present FOR field IN (doc_id, text, lang, quality))
""")
def field_presence(spark, d):
    t = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.nullif("text", F.lit("")).alias("text"), "lang", "quality")
    row = t.agg(*[(F.count(c) / F.count("*")).alias(c) for c in t.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.round(c, 6).alias("presence")) for c in t.columns])).alias("f")).select("f.*")


@query("""
SELECT event_type, round(v + f * (coalesce(w, v) - v), 6) AS p90 FROM (
  SELECT event_type, max(value) FILTER (WHERE i = k) AS v, max(value) FILTER (WHERE i = k + 1) AS w, any_value(f) AS f FROM (
    SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, floor(0.9 * (count(*) OVER (PARTITION BY event_type) + 1)) AS k, 0.9 * (count(*) OVER (PARTITION BY event_type) + 1) - floor(0.9 * (count(*) OVER (PARTITION BY event_type) + 1)) AS f FROM events) GROUP BY event_type)
""")
def exclusive_quantile(spark, d):
    return metrics.exclusive(table(spark, d, "events"), "event_type", "value", 0.9).select("event_type", F.round("q", 6).alias("p90"))


@query("SELECT l_orderkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM lineitem GROUP BY l_orderkey")
def price_stats(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"))
    return t


@query("SELECT user_id, coalesce(min_by(event_type, p) FILTER (WHERE value < 20), 'fallback') AS chosen FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 4 END * 1000000 + event_id AS p FROM events) GROUP BY user_id")
def first_success_by_priority(spark, d):
    e = F.col("event_type")
    p = F.when(e == "purchase", 1).when(e == "click", 2).when(e == "view", 3).otherwise(4) * 1_000_000 + F.col("event_id")
    good = F.col("value") < 20
    return table(spark, d, "events").groupBy("user_id").agg(F.coalesce(F.min_by(F.when(good, e), F.when(good, p)), F.lit("fallback")).alias("chosen"))


@query("""
WITH u AS (SELECT 1 AS eng, doc_id AS id, text FROM documents WHERE source = 'none' UNION ALL SELECT 2, item_id, text FROM benchmark UNION ALL SELECT 3, doc_id, text FROM documents)
SELECT eng, id FROM u WHERE eng = (SELECT min(eng) FROM u)
""")
def union_short_circuit(spark, d):
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    u = docs.where("source = 'none'").select(F.lit(1).alias("eng"), F.col("doc_id").alias("id")).union(bench.select(F.lit(2), "item_id")).union(docs.select(F.lit(3), "doc_id"))
    return u.join(F.broadcast(u.agg(F.min("eng").alias("least"))), F.lit(True)).where("eng = least").select("eng", "id")


@query("SELECT event_type, round(avg(value), 6) AS latency, count(DISTINCT user_id) AS users, CAST(row_number() OVER (ORDER BY count(DISTINCT user_id) DESC, round(avg(value), 6)) AS INTEGER) AS place FROM events GROUP BY event_type")
def multi_key_sort(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("latency"), F.count_distinct("user_id").alias("users"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc("users"), "latency")))


@query("SELECT day, CASE WHEN e > 0.25 THEN 'unhealthy' WHEN e > 0.2 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') / count(*) AS e FROM events GROUP BY 1)")
def daily_health(spark, d):
    g = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg((F.count_if(F.col("event_type") == "error") / F.count("*")).alias("e"))
    return g.select("day", metrics.worst(F.array(F.when(F.col("e") > 0.25, "unhealthy").when(F.col("e") > 0.2, "degraded").otherwise("healthy"))).alias("health"))


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'high' WHEN conv_id % 3 = 1 THEN 'normal' ELSE 'low' END AS queue, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY CASE conv_id % 3 WHEN 0 THEN 10 WHEN 1 THEN 5 ELSE 1 END DESC, conv_id, turn) AS r FROM conversations) WHERE r <= 50")
def priority_batch(spark, d):
    turn = F.col("conv_id") % 3
    t = table(spark, d, "conversations").withColumn("p", F.when(turn == 0, 10).when(turn == 1, 5).otherwise(1))
    return t.orderBy(F.desc("p"), "conv_id", "turn").limit(50).select("conv_id", F.when(F.col("p") == 10, "high").when(F.col("p") == 5, "normal").otherwise("low").alias("queue"), "turn")


@query("SELECT conv_id, turn, length(trim(text)) > 0 AND role IN ('user', 'assistant', 'system') AS valid FROM conversations")
def conversation_rules(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", ((F.length(F.trim("text")) > 0) & F.col("role").isin("user", "assistant", "system")).alias("valid"))


@query("SELECT doc_id, lang, text[1:80] AS title, '{\"engine\":\"http\",\"data\":{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}}' AS value FROM documents WHERE lang IS NOT NULL")
def json_envelope(spark, d):
    t = table(spark, d, "documents").where("lang is not null")
    e = t.select("doc_id", F.substring("text", 1, 80).alias("title"), "lang")
    data = F.to_json(F.struct(F.lit("http").alias("engine"), F.struct("doc_id", "lang").alias("data")))
    return e.select("doc_id", "lang", "title", data.alias("value"))


@query()
def arrow_functions(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", arrow.nfkc("text").alias("clean"), arrow.xxhash_hex("text").alias("hash"))


@query("SELECT p_partkey, p_retailprice::DECIMAL(18,2)::VARCHAR AS shown, contains(lower(p_name), 'sale') OR regexp_matches(lower(p_name), 'discount|offer|deal|special|clearance|reduced|markdown|promo|coupon|save|off') AS on_sale FROM part")
def sale_flags(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").cast("string").alias("shown"), prices.is_sale(F.col("p_name")).alias("on_sale"))


@query("SELECT c_custkey, lower(replace(c_name, '#', '_')) AS slug, c_acctbal > 0 AS active FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def search_filters(spark, d):
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"))
    left = c.join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return left.select("c_custkey", text.slug(F.col("c_name")).alias("slug"), (F.col("c_acctbal") > 0).alias("active"))
