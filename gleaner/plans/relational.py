"""Queries of the record, dedup, graph, state and metric operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import pages, quality, text, urls
from ..operators import dedup, graph, metrics, records
from ..operators.ordering import ordinals
from ..sources.tables import flattened, table, united

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


FP = "substr(sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 500) || right(text, 500) ELSE text END), 1, 16)"


@query(f"""
WITH f AS (SELECT doc_id, lang, source, {FP} AS fp, length(text) AS n FROM documents WHERE text IS NOT NULL),
k AS (SELECT * FROM f WHERE doc_id IN (SELECT min(doc_id) FROM f GROUP BY fp))
SELECT lang, source, count(*) AS docs, count(*) FILTER (WHERE n >= 500) AS b500, count(*) FILTER (WHERE n >= 200) AS b200, count(*) FILTER (WHERE n >= 100) AS b100,
  round(avg(CASE WHEN n >= 500 THEN 1.0 WHEN n >= 200 THEN 0.7 WHEN n >= 100 THEN 0.4 WHEN n >= 50 THEN 0.2 ELSE 0.1 END), 6) AS content_score, max(n) AS longest
FROM k GROUP BY lang, source
""")
def corpus_quality_report(spark, d):
    t = table(spark, d, "documents").where("text is not null").withColumn("fp", text.fingerprint(F.col("text"))).withColumn("n", F.length("text")).select("doc_id", "lang", "source", "fp", "n")
    kept = dedup.first_wins(t, "fp", "doc_id")
    return kept.groupBy("lang", "source").agg(F.count("*").alias("docs"), *[F.count_if(F.col("n") >= b).alias(f"b{b}") for b in (500, 200, 100)], F.round(F.avg(quality.steps(F.col("n"), quality.CONTENT, 0.1)), 6).alias("content_score"), F.max("n").cast("long").alias("longest"))


@query(f"SELECT fp, min(doc_id) AS first, count(*) AS n FROM (SELECT doc_id, {FP} AS fp FROM documents WHERE text IS NOT NULL) GROUP BY fp HAVING count(*) > 1")
def content_fingerprint_dups(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))
    return t.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


@query(f"""
WITH o AS (SELECT doc_id, {FP} AS fp, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents WHERE text IS NOT NULL)
SELECT doc_id, ordinal, coalesce(ordinal - lag(ordinal) OVER (PARTITION BY fp ORDER BY ordinal) <= 100, false) AS repeat FROM o
""")
def fingerprint_within(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.fingerprint(F.col("text")).alias("fp"))
    return dedup.within(t, "fp", "doc_id", 100).select("doc_id", "ordinal", "repeat")


@query("SELECT md5(text) AS hash, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY 1")
def exact_hash_groups(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query("SELECT lang, round(1 - count(DISTINCT text) / count(*), 6) AS rate FROM documents WHERE text IS NOT NULL GROUP BY lang")
def duplicate_rate(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy("lang").agg(F.round(records.duplicate_rate("text"), 6).alias("rate"))


SIMHASH = """
WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM w),
h AS (SELECT doc_id, substr(md5(g), 17, 16) AS h FROM g),
n AS (SELECT doc_id, h, list_transform(range(1, 17), lambda k: instr('0123456789abcdef', substr(h, k, 1)) - 1) AS d FROM h),
v AS (SELECT doc_id, b, sum(CASE WHEN (d[1 + b // 4] >> (3 - b % 4)) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM n CROSS JOIN range(64) r(b) GROUP BY doc_id, b)
SELECT doc_id, string_agg(CASE WHEN s > 0 THEN '1' ELSE '0' END, '' ORDER BY b) AS bits FROM v GROUP BY doc_id
"""


@query(SIMHASH)
def simhash_signature(spark, d):
    return dedup.simhash_counts(table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query(f"""
WITH s AS ({SIMHASH}), c AS (SELECT CAST(bits AS BIT) AS bits, min(doc_id) AS id FROM s GROUP BY bits)
SELECT a.id AS "left", b.id AS "right", CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM c a JOIN c b ON a.id < b.id WHERE bit_count(xor(a.bits, b.bits)) <= 3
""")
def simhash_near_pairs(spark, d):
    return dedup.hamming_pairs(dedup.simhash_counts(table(spark, d, "documents").where("text is not null"), "doc_id", "text"), "doc_id")


@query()
def fuzzy_title_pairs(spark, d):
    t = table(spark, d, "pages").select("page_id", text.title_key(pages.title(F.col("html"))).alias("title"))
    return dedup.fuzzy_titles(t, "page_id", "title")


@query("""
WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0)
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
FROM q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) >= 0.3
""")
def embedding_near_pairs(spark, d):
    e = table(spark, d, "embeddings")
    return dedup.similar(e, e.where("vec_id % 50 = 0"), 0.3).withColumn("score", F.round("score", 6))


@query("SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)")
def seen_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 0"), "doc_id", "left_semi").select("doc_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def seen_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query(r"""
SELECT page_id, target, count(*) AS n FROM (
  SELECT page_id, regexp_replace(CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN l WHEN starts_with(l, '//') THEN s || ':' || l WHEN starts_with(l, '/') THEN s || '://' || h || l
     WHEN starts_with(l, '#') OR l = '' THEN url WHEN starts_with(l, '?') THEN regexp_replace(url, '[?#].*$', '') || l ELSE s || '://' || h || regexp_replace(CASE WHEN p = '' THEN '/' ELSE p END, '[^/]*$', '') || l END, '#.*$', '') AS target, h
  FROM (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+):', 1) AS s, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p,
        unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS l FROM pages))
WHERE lower(regexp_extract(target, '^[A-Za-z]+://([^/?#]*)', 1)) = lower(h) GROUP BY page_id, target
""")
def page_same_origin_edges(spark, d):
    t = table(spark, d, "pages").select("page_id", "url", F.explode(pages.hrefs(F.col("html"))).alias("l")).withColumn("target", urls.absolute(F.col("l"), F.col("url")))
    return t.where(urls.domain(F.col("target")) == urls.domain(F.col("url"))).groupBy("page_id", "target").agg(F.count("*").alias("n"))


LINKS = """
t AS (SELECT page_id, lower(split_part(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), ' ', 1)) AS word, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS l FROM pages),
d AS (SELECT word, min(page_id) AS target FROM t WHERE word <> '' GROUP BY word),
e AS (SELECT page_id AS source, unnest(l) AS word, unnest(range(0, len(l))) AS position FROM t),
a AS (SELECT e.source, d.target, min(position) AS position FROM e JOIN d ON lower(e.word) = d.word GROUP BY e.source, d.target),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position, target) AS n FROM a) WHERE n <= 10)
"""


def page_links(spark, d):
    """Links between pages: a menu's word leads to the first page whose title begins with it."""
    t = table(spark, d, "pages").select("page_id", F.lower(F.split_part(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), F.lit(" "), F.lit(1))).alias("word"), F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)).alias("l"))
    first = t.where("word <> ''").groupBy("word").agg(F.min("page_id").alias("target"))
    said = t.select(F.col("page_id").alias("source"), F.posexplode("l").alias("position", "w")).withColumn("word", F.lower("w"))
    return said.join(first, "word").groupBy("source", "target").agg(F.min("position").alias("position"))


def hop(k: int) -> str:
    """SQL of the level after level k: nodes not yet seen, by the rank of who links to them and the link's place."""
    seen = " UNION ALL ".join(f"SELECT node FROM s{j}" for j in range(k + 1))
    return f"""s{k + 1} AS (SELECT node, {k + 1} AS depth, (SELECT count(*) FROM ({seen})) + row_number() OVER (ORDER BY f, node) AS rank FROM (
      SELECT r.target AS node, min({{'r': s.rank, 'p': r.position}}) AS f FROM r JOIN s{k} s ON s.node = r.source WHERE r.target NOT IN ({seen}) GROUP BY r.target))"""


@query(f"""
WITH {LINKS}, s0 AS (SELECT page_id AS node, 0 AS depth, row_number() OVER (ORDER BY page_id) AS rank FROM pages WHERE page_id % 25 = 3), {hop(0)}, {hop(1)}, {hop(2)}
SELECT node, CAST(depth AS INTEGER) AS depth, CAST(rank AS BIGINT) AS rank FROM ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(4))}) WHERE rank <= (SELECT count(*) // 12 FROM pages)
""")
def crawl_order(spark, d):
    p = table(spark, d, "pages")
    return graph.crawl(p.where("page_id % 25 = 3").select(F.col("page_id").alias("node")), page_links(spark, d), 3, p.count() // 12)


@query(f"""
WITH {LINKS}, s1 AS (SELECT DISTINCT target AS node FROM r WHERE source = 0 AND target <> 0),
s2 AS (SELECT DISTINCT target AS node FROM r JOIN s1 ON source = node WHERE target <> 0 AND target NOT IN (SELECT node FROM s1))
SELECT 0::BIGINT AS node, 0 AS depth UNION ALL SELECT node, 1 FROM s1 UNION ALL SELECT node, 2 FROM s2
""")
def bfs_two_hops(spark, d):
    return graph.expand(spark.createDataFrame([(0,)], "node long"), page_links(spark, d), 2)


@query(r"""
SELECT page_id, CASE WHEN contains(h, 'blog') THEN 'article' WHEN regexp_matches(p, '^.*\.html$') THEN 'static' WHEN starts_with(p, '/p') THEN 'product' ELSE 'http' END AS engine
FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages)
""")
def routing_first_match(spark, d):
    h, p = urls.domain(F.col("url")), urls.part(F.col("url"), 3)
    rules = [(h.contains("blog"), "article"), (graph.glob(p, "*.html"), "static"), (p.startswith("/p"), "product")]
    return table(spark, d, "pages").select("page_id", graph.first_rule(rules, "http").alias("engine"))


@query("""
SELECT c.c_custkey AS id, c.c_name AS name, n.n_name AS geo_nation, r.r_name AS geo_region_name, '[' || c.c_nationkey || ',' || n.n_regionkey || ']' AS geo_region_keys
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def geo_flatten(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    nested = j.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.struct(F.col("n_name").alias("nation"), F.struct(F.col("r_name").alias("name"), F.array("c_nationkey", "n_regionkey").alias("keys")).alias("region")).alias("geo"))
    return flattened(nested)


@query("""
SELECT id, e AS n_errors, w AS n_warnings, e = 0 AS valid, CAST(round(greatest(0.0, greatest(0.0, 1 - 0.1 * e) - 0.02 * w), 6) AS DOUBLE) AS score FROM (
  SELECT l_orderkey * 10 + l_linenumber AS id, CAST(l_extendedprice <= 0 AS INT) + CAST(l_quantity < 5 AS INT) + CAST(l_returnflag = 'R' AND l_discount > 0.08 AS INT) AS e, CAST(l_tax = 0 AS INT) + CAST(l_discount = 0 AS INT) AS w FROM lineitem)
""")
def record_validate(spark, d):
    c = F.col
    t = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_extendedprice", "l_quantity", "l_returnflag", "l_discount", "l_tax")
    v = records.validated(t, {"price": c("l_extendedprice") <= 0, "quantity": c("l_quantity") < 5, "discount": (c("l_returnflag") == "R") & (c("l_discount") > 0.08)}, {"tax": c("l_tax") == 0, "full": c("l_discount") == 0})
    return v.select("id", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "valid", F.round("score", 6).alias("score"))


@query("""
SELECT p_partkey, round(0.25 * least(1.0, 0.3 * (CAST(p_name <> '' AS INT) + CAST(p_retailprice > 0 AS INT) + 1) / 3.0 + 0.2 * least(1.0, (CAST(p_brand <> '' AS INT) + CAST(p_type <> '' AS INT) + CAST(p_size > 0 AS INT)) / 13.0 * 1.5) + 0.2 * CASE WHEN length(p_name) >= 500 THEN 1.0 WHEN length(p_name) >= 200 THEN 0.7 WHEN length(p_name) >= 100 THEN 0.4 WHEN length(p_name) >= 50 THEN 0.2 ELSE 0.1 END + 0.15 * 0.1 + 0.15 * 0.25)
 + 0.25 * ((CASE WHEN p_retailprice >= 0 AND p_retailprice < 1000000 THEN 1.0 ELSE 0.0 END) * 0.25 + 0.5 * 0.25 + 0.5 * 0.25 + 1.0 * 0.25)
 + 0.2 * (0.5 * 0.8 + 0.5 * (1 - CASE WHEN contains(lower(p_name), lower(p_brand)) THEN 0.0 ELSE 0.5 END / (2.0 + CAST(p_retailprice <> 0 AS INT)) * 0.3)) + 0.15 * (0.6 * 0.3 + 0.4 * 0.5)
 + 0.15 * (0.4 * least(1.0, CAST(p_size > 0 AS INT) / 5.0 * 1.5) + 0.3 * 0.1 + 0.3 * CASE WHEN p_size > 0 THEN 1.0 ELSE 0.3 END), 6) AS score FROM part
""")
def record_quality(spark, d):
    c, no = F.col, F.lit(False)
    full = quality.completeness([c("p_name") != "", c("p_retailprice") > 0, F.lit(True)], [c("p_brand") != "", c("p_type") != "", c("p_size") > 0, *[no] * 10], c("p_name"), F.lit(0), [F.lit(True), no, no, no])
    right = quality.accuracy([(F.lit(True), c("p_retailprice").between(0, 999_999.999))], [], [], [(F.lit(True), F.lit(True))])
    never, none = F.lit(None).cast("timestamp"), F.lit(None).cast("double")  # the table has no dates, former prices or ratings
    alike = quality.consistency(c("p_retailprice"), none, none, none, none, never, never, c("p_brand"), c("p_name"), F.lit("USD"))
    fresh = quality.freshness(F.current_timestamp(), never, never)
    rich = quality.richness([no, c("p_size") > 0, no, no, no], F.lit(0), F.lit(0), [c("p_size") > 0])
    return table(spark, d, "part").select("p_partkey", F.round(quality.overall(completeness=full, accuracy=right, consistency=alike, freshness=fresh, richness=rich), 6).alias("score"))


@query("""
SELECT round((count(doc_id) + count(nullif(text, '')) + count(nullif(lang, '')) + count(nullif(source, '')) + count(n_chars)) / (count(*) * 5.0), 6) AS completeness,
  round(greatest(0.0, 1 - sum(CAST(length(text) > 5000 AS INT)) / (count(*) * 5.0)), 6) AS accuracy, round(1 - count(DISTINCT text) / count(*), 6) AS duplicate_rate,
  round(least(1.0, sum(CAST(length(text) > 10000 AS INT) + CAST(upper(text) = text AND lower(text) <> text AND length(text) > 10 AS INT) + CAST(regexp_matches(text, '(?i)(union|select|insert|delete|drop|exec)\\s') AS INT) + CAST(contains(lower(text), '<script') AS INT)) / (count(*) * 5.0)), 6) AS anomaly
FROM documents
""")
def set_quality_report(spark, d):
    t, c = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), F.col("text")
    cells = F.count("*") * len(t.columns)
    odd = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in (F.length(c) > 10000, (F.upper(c) == c) & (F.lower(c) != c) & (F.length(c) > 10), c.rlike(r"(?i)(union|select|insert|delete|drop|exec)\s"), F.lower(c).contains("<script"))), F.lit(0))
    return t.agg(F.round(records.completeness(t), 6).alias("completeness"), F.round(F.greatest(F.lit(0.0), 1 - F.sum((F.length(c) > 5000).cast("int")) / cells), 6).alias("accuracy"), F.round(records.duplicate_rate("text"), 6).alias("duplicate_rate"), F.round(F.least(F.lit(1.0), F.sum(odd) / cells), 6).alias("anomaly"))


@query("""
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value < 50) AS success, count(*) FILTER (WHERE NOT value < 50) AS failed, round(avg(value), 6) AS avg_latency, round(count(*) FILTER (WHERE value < 50) / count(*), 6) AS success_rate FROM events GROUP BY event_type
""")
def engine_rollup(spark, d):
    r = metrics.rollup(table(spark, d, "events"), "event_type", F.col("value") < 50, "value")
    return r.withColumns({k: F.round(k, 6) for k in ("avg_latency", "success_rate")})


@query("""
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE i = CAST(floor(n * 0.5) AS BIGINT)) AS p50, max(value) FILTER (WHERE i = CAST(floor(n * 0.95) AS BIGINT)) AS p95, max(value) FILTER (WHERE i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM s GROUP BY event_type
""")
def latency_percentiles(spark, d):
    return metrics.by_index(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""
SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (VALUES (10.0::DOUBLE), (25.0), (50.0), (75.0), (100.0), (250.0), ('inf'::DOUBLE)) b(le) GROUP BY event_type, le
""")
def histogram_buckets(spark, d):
    return metrics.histogram(table(spark, d, "events"), "event_type", "value")


@query("""
WITH h AS (SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events CROSS JOIN (VALUES (10.0::DOUBLE), (25.0), (50.0), (75.0), (100.0), (250.0), ('inf'::DOUBLE)) b(le) GROUP BY event_type, le),
l AS (SELECT *, coalesce(lag(le) OVER w, 0.0) AS low, coalesce(lag(n) OVER w, 0) AS below, max(n) OVER (PARTITION BY event_type) * 0.95 AS want FROM h WINDOW w AS (PARTITION BY event_type ORDER BY le))
SELECT event_type, round(min_by(CASE WHEN isinf(le) THEN low ELSE low + (le - low) * (want - below) / greatest(n - below, 1) END, le), 6) AS q FROM l WHERE n >= want GROUP BY event_type
""")
def histogram_quantile(spark, d):
    return metrics.quantile(metrics.histogram(table(spark, d, "events"), "event_type", "value"), "event_type", 0.95).withColumn("q", F.round("q", 6))


@query("""
SELECT event_id, round(count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '299.999999 seconds' PRECEDING AND CURRENT ROW) / 300, 6) AS rate FROM events
""")
def rate_5m(spark, d):
    return metrics.rate(table(spark, d, "events"), "event_type", "ts", 300).select("event_id", F.round("rate", 6).alias("rate"))


@query("""
SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate FROM events GROUP BY 1
""")
def hourly_error_rate(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.count_if(F.col("event_type") == "error") / F.count("*"), 6).alias("error_rate")).select(F.col("w.start").alias("start"), "n", "error_rate")


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT hour, event_type, min(CAST(n > 2 AS INT)) OVER w = 1 AND count(*) OVER w = 3 AS alert FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")
def alert_for(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))
    return metrics.holds_for(h, "event_type", "hour", F.col("n") > 2, 3).select("hour", "event_type", "alert")


@query("""
SELECT user_id, count(*) > 10 AND count(*) FILTER (WHERE event_type = 'error') / count(*) > 0.1 AS alert, max(value) AS worst
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 20 GROUP BY user_id
""")
def alert_last(spark, d):
    last = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = table(spark, d, "events").withColumn("r", F.row_number().over(last)).where("r <= 20")
    return t.groupBy("user_id").agg(((F.count("*") > 10) & (F.count_if(F.col("event_type") == "error") / F.count("*") > 0.1)).alias("alert"), F.max("value").alias("worst"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type <> 'error' AS ok FROM events), c AS (SELECT *, CASE WHEN ok <> lag(ok) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS x FROM e),
t AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS turn FROM c)
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, turn ORDER BY event_id) AS INTEGER) AS streak FROM t
""")
def engine_streaks(spark, d):
    return metrics.streaks(table(spark, d, "events"), "user_id", "event_id", F.col("event_type") != "error").select("event_id", "streak")


@query("""
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id
""")
def engine_error_map(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", "n"))), ",").alias("counts"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def event_sessions(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@query("""
WITH l AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id), m AS (SELECT max(ts) AS now FROM events)
SELECT user_id, last >= now - INTERVAL 12 HOUR AS alive, user_id = min(user_id) FILTER (WHERE last >= now - INTERVAL 12 HOUR) OVER () AS leader FROM l, m
""")
def liveness_leader(spark, d):
    seen = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    now = F.broadcast(table(spark, d, "events").agg((F.max("ts") - F.expr("INTERVAL 12 HOUR")).alias("since")))
    alive = seen.join(now, F.lit(True)).withColumn("alive", F.col("last") >= F.col("since"))
    first = F.broadcast(alive.agg(F.min(F.when(F.col("alive"), F.col("user_id"))).alias("least")))
    return alive.join(first, F.lit(True)).select("user_id", "alive", (F.col("user_id") == F.col("least")).alias("leader"))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 100")
def frontier_pop(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


@query("""
SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, coalesce(n.hits, o.hits) AS hits FROM (SELECT c_custkey AS k, 'old' AS status, 1::BIGINT AS hits FROM customer WHERE c_custkey <= 1000) o
FULL JOIN (SELECT o_custkey AS k, 'new' AS status, count(*) AS hits FROM orders GROUP BY o_custkey) n ON o.k = n.k
""")
def frontier_upsert(spark, d):
    old = table(spark, d, "customer").where("c_custkey <= 1000").select(F.col("c_custkey").alias("k"), F.lit("old").alias("status"), F.lit(1).cast("long").alias("hits"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("new").alias("status"), F.count("*").alias("hits"))
    return records.upserted(old, new, "k")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3")
def checkpoint_retention(spark, d):
    return records.newest(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("SELECT conv_id, max_by(role, turn) AS role, max(turn) AS turn, count(*) AS n FROM conversations GROUP BY conv_id")
def task_event_latest(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.max_by("role", "turn").alias("role"), F.max("turn").alias("turn"), F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey")
def session_stats(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("done"), F.count_if(s == "O").alias("pending"), F.count_if(s == "P").alias("failed"))


@query("""
SELECT doc_id, u - n_chars < t - 1000000 * 0.8 AS gone FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS u, sum(n_chars) OVER () AS t FROM documents)
""")
def cache_evict_size(spark, d):
    return records.evicted(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 1_000_000).select("doc_id", "gone")


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= CAST(floor(count(*) OVER () * 0.2) AS BIGINT) AS gone FROM documents")
def cache_evict_lru(spark, d):
    return records.evicted_share(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2)


@query("SELECT event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 3600000000, false) AS hit FROM events")
def cache_ttl_hits(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 3_600_000_000, F.lit(False)).alias("hit"))


@query("""
WITH u AS (SELECT item_id AS id, 1 AS eng, text FROM benchmark UNION ALL SELECT doc_id, 2, text FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY eng, id) AS r FROM u WHERE text IS NOT NULL)
SELECT id, eng, substr(text, 1, 120) AS snippet, coalesce(l.quality, 0) AS score FROM k LEFT JOIN labels l ON k.eng = 2 AND k.id = l.doc_id WHERE r = 1 ORDER BY score DESC, eng, id LIMIT 20
""")
def search_union_topk(spark, d):
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit(1).alias("eng"), "text")
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(2).alias("eng"), "text")
    u = a.unionByName(b).where("text is not null").withColumn("h", F.md5("text"))
    kept = u.groupBy("h").agg(F.min_by(F.struct("id", "eng", F.substring("text", 1, 120).alias("snippet")), F.struct("eng", "id")).alias("x")).select("x.*")
    scores = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(2).alias("eng"), "quality")
    return kept.join(scores, ["id", "eng"], "left").select("id", "eng", "snippet", F.coalesce("quality", F.lit(0)).alias("score")).orderBy(F.desc("score"), "eng", "id").limit(20)


@query("""
WITH r AS (SELECT event_type AS engine, count(*) FILTER (WHERE value < 50) / count(*) AS rate, avg(value) AS latency FROM events GROUP BY 1)
SELECT engine, round(rate * 0.7 + (1 - latency / 100) * 0.3, 6) AS score, CAST(row_number() OVER (ORDER BY round(rate * 0.7 + (1 - latency / 100) * 0.3, 6) DESC, engine) AS INTEGER) AS rank FROM r
""")
def engine_score_choice(spark, d):
    r = metrics.rollup(table(spark, d, "events"), "event_type", F.col("value") < 50, "value")
    s = r.select(F.col("event_type").alias("engine"), F.round(F.col("success_rate") * 0.7 + (1 - F.col("avg_latency") / 100) * 0.3, 6).alias("score"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "engine")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_orders(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY CUBE (event_type, CAST(ts AS DATE)) HAVING count(*) > 10")
def cube_events(spark, d):
    return table(spark, d, "events").withColumn("day", F.to_date("ts")).cube("event_type", "day").agg(F.count("*").alias("n")).where("n > 10")


@query("(SELECT doc_id FROM documents WHERE n_chars > 1000 INTERSECT SELECT doc_id FROM labels) EXCEPT SELECT doc_id FROM labels WHERE toxic = 1")
def intersect_except(spark, d):
    big, lab = table(spark, d, "documents").where("n_chars > 1000").select("doc_id"), table(spark, d, "labels")
    return big.intersect(lab.select("doc_id")).exceptAll(lab.where("toxic = 1").select("doc_id").distinct())


@query("""
SELECT p.event_id, c.ts AS click_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
""")
def asof_events(spark, d):
    e = table(spark, d, "events").where("event_type in ('purchase', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("click_ts", F.last(F.when(F.col("event_type") == "click", F.col("ts")), ignorenulls=True).over(w)).where("event_type = 'purchase'").select("event_id", "click_ts")


@query("""
SELECT 'doc' AS kind, doc_id AS id, lang, NULL::VARCHAR AS role FROM documents UNION ALL BY NAME SELECT 'conv' AS kind, conv_id AS id, role, NULL::VARCHAR AS lang FROM conversations
""")
def union_of_columns(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "lang")
    b = table(spark, d, "conversations").select(F.lit("conv").alias("kind"), F.col("conv_id").alias("id"), "role")
    return united(a, b)


@query("SELECT event_type, arg_max(value, event_id) AS last_value, max(event_id) AS last_id FROM events GROUP BY event_type")
def gauges_last(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("value", "event_id").alias("last_value"), F.max("event_id").alias("last_id"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ordinal FROM documents")
def arrival_ordinals(spark, d):
    return ordinals(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1")
def orders_without_returns(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n.n_name AS nation, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, count(DISTINCT o.o_orderkey) AS orders FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1")
def revenue_by_nation(spark, d):
    l, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    per = l.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # before the join: a row an order
    return per.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("nation")).agg(F.round(F.sum("r"), 2).alias("revenue"), F.count("*").alias("orders"))
