"""Queries of the scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories, coerce, dates, pages, prices, text, urls
from ..sources.tables import table

QUERIES, ORACLE = {}, {}
BASE = "2024-01-31 12:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, clean, string_split(clean, ' ') AS w FROM c)
SELECT doc_id, clean, len(list_filter(w, lambda x: x <> '')) AS n_tokens,
       md5(CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
           ELSE array_to_string(list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]), lambda t: t[1] || ' ' || t[2] || ' ' || t[3]), '|') END) AS shingles
FROM w
""")
def text_clean_tokens(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    w = text.tokens(F.col("text"))
    return t.select("doc_id", text.collapse(F.col("text")).alias("clean"), F.size(w).cast("long").alias("n_tokens"), F.md5(F.array_join(text.shingles(w, 3), "|")).alias("shingles"))


@query("""
SELECT doc_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '),
  lambda w: w NOT IN ('the','a','an','and','or','but','in','on','at','to','for','of','with','by')), ' ') AS title
FROM documents
""")
def title_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.title_key(F.col("text")).alias("title"))


@query("""
SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS label, round_even((p - n) / greatest(1, p + n), 3) AS score, p AS positive, n AS negative
FROM (SELECT doc_id, len(list_intersect(w, ['good','great','excellent','amazing','love','best','awesome','fantastic','perfect','wonderful'])) AS p,
             len(list_intersect(w, ['bad','terrible','awful','hate','worst','poor','disappointing','horrible','useless','broken'])) AS n
      FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL))
""")
def sentiment(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", text.sentiment(F.col("text")).alias("s"))
    return t.select("doc_id", "s.label", "s.score", F.col("s.positive").cast("long").alias("positive"), F.col("s.negative").cast("long").alias("negative"))


@query("""
SELECT conv_id, turn, p > n AS pos, n > p AS neg FROM (
  SELECT conv_id, turn, len(list_intersect(w, ['good','great','excellent','amazing','love','best','awesome','fantastic','perfect','wonderful'])) AS p,
         len(list_intersect(w, ['bad','terrible','awful','hate','worst','poor','disappointing','horrible','useless','broken'])) AS n
  FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+')) AS w FROM conversations))
""")
def conversation_sentiment(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", text.sentiment(F.coalesce("text", F.lit(""))).alias("s"))
    return t.select("conv_id", "turn", (F.col("s.positive") > F.col("s.negative")).alias("pos"), (F.col("s.negative") > F.col("s.positive")).alias("neg"))


@query("""
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b'))), ',') AS emails,
       array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\b(?:\\+?1[-.]?)?\\(?([0-9]{3})\\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\\b'),
         lambda m: regexp_replace(m, '^(?:\\+?1[-.]?)?\\(?([0-9]{3})\\)?[-.]?([0-9]{3})[-.]?([0-9]{4})$', '\\1-\\2-\\3')))), ',') AS phones,
       CAST(len(list_distinct(regexp_extract_all(text, 'https?://[^\\s]+'))) AS BIGINT) AS n_urls
FROM documents WHERE text IS NOT NULL
""")
def entities(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    c = F.col("text")
    return t.select("doc_id", F.array_join(F.array_sort(text.emails(c)), ",").alias("emails"), F.array_join(F.array_sort(text.phones(c)), ",").alias("phones"), F.size(text.links(c)).cast("long").alias("n_urls"))


@query("""
SELECT conv_id, turn, array_to_string(list_slice(l, 1, 10), ' ') AS words FROM (
  SELECT conv_id, turn, list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: list_position(w, z[1]) = z[2]), lambda z: z[1]) AS l FROM (
    SELECT conv_id, turn, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'), lambda x: x NOT IN ('the','a','an','and','or','but','in','on','at','to','for','of','with','by') AND length(x) > 2 AND NOT regexp_matches(x, '^[0-9]+$')) AS w FROM conversations))
""")
def keyword_extract(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.keywords(F.coalesce("text", F.lit(""))), " ").alias("words"))


@query("""
SELECT doc_id, substr(sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 500) || right(text, 500) ELSE text END), 1, 16) AS fp, md5(text) AS md5_hash, sha256(text) AS sha_hash
FROM documents WHERE text IS NOT NULL
""")
def content_hashes(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", text.fingerprint(c).alias("fp"), F.md5(c).alias("md5_hash"), F.sha2(c, 256).alias("sha_hash"))


@query("""
SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(html, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '<[^>]+>', '', 'g'), '(?i)javascript:', '', 'g')), 1, 10000) AS safe,
  regexp_matches(html, '(?i)<script|javascript:|on\\w+\\s*=') AS xss,
  regexp_matches(html, '(?i)\\b(union|select|insert|update|delete|drop)\\b') AS sql
FROM pages
""")
def html_sanitize(spark, d):
    t = text.threats(F.col("html"))
    return table(spark, d, "pages").select("page_id", text.sanitized(F.col("html")).alias("safe"), t["xss"].alias("xss"), t["sql"].alias("sql"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) || lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1))
  || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical,
  lower(split_part(regexp_replace(regexp_replace(regexp_replace(url, '(?i)^https?://', ''), '(?i)^www\.', ''), '/+$', ''), '?', 1)) AS strict_key,
  regexp_replace(replace(replace(regexp_replace(url, '#.*$', ''), 'http://', 'https://'), 'https://www.', 'https://'), '/+$', '') AS semantic_key
FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=]*|fbclid|gclid|ref|source)(?:=|$)')), '&') AS q FROM pages)
""")
def url_keys(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.canonical(u).alias("canonical"), urls.strict_key(u).alias("strict_key"), urls.semantic_key(u).alias("semantic_key"))


@query(r"""
SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, count(*) AS n, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1
""")
def url_domain_counts(spark, d):
    return table(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("url").alias("n_urls"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(u, '/product/|/item/|/p/') THEN 'product' WHEN regexp_matches(u, '/category|/collection|/c/') THEN 'category'
  WHEN contains(u, '/search') OR contains(u, '/s?') THEN 'search' WHEN regexp_matches(u, '/cart|/checkout') THEN 'cart' WHEN regexp_matches(u, '/account|/profile|/dashboard|/settings') THEN 'account'
  WHEN regexp_matches(u, '/login|/signin') THEN 'login' WHEN regexp_matches(u, '/register|/signup') THEN 'register' WHEN regexp_matches(u, '/article|/blog|/post/|/news/') THEN 'article'
  WHEN regexp_matches(u, '/api/|/graphql|/v1/|/v2/') THEN 'api' ELSE 'other' END AS class,
  regexp_matches(url, '(?i)\.(exe|bat|sh|php|jsp|asp)(\?|$)|(javascript|data|vbscript):|(%[0-9a-fA-F]{2}){5,}') AS suspicious,
  regexp_matches(url, '(?i)^https?://[^\s/$.?#].[^\s]*$') AS valid
FROM (SELECT page_id, url, lower(url) AS u FROM pages)
""")
def url_page_class(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.page_class(u).alias("class"), urls.suspicious(u).alias("suspicious"), urls.valid_url(u).alias("valid"))


@query(r"""
SELECT page_id, CASE WHEN p <> '' THEN regexp_extract(b, '^(.*[?&]page=)[0-9]+', 1) || CAST(CAST(p AS BIGINT) + 1 AS VARCHAR) || regexp_extract(b, '[?&]page=[0-9]+(.*)$', 1)
  ELSE b || CASE WHEN contains(b, '?') THEN '&page=2' ELSE '?page=2' END END AS next_url
FROM (SELECT page_id, regexp_extract(url, '[?&]page=([0-9]+)', 1) AS p, regexp_replace(url, '#.*$', '') AS b FROM pages)
""")
def next_page_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.next_page(F.col("url")).alias("next_url"))


@query(r"""
SELECT page_id, substr(CASE WHEN p = '' THEN h ELSE h || '_' || p END, 1, 100) AS stem FROM (
  SELECT page_id, replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '.', '_') AS h,
    substr(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS p FROM pages)
""")
def file_stems(spark, d):
    return table(spark, d, "pages").select("page_id", urls.file_stem(F.col("url")).alias("stem"))


@query(r"""
SELECT l_orderkey, l_linenumber, s AS shown, CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE AS value, CASE l_linenumber % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS currency,
  CASE l_linenumber % 3 WHEN 0 THEN CAST(l_extendedprice AS DECIMAL(18,2))::DOUBLE WHEN 1 THEN round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.92, 2)::DOUBLE ELSE round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * 0.79, 2)::DOUBLE END AS usd,
  l_discount > 0.05 AS is_sale
FROM (SELECT *, (CASE WHEN l_discount > 0.05 THEN 'Sale: ' ELSE 'Now ' END) || CASE l_linenumber % 3 WHEN 0 THEN '$' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)
   WHEN 1 THEN CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' EUR' ELSE '£' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS s FROM lineitem)
""")
def price_parse(spark, d):
    value = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    turn = F.col("l_linenumber") % 3
    shown = F.concat(F.when(F.col("l_discount") > 0.05, "Sale: ").otherwise("Now "), F.when(turn == 0, F.concat(F.lit("$"), value)).when(turn == 1, F.concat(value, F.lit(" EUR"))).otherwise(F.concat(F.lit("£"), value)))
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", shown.alias("shown")).withColumn("p", prices.normalized(F.col("shown")))
    return t.select("l_orderkey", "l_linenumber", "shown", "p.value", "p.currency", "p.usd", "p.is_sale")


@query("""
SELECT p_partkey, round(p_retailprice / 0.92 * 0.79, 6) AS eur_to_gbp, round(p_retailprice / 1.0 * 149.5, 6) AS usd_to_jpy FROM part
""")
def price_convert(spark, d):
    p = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.round(prices.convert(p, F.lit("EUR"), F.lit("GBP"), None), 6).alias("eur_to_gbp"), F.round(prices.convert(p, F.lit("USD"), F.lit("JPY"), None), 6).alias("usd_to_jpy"))


@query("""
SELECT p_partkey, 2 AS n, CAST(p_retailprice AS DECIMAL(18,2))::DOUBLE + p_size AS total FROM part WHERE p_size <> CAST(p_retailprice AS DECIMAL(18,2))
""")
def price_extract(spark, d):
    words = F.concat(F.lit("was $"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" now only "), F.col("p_size").cast("string"), F.lit("€ today"))
    t = table(spark, d, "part").where(F.col("p_size") != F.col("p_retailprice").cast("decimal(18,2)")).withColumn("all", prices.all_prices(words))
    return t.select("p_partkey", F.size("all").alias("n"), F.aggregate("all", F.lit(0.0), lambda a, p: a + p["value"]).alias("total"))


@query("""
SELECT l_orderkey, l_linenumber, abs(l_discount * 100 - (l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100) <= 1.0 AS fits,
       abs(5.0 - (l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice * 100) <= 2.000001 AS near_five FROM lineitem
""")
def discount_consistency(spark, d):
    p, o = F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", prices.discount_fits(p, o, F.col("l_discount") * 100, 1.0).alias("fits"), prices.discount_fits(p, o, F.lit(5.0), 2.000001).alias("near_five"))


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
""")
def date_parse_formats(spark, d):
    forms = ("yyyy-MM-dd", "dd-MM-yyyy", "MMMM d, yyyy", "d MMM yyyy", "yyyy/M/d", "yyyy.M.d")
    shown = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        shown = F.when(F.col("o_orderkey") % len(forms) == k, F.date_format("o_orderdate", f)).otherwise(shown)
    return table(spark, d, "orders").select("o_orderkey", F.date_format(dates.absolute(shown), "yyyy-MM-dd").alias("day"))


@query("""
SELECT o_orderkey, CASE WHEN days <= 1 THEN 1.0 WHEN days <= 7 THEN 0.9 WHEN days <= 30 THEN 0.7 WHEN days <= 90 THEN 0.5 WHEN days <= 365 THEN 0.3 ELSE 0.1 END::DOUBLE AS recency, days < 0 OR days < 90 AS live
FROM (SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-08-02 00:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days FROM orders)
""")
def date_buckets(spark, d):
    base = F.lit("1998-08-02 00:00:00").cast("timestamp")
    c = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", dates.recency(c, base).alias("recency"), (~dates.expired(c + F.expr("INTERVAL 1 SECOND"), base, 90 * 86400 - 1) & (c + F.expr("INTERVAL 90 DAY") > base)).alias("live"))


VALUES = ("555-123-4567", "1 (555) 123-4567", "+44 20 7946 0958", "12.5 KG", "1,200 m", "weight: 7", "abc", "12.5", "true", "None")


@query("SELECT event_id, least(60.0, pow(2.0, event_id % 10)) AS delay, (400 + event_id % 110) IN (408, 425, 429, 500, 502, 503, 504) AS again FROM events")
def retry_backoff(spark, d):
    return table(spark, d, "events").select("event_id", coerce.backoff(F.col("event_id") % 10).alias("delay"), coerce.retryable(400 + F.col("event_id") % 110).alias("again"))


@query("""
SELECT p_partkey, lower(p_name) AS name, CASE p_brand WHEN 'Brand#11' THEN 'eleven' WHEN 'Brand#22' THEN 'two' ELSE p_brand END AS brand,
  CASE WHEN p_size BETWEEN 10 AND 40 THEN p_size END AS size, regexp_replace(p_type, '[AEIOU]', '_', 'g') AS type FROM part
""")
def explicit_rules(spark, d):
    c = F.col
    return table(spark, d, "part").select("p_partkey", coerce.by_rule("lower", c("p_name")).alias("name"), coerce.by_rule("map:Brand#11=eleven,Brand#22=two", c("p_brand")).alias("brand"), coerce.by_rule("range:10,40", c("p_size")).alias("size"), coerce.by_rule("regex:[AEIOU]=>_", c("p_type")).alias("type"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS BIGINT) AS n_links FROM pages
""")
def page_title_links(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", pages.title(h).alias("title"), F.size(pages.hrefs(h)).cast("long").alias("n_links"))


def _score(name, parts):
    return " + ".join(f"(length(h) - length(replace(h, '{p}', ''))) // {len(p)} * 2 + (length(u) - length(replace(u, '{p}', ''))) // {len(p)} * 3" for p in parts)


@query("SELECT page_id, list_max(list_value(" + ", ".join(f"{{'s': CAST({_score(n, p)} AS BIGINT), 'o': {-k}, 't': '{n}'}}" for k, (n, p) in enumerate(pages.PAGE_TYPES)) + ")).t AS type, list_max(list_value(" + ", ".join(f"CAST({_score(n, p)} AS BIGINT)" for n, p in pages.PAGE_TYPES) + ")) AS score FROM (SELECT page_id, lower(html) AS h, lower(url) AS u FROM pages)")
def page_type_score(spark, d):
    t = table(spark, d, "pages").select("page_id", pages.page_type(F.col("html"), F.col("url")).alias("p"))
    return t.select("page_id", "p.type", "p.score")


@query("SELECT event_id, " + "CASE " + " ".join(f"WHEN regexp_matches(m, '{'|'.join(p)}') THEN '{n}'" for n, p, _, _ in text.FAILURES) + " ELSE 'unknown' END AS category, " + "CASE " + " ".join(f"WHEN regexp_matches(m, '{'|'.join(p)}') THEN '{s}'" for _, p, s, _ in text.FAILURES) + " ELSE 'medium' END AS severity, CASE WHEN contains(m, 'timeout') THEN 'timeout' WHEN contains(m, 'connection') THEN 'network_error' WHEN contains(m, '403') OR contains(m, '429') THEN 'http_error' WHEN contains(m, 'captcha') OR contains(m, 'blocked') THEN 'blocking' ELSE 'engine_error' END AS kind FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'connection_reset by peer' WHEN 1 THEN 'status 429' WHEN 2 THEN 'captcha shown' WHEN 3 THEN 'paywall' WHEN 4 THEN 'browser_crash' ELSE props END AS m FROM events)")
def failure_classify(spark, d):
    turn, m = F.col("event_id") % 6, F.col("props")
    for k, said in enumerate(("connection_reset by peer", "status 429", "captcha shown", "paywall", "browser_crash")):
        m = F.when(turn == k, said).otherwise(m)
    t = table(spark, d, "events").select("event_id", m.alias("m")).withColumn("f", text.failure(F.col("m")))
    return t.select("event_id", "f.category", "f.severity", text.error_kind(F.col("m")).alias("kind"))


@query("SELECT p_partkey, category, confidence FROM (" + categories.oracle("SELECT p_partkey, lower(p_name || ' ' || p_type || ' phone ' || p_brand) AS x FROM part", "p_partkey") + ")")
def category_enrich(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type", F.lit("phone"), "p_brand")).alias("x"))
    best = categories.best(F.col("x"))
    return t.select("p_partkey", best["name"].alias("category"), best["score"].alias("confidence"))


@query("SELECT doc_id, category, confidence FROM (" + categories.oracle("SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents", "doc_id") + ")")
def category_documents(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("x"))
    best = categories.best(F.col("x"))
    return t.select("doc_id", best["name"].alias("category"), best["score"].alias("confidence"))
