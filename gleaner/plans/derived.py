"""Queries of parsers over texts that are put together from the given tables' columns, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coerce, dates, dom, pages, urls
from ..operators import graph, metrics, records, selectors
from ..operators.selectors import Field
from ..sources import feeds
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


def made(spark, d, name: str, sql: str):
    """A table's rows with a text made of its columns."""
    table(spark, d, name).createOrReplaceTempView(f"derived_{name}")
    return spark.sql(sql.replace(f"FROM {name}", f"FROM derived_{name}"))


SAID_DATES = "SELECT event_id, CASE event_id % 7 WHEN 0 THEN (event_id % 50) || ' days ago' WHEN 1 THEN (event_id % 23) || ' hours ago' WHEN 2 THEN (event_id % 7) || ' weeks ago' WHEN 3 THEN 'yesterday' WHEN 4 THEN 'just now' WHEN 5 THEN (event_id % 12 + 1) || ' months ago' ELSE '2024/' || (event_id % 12 + 1) || '/' || (event_id % 28 + 1) END AS x FROM events"


@query(f"""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN b - event_id % 50 * INTERVAL 1 DAY WHEN 1 THEN b - event_id % 23 * INTERVAL 1 HOUR WHEN 2 THEN b - event_id % 7 * INTERVAL 7 DAY WHEN 3 THEN date_trunc('day', b) - INTERVAL 1 DAY WHEN 4 THEN b
  WHEN 5 THEN b - (event_id % 12 + 1) * INTERVAL 30 DAY ELSE CAST(make_date(2024, event_id % 12 + 1, event_id % 28 + 1) AS TIMESTAMP) END AS at FROM (SELECT event_id, TIMESTAMP '{BASE}' AS b FROM events)
""".replace(" AS at", ' AS "at"'))
def date_relative(spark, d):
    return made(spark, d, "events", SAID_DATES).select("event_id", dates.normalized(F.col("x"), F.lit(BASE).cast("timestamp")).cast("timestamp_ntz").alias("at"))


SAID_BOOLEANS = "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN (o_custkey % 3) || '.0' WHEN 2 THEN 'maybe ' || o_custkey WHEN 3 THEN ' ON ' WHEN 4 THEN 'block' WHEN 5 THEN (o_custkey % 2) || '' WHEN 6 THEN '' ELSE 'deny' END AS x FROM orders"


@query("SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN true WHEN 1 THEN o_custkey % 3 <> 0 WHEN 3 THEN true WHEN 4 THEN false WHEN 5 THEN o_custkey % 2 <> 0 WHEN 7 THEN false END AS b FROM orders")
def normalize_booleans(spark, d):
    return made(spark, d, "orders", SAID_BOOLEANS).select("o_orderkey", coerce.boolean(F.col("x")).alias("b"))


SAID_VALUES = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN (200 + c_custkey % 700) || '-555-' || (1000 + c_custkey % 9000) WHEN 1 THEN '+44 20 7946 ' || (1000 + c_custkey % 9000) WHEN 2 THEN (c_custkey % 90) || '.5 KG' WHEN 3 THEN 'weight: ' || c_custkey ELSE 'abc' END AS x FROM customer"


@query(f"""
SELECT c_custkey, CASE WHEN length(g) = 10 THEN '+1' || g WHEN length(g) >= 10 THEN '+' || g ELSE x END AS phone,
  CASE WHEN m <> '' THEN TRY_CAST(replace(m, ',', '') AS DOUBLE) ELSE TRY_CAST(regexp_replace(x, '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS value, CASE WHEN m <> '' THEN lower(regexp_extract(x, '([0-9.,]+)\\s*([a-zA-Z°%µμ]+)', 2)) END AS unit
FROM (SELECT c_custkey, x, regexp_replace(x, '[^0-9]', '', 'g') AS g, regexp_extract(x, '([0-9.,]+)\\s*([a-zA-Z°%µμ]+)', 1) AS m FROM ({SAID_VALUES}))
""")
def normalize_values(spark, d):
    m = coerce.measurement(F.col("x"))
    return made(spark, d, "customer", SAID_VALUES).select("c_custkey", coerce.phone(F.col("x")).alias("phone"), m["value"].alias("value"), m["unit"].alias("unit"))


SAID_KINDS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id || '' WHEN 1 THEN user_id || '.25' WHEN 2 THEN 'true' WHEN 3 THEN 'None' WHEN 4 THEN event_type ELSE ' -' || user_id || ' ' END AS x FROM events"


@query("SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' WHEN 3 THEN 'null' WHEN 4 THEN 'string' ELSE 'integer' END AS kind, CASE event_id % 6 WHEN 0 THEN event_id WHEN 1 THEN user_id + 0.25 WHEN 5 THEN -user_id ELSE 0 END::DOUBLE + 0e0 AS number FROM events")
def literal_kinds(spark, d):
    return made(spark, d, "events", SAID_KINDS).select("event_id", coerce.kind(F.col("x")).alias("kind"), (coerce.coerced(F.col("x"), "number") + 0.0).alias("number"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') ELSE url END AS target FROM pages")
def redirect_unwrap(spark, d):
    t = table(spark, d, "pages")
    x = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("//duck.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("//"), F.regexp_replace("url", "^[a-z]+://", ""))).otherwise(F.col("url"))
    hidden = F.try_url_decode(F.regexp_extract("x", r"[?&]uddg=([^&]+)", 1))
    return t.select("page_id", x.alias("x")).select("page_id", F.when(hidden != "", hidden).when(F.col("x").startswith("//"), F.concat(F.lit("https:"), F.col("x"))).otherwise(F.col("x")).alias("target"))


GOALS = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'find laptop ' || p_name || ' under $' || p_size WHEN 1 THEN 'compare cheap phones in Berlin' WHEN 2 THEN 'best hotel price between ' || p_size || ' and ' || (p_size + 100)
  WHEN 3 THEN 'buy Apple camera over $' || p_size WHEN 4 THEN 'reviews of Sony ' || p_type ELSE 'jobs in Paris for ' || p_brand END AS x FROM part
"""


@query(f"""
SELECT p_partkey, CASE WHEN regexp_matches(l, 'laptop|phone|camera|headphone') THEN 'electronics' WHEN regexp_matches(l, 'hotel') THEN 'travel' WHEN regexp_matches(l, 'news') THEN 'news' WHEN regexp_matches(l, 'job') THEN 'jobs' ELSE 'general' END AS category,
  CASE WHEN contains(l, 'apple') THEN 'apple' WHEN contains(l, 'sony') THEN 'sony' END AS brand,
  CASE WHEN regexp_matches(l, 'compare|versus') THEN 'compare' WHEN regexp_matches(l, 'buy|under|cheap|price') THEN 'buy' WHEN regexp_matches(l, 'review') THEN 'review' ELSE 'search' END AS intent,
  CASE p_partkey % 6 WHEN 2 THEN p_size WHEN 3 THEN p_size END::DOUBLE AS low, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 2 THEN p_size + 100 END::DOUBLE AS high, nullif(regexp_extract(x, '\\bin ([A-Z][a-z]+)', 1), '') AS place
FROM (SELECT g.p_partkey, g.x, lower(g.x) AS l, p.p_size FROM ({GOALS}) g JOIN part p ON p.p_partkey = g.p_partkey)
""")
def goal_parse(spark, d):
    x, low = F.col("x"), F.lower("x")
    got = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    category = graph.first_rule([(low.rlike("laptop|phone|camera|headphone"), "electronics"), (low.rlike("hotel"), "travel"), (low.rlike("news"), "news"), (low.rlike("job"), "jobs")], "general")
    intent = graph.first_rule([(low.rlike("compare|versus"), "compare"), (low.rlike("buy|under|cheap|price"), "buy"), (low.rlike("review"), "review")], "search")
    return made(spark, d, "part", GOALS).select(
        "p_partkey", category.alias("category"), F.when(low.contains("apple"), "apple").when(low.contains("sony"), "sony").alias("brand"), intent.alias("intent"),
        F.coalesce(got(r"(?:over|above)\s*\$?([0-9]+)"), got(r"between\s*\$?([0-9]+)")).try_cast("double").alias("low"),
        F.coalesce(got(r"(?:under|below)\s*\$?([0-9]+)"), got(r"between\s*\$?[0-9]+\s*(?:and|-|to)\s*\$?([0-9]+)")).try_cast("double").alias("high"),
        F.nullif(F.regexp_extract(x, r"\bin ([A-Z][a-z]+)", 1), F.lit("")).alias("place"),
    )


@query(f"SELECT p_partkey, unnest([x, x || ' reviews', x || ' price', 'best ' || x]) AS q FROM ({GOALS})")
def query_expansion(spark, d):
    x = F.col("x")
    every = F.array_distinct(F.array(x, F.concat(x, F.lit(" reviews")), F.concat(x, F.lit(" price")), F.concat(F.lit("best "), x)))
    return made(spark, d, "part", GOALS).select("p_partkey", F.explode(every).alias("q"))


PAYLOADS = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"data": [' || props || ', {"k": 7}]}' WHEN 1 THEN props WHEN 2 THEN '[]' ELSE event_type END AS x FROM events"""


@query("SELECT event_id, CASE WHEN event_id % 4 < 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def payload_unwrap(spark, d):
    v = F.try_parse_json("x")
    return made(spark, d, "events", PAYLOADS).select("event_id", F.coalesce(F.try_variant_get(v, "$.data[0].k", "string"), F.try_variant_get(v, "$.k", "string")).alias("k"))


@query("""
WITH e AS (SELECT user_id, 'http://' || event_type || '.example' AS url, CASE WHEN event_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, 200 + event_id % 5 AS status, event_id FROM events)
SELECT a.user_id, a.url, 'GET' AS method, CAST(min_by(e.status, e.event_id) AS INTEGER) AS status FROM (SELECT DISTINCT user_id, url FROM e) a LEFT JOIN e ON e.user_id = a.user_id AND e.url = a.url AND e.method = 'GET' GROUP BY a.user_id, a.url
""")
def har_replay(spark, d):
    """Each user's events as a recorded session of one archive text; requests are answered from it, the first of a kind."""
    e = table(spark, d, "events")
    method = F.when(F.col("event_id") % 3 == 0, "POST").otherwise("GET")
    request = F.struct(F.concat(F.lit("http://"), "event_type", F.lit(".example")).alias("url"), method.alias("method"))
    entry = F.struct("event_id", F.struct(request.alias("request"), F.struct((200 + F.col("event_id") % 5).cast("int").alias("status")).alias("response")).alias("entry"))
    archives = e.groupBy("user_id").agg(F.to_json(F.struct(F.struct(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]).alias("entries")).alias("log"))).alias("har"))
    schema = "struct<log:struct<entries:array<struct<request:struct<url:string,method:string>,response:struct<status:int>>>>>"
    held = archives.select("user_id", F.posexplode(F.from_json("har", schema)["log"]["entries"]).alias("k", "e")).groupBy("user_id", "e.request.url", "e.request.method").agg(F.min_by("e.response.status", "k").alias("status"))
    asked = e.select("user_id", F.concat(F.lit("http://"), "event_type", F.lit(".example")).alias("url"), F.lit("GET").alias("method")).distinct()
    return asked.join(held, ["user_id", "url", "method"], "left")


SAID_IN_TEXT = "SELECT event_id, event_type || ' seen ' || CAST(ts AS DATE) || ' and ' || (event_id % 9 + 2) || ' days ago, due ' || (event_id % 28 + 1) || '/02/2024' || CASE WHEN event_id % 2 = 0 THEN ' Yesterday' ELSE '' END AS x FROM events"


@query("SELECT event_id, CAST(ts AS DATE) || '|' || (event_id % 28 + 1) || '/02/2024|' || (event_id % 9 + 2) || ' days ago' || CASE WHEN event_id % 2 = 0 THEN '|yesterday' ELSE '' END AS found FROM events")
def dates_in_text(spark, d):
    absolute = F.regexp_extract_all("x", F.lit(r"\b(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b"), F.lit(0))
    relative = F.regexp_extract_all(F.lower("x"), F.lit(r"\b(?:[0-9]+ (?:second|minute|hour|day|week|month|year)s? ago|yesterday|today|tomorrow|just now)\b"), F.lit(0))
    return made(spark, d, "events", SAID_IN_TEXT).select("event_id", F.array_join(F.array_distinct(F.concat(absolute, relative)), "|").alias("found"))


XML = """SELECT event_id, '<a><b>' || event_id || '</b><b>' || user_id || '</b>' || CASE WHEN event_id % 2 = 0 THEN '<c d="' || event_type || '">y</c>' ELSE '' END || '</a>' AS x FROM events"""


@query("SELECT event_id, event_id || ',' || user_id AS b, CASE WHEN event_id % 2 = 0 THEN 'y' ELSE '' END AS c, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS d FROM events")
def xpath_select(spark, d):
    one = lambda p: F.coalesce(F.xpath_string("x", F.lit(p)), F.lit(""))
    return made(spark, d, "events", XML).select("event_id", F.array_join(F.xpath("x", F.lit("/a/b/text()")), ",").alias("b"), one("/a/c").alias("c"), one("/a/c/@d").alias("d"))


NESTED = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"a": {"b": [1, ' || props || ']}, "}": "[["}' WHEN 1 THEN props WHEN 2 THEN '[' || props || ', [[]]]' ELSE '{' || event_type END AS x FROM events"""


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 1 END AS depth, event_id % 4 < 3 AS ok FROM events")
def json_depth(spark, d):
    bare = F.regexp_replace(F.regexp_replace("x", r'"(?:[^"\\]|\\.)*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.filter(F.split(bare, ""), lambda c: c != ""), lambda c: F.when(c.isin("[", "{"), 1).otherwise(-1))
    deep = F.aggregate(steps, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda a, s: F.struct((a["now"] + s).alias("now"), F.greatest(a["most"], a["now"] + s).alias("most")))
    return made(spark, d, "events", NESTED).select("event_id", deep["most"].alias("depth"), F.try_parse_json("x").isNotNull().alias("ok"))


MARKED = """SELECT page_id, '<i class="n"> ' || page_id || '.75 </i><b>  Mixed Case </b><u></u>' || html AS html FROM pages"""


@query("SELECT page_id, page_id AS whole, page_id + 0.75e0 AS number, 'mixed case' AS lowered, 'MIXED CASE' AS raised, true AS there, false AS empty, 0::BIGINT AS none, NULL::DOUBLE AS word FROM pages")
def selector_transforms(spark, d):
    t = made(spark, d, "pages", MARKED).select("page_id", dom.parsed(F.col("html")).alias("page"))
    page, e = F.col("page"), F.col("page")["elements"]
    asked = {"whole": (".n", "int"), "number": (".n", "float"), "lowered": ("b", "lower"), "raised": ("b", "upper"), "there": ("b", "bool"), "empty": ("u", "bool"), "none": ("u", "int"), "word": ("b", "float")}
    return t.select("page_id", *[selectors.value_of(page, e, Field(s, transform=how)).alias(k) for k, (s, how) in asked.items()])


LOGS = """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) || 'T03:04:05Z INFO user ' || user_id WHEN 1 THEN '{"level": "' || event_type || '", "msg": "m' || event_id || '"}' WHEN 2 THEN event_type ELSE CAST(ts AS DATE) || 'T03:04:06Z WARN slow k=' || props END AS x FROM events
"""


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(ts AS DATE) || 'T03:04:05Z' WHEN 3 THEN CAST(ts AS DATE) || 'T03:04:06Z' END AS seen_at, CASE event_id % 4 WHEN 0 THEN 'INFO' WHEN 1 THEN event_type WHEN 3 THEN 'WARN' END AS level,
  CASE event_id % 4 WHEN 0 THEN 'user ' || user_id WHEN 1 THEN 'm' || event_id WHEN 3 THEN 'slow k=' || props END AS message FROM events
""")
def log_parse(spark, d):
    got = lambda k: F.nullif(F.regexp_extract("x", r"^(\S+Z) ([A-Z]+) (.*)$", k), F.lit(""))
    return made(spark, d, "events", LOGS).select("event_id", got(1).alias("seen_at"), F.coalesce(got(2), F.get_json_object("x", "$.level")).alias("level"), F.coalesce(got(3), F.get_json_object("x", "$.msg")).alias("message"))


TAGGED = """
SELECT page_id, CASE page_id % 2 WHEN 0 THEN '<meta property="og:title" content="A"><meta property="og:title" content="B' || page_id || '"><meta property="og:type" content="x"><script type="application/ld+json">{"@type": "Product"}</script>'
  ELSE '<p class="item big"> one <b>n' || page_id || '</b></p><script type="application/ld+json">{bad</script>' END || html AS html FROM pages
"""


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'title=B' || page_id || ',type=x' ELSE '' END AS og, 1 - page_id % 2 AS n_ld, CASE WHEN page_id % 2 = 1 THEN 'one n' || page_id ELSE '' END AS item FROM pages")
def meta_maps(spark, d):
    og = F.array_join(F.array_sort(F.transform(F.map_entries(pages.meta_map(F.col("html"), "property", "og:")), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return made(spark, d, "pages", TAGGED).select("page_id", og.alias("og"), F.size(pages.json_ld(F.col("html"))).cast("long").alias("n_ld"), F.array_join(pages.css_text(F.col("html"), "p", "item"), ",").alias("item"))


BARE_URLS = "SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN regexp_replace(url, '^[a-z]+:', '') WHEN 3 THEN 'mailto:a@b.example' WHEN 4 THEN '  ' ELSE 'https://' END AS x FROM pages"


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') WHEN 2 THEN 'https://' || regexp_replace(url, '^[a-z]+://', '') END AS address FROM pages")
def normalize_urls(spark, d):
    return made(spark, d, "pages", BARE_URLS).select("page_id", urls.with_scheme(F.col("x")).alias("address"))


def kind_sql() -> str:
    count = lambda words: " + ".join(f"CAST(contains(h, '{w}') AS INT)" for w in words)
    rows = ", ".join(f"{{'s': {count(words)}, 'o': {-k}, 'n': '{name}'}}" for k, (name, words) in enumerate(pages.SITE_KINDS.items()))
    return f"SELECT page_id, CASE WHEN b.s > 0 THEN b.n ELSE 'unknown' END AS kind, CAST(b.s AS INTEGER) AS score FROM (SELECT page_id, list_max([{rows}]) AS b FROM (SELECT page_id, lower(html) AS h FROM pages))"


@query(kind_sql())
def site_kinds(spark, d):
    k = pages.site_kind(F.col("html"))
    return table(spark, d, "pages").select("page_id", k.alias("k")).select("page_id", "k.kind", "k.score")


SAID_MONTH_FIRST = """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN (event_id % 12 + 1) || '/' || (event_id % 28 + 1) || '/2023' WHEN 1 THEN (event_id % 28 + 1) || '-' || (event_id % 12 + 1) || '-2023' WHEN 2 THEN '2023/' || (event_id % 12 + 1) || '/' || (event_id % 28 + 1)
  WHEN 3 THEN (event_id % 28 + 1) || '.' || (event_id % 12 + 1) || '.2023' WHEN 4 THEN (event_id % 28 + 1) || ' Mar 2023' WHEN 5 THEN 'Nov ' || (event_id % 28 + 1) || ', 2023' WHEN 6 THEN (1700000000 + event_id) || '' WHEN 7 THEN (1700000000 + event_id) || '500'
  WHEN 8 THEN (event_id % 40) || ' hours ago' ELSE event_type END AS x FROM events
"""


@query(f"""
SELECT event_id, CASE event_id % 10 WHEN 0 THEN m WHEN 1 THEN m WHEN 2 THEN m WHEN 3 THEN m WHEN 4 THEN CAST(make_date(2023, 3, event_id % 28 + 1) AS TIMESTAMP) WHEN 5 THEN CAST(make_date(2023, 11, event_id % 28 + 1) AS TIMESTAMP)
  WHEN 6 THEN CAST(make_timestamp((1700000000 + event_id) * 1000000) AS TIMESTAMP) WHEN 7 THEN make_timestamp((1700000000 + event_id) * 1000000 + 500000) WHEN 8 THEN TIMESTAMP '{BASE}' - event_id % 40 * INTERVAL 1 HOUR END AS "at"
FROM (SELECT event_id, CAST(make_date(2023, event_id % 12 + 1, event_id % 28 + 1) AS TIMESTAMP) AS m FROM events)
""")
def month_first_dates(spark, d):
    return made(spark, d, "events", SAID_MONTH_FIRST).select("event_id", dates.month_first(F.col("x"), F.lit(BASE).cast("timestamp")).cast("timestamp_ntz").alias("at"))


TYPED = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, CASE WHEN p_partkey % 7 = 0 THEN 'short' ELSE p_type || ' ' || p_brand END AS content, p_size * 3 AS word_count, p_size / 10e0 AS reading, p_size % 8 AS rating,
  p_size AS helpful, p_partkey % 60 AS votes, CASE WHEN p_partkey % 11 = 0 THEN -p_retailprice ELSE p_retailprice END AS price, p_size * 4e0 - 95 AS lat, p_size * 8e0 - 190 AS lon FROM part
"""


@query(f"""
WITH t AS ({TYPED}), g AS (SELECT p_partkey,
  concat_ws(',', CASE WHEN title = '' THEN 'title missing' END) AS article, concat_ws(',', CASE WHEN length(content) < 10 THEN 'content short' END, CASE WHEN word_count <> 0 AND word_count < 50 THEN 'word_count low' END, CASE WHEN reading <> 0 AND reading < 1 THEN 'reading_time_min short' END) AS article_w,
  concat_ws(',', CASE WHEN rating = 0 THEN 'rating missing' END, CASE WHEN rating > 6 THEN 'rating range' END, CASE WHEN helpful > votes THEN 'votes' END) AS review, concat_ws(',', CASE WHEN length(content) < 10 THEN 'content short' END) AS review_w,
  concat_ws(',', CASE WHEN title = '' THEN 'title missing' END, CASE WHEN price < 0 THEN 'price negative' END, CASE WHEN price < 0 THEN 'price not positive' END, CASE WHEN NOT lat BETWEEN -90 AND 90 THEN 'latitude range' END, CASE WHEN NOT lon BETWEEN -180 AND 180 THEN 'longitude range' END) AS listing, '' AS listing_w FROM t
)
SELECT p_partkey, 'article' AS kind, article AS errors, article_w AS warnings FROM g UNION ALL SELECT p_partkey, 'review', review, review_w FROM g UNION ALL SELECT p_partkey, 'listing', listing, listing_w FROM g
""")
def typed_records(spark, d):
    table(spark, d, "part").createOrReplaceTempView("derived_part")
    t = spark.sql(TYPED.replace("FROM part", "FROM derived_part").replace("e0", "D"))
    c, now = F.col, F.lit("2024-01-01").cast("timestamp")
    given = {
        "article": {"title": c("title"), "content": c("content"), "word_count": c("word_count"), "reading_time_min": c("reading")},
        "review": {"rating": c("rating"), "content": c("content"), "max_rating": F.lit(6), "helpful_votes": c("helpful"), "total_votes": c("votes")},
        "listing": {"title": c("title"), "price": c("price"), "latitude": c("lat"), "longitude": c("lon")},
    }
    parts = [records.validated(t, *records.typed_rules(fields, kind, now)).select("p_partkey", F.lit(kind).alias("kind"), F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings")) for kind, fields in given.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
WITH e AS (SELECT *, value < 90 AS ok FROM events), b AS (SELECT *, sum(CAST(NOT ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT *, min(CASE WHEN ok THEN ts END) OVER (PARTITION BY user_id, run) AS start FROM b)
SELECT event_id, ok AND ts - start >= INTERVAL 36 HOUR AS alert FROM s
""")
def alert_for_time(spark, d):
    return metrics.holds_since(table(spark, d, "events"), "user_id", "ts", F.col("value") < 90, 36 * 3600, "event_id").select("event_id", "alert")


@query("""
WITH h AS (SELECT event_type AS t, CASE WHEN user_id % 2 = 0 THEN 'a"b' ELSE 'c' END AS s, value FROM events),
g AS (SELECT t, replace(s, '"', '\\"') AS s, count(*) FILTER (value <= 10) AS b0, count(*) FILTER (value <= 50) AS b1, count(*) FILTER (value <= 100) AS b2, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(30,6))) AS DOUBLE) AS total FROM h GROUP BY t, s),
l AS (SELECT *, '{t="' || t || '",s="' || s || '"' AS x FROM g)
SELECT 'latency' AS family, 0 AS place, '# HELP latency Seconds taken' AS value UNION ALL SELECT 'latency', 1, '# TYPE latency histogram'
UNION ALL SELECT 'latency', 2, unnest(['latency_bucket' || x || ',le="10"} ' || b0, 'latency_bucket' || x || ',le="50"} ' || b1, 'latency_bucket' || x || ',le="100"} ' || b2, 'latency_bucket' || x || ',le="+Inf"} ' || n, 'latency_count' || x || '} ' || n]) FROM l
UNION ALL SELECT 'seen', 0, '# HELP seen Events by type' UNION ALL SELECT 'seen', 1, '# TYPE seen counter' UNION ALL SELECT 'seen', 2, 'seen{t="' || event_type || '"} ' || count(*) FROM events GROUP BY event_type
""")
def metrics_text(spark, d):
    h = table(spark, d, "events").select(F.col("event_type").alias("t"), F.when(F.col("user_id") % 2 == 0, 'a"b').otherwise("c").alias("s"), "value")
    lines = feeds.exposed_histogram(h, "latency", "Seconds taken", ["t", "s"], "value", (10.0, 50.0, 100.0))
    counts = feeds.exposed(h.groupBy("t").agg(F.count("*").alias("n")), "seen", "counter", "Events by type", ["t"], "n")
    return lines.where("value not like 'latency_sum%'").unionByName(counts)  # sums as text differ between engines in their last digits


@query("""
WITH old AS (SELECT DISTINCT user_id AS session_id, event_type AS url FROM events WHERE event_id % 5 = 0), new AS (SELECT user_id AS session_id, event_type AS url, min(event_id) AS first FROM events WHERE event_id % 5 <> 0 GROUP BY user_id, event_type)
SELECT session_id, url, CAST(NULL AS BIGINT) AS first FROM old UNION ALL SELECT session_id, url, first FROM new WHERE (session_id, url) NOT IN (SELECT (session_id, url) FROM old)
""")
def frontier_insert(spark, d):
    """New addresses of a session go in unless it has them already."""
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("url"), "event_id")
    old = e.where("event_id % 5 = 0").select("session_id", "url").distinct().withColumn("first", F.lit(None).cast("long"))
    new = e.where("event_id % 5 <> 0").groupBy("session_id", "url").agg(F.min("event_id").alias("first"))
    return old.unionByName(new.join(old, ["session_id", "url"], "left_anti"))


@query("SELECT event_id, user_id, (SELECT min(f.event_id) % 7 FROM events f WHERE f.user_id = e.user_id AND f.event_id % 3 = 0) AS depth FROM events e WHERE event_id % 3 <> 0")
def visited_depths(spark, d):
    """What is visited takes its depth from the frontier, where it is there."""
    e = table(spark, d, "events")
    frontier = e.where("event_id % 3 = 0").groupBy("user_id").agg((F.min("event_id") % 7).alias("depth"))
    return e.where("event_id % 3 <> 0").select("event_id", "user_id").join(frontier, "user_id", "left")


@query("""
SELECT event_type, round(avg(value), 6) AS mean, round(count(*) / greatest(1, date_diff('second', min(ts), max(ts))), 9) AS per_second, round(count(*) FILTER (WHERE value < 90) / count(*), 6) AS success_rate FROM events GROUP BY event_type
""")
def latency_summary(spark, d):
    t = table(spark, d, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))
    span = F.greatest(F.lit(1), F.max("at") - F.min("at"))
    return t.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.count("*") / span, 9).alias("per_second"), F.round(F.count_if(F.col("value") < 90) / F.count("*"), 6).alias("success_rate"))


@query("""
SELECT count(*) AS groups, count(*) FILTER (WHERE n > 1) AS repeated, max(n)::BIGINT AS largest, round(sum(n - 1) / sum(n), 6) AS match_rate, round(sum(n * c) FILTER (WHERE n > 1) / greatest(1, sum(n * c)), 6) AS match_share
FROM (SELECT sha256(text) AS h, count(*) AS n, max(length(text)) AS c FROM documents WHERE text IS NOT NULL GROUP BY 1)
""")
def duplicate_sizes(spark, d):
    """Sizes of the index of texts and how many rows, and characters, met one that was there."""
    g = table(spark, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("c"))
    chars = F.col("n") * F.col("c")
    return g.agg(
        F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated"), F.max("n").alias("largest"), F.round(F.sum(F.col("n") - 1) / F.sum("n"), 6).alias("match_rate"),
        F.round(F.coalesce(F.sum(F.when(F.col("n") > 1, chars)), F.lit(0)) / F.greatest(F.lit(1), F.sum(chars)), 6).alias("match_share"),
    )


KIND = "CASE WHEN value >= 95 THEN 'timeout' WHEN value >= 92 THEN 'blocked' ELSE 'slow' END"


@query(f"""
WITH e AS (SELECT *, {KIND} AS kind FROM events WHERE value >= 90), c AS (SELECT event_type, kind, count(*) AS n FROM e GROUP BY event_type, kind)
SELECT l.event_type, l.last_error, l.last_kind, m.kinds FROM (SELECT event_type, max_by(event_id, epoch_us(ts) * 1000000 + event_id % 1000000) AS last_error, max_by(kind, epoch_us(ts) * 1000000 + event_id % 1000000) AS last_kind FROM (SELECT event_type, event_id, ts, kind FROM e) GROUP BY event_type) l
JOIN (SELECT event_type, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM c GROUP BY event_type) m ON m.event_type = l.event_type
""".replace("epoch_us(ts) * 1000000 + event_id % 1000000", "CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id % 1000000"))
def engine_last_errors(spark, d):
    e = table(spark, d, "events").where("value >= 90").withColumn("kind", F.expr(KIND))
    counts = e.groupBy("event_type", "kind").agg(F.count("*").alias("n")).groupBy("event_type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    last = e.groupBy("event_type").agg(F.max(F.struct("ts", "event_id", "kind")).alias("last"))
    shown = F.array_join(F.transform(F.map_entries("kinds"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return last.join(counts, "event_type").select("event_type", F.col("last.event_id").alias("last_error"), F.col("last.kind").alias("last_kind"), shown.alias("kinds"))


@query("""
SELECT domain, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (
  SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, CASE WHEN contains(url, 'page=') THEN 'list' WHEN regexp_matches(url, '[.]html$') THEN 'static' ELSE 'page' END AS kind, count(*) AS n FROM pages GROUP BY 1, 2) GROUP BY domain
""")
def page_kinds_by_domain(spark, d):
    kind = F.when(F.contains("url", F.lit("page=")), "list").when(F.rlike("url", F.lit("[.]html$")), "static").otherwise("page")
    g = table(spark, d, "pages").groupBy(urls.domain(F.col("url")).alias("domain"), kind.alias("kind")).agg(F.count("*").alias("n"))
    return g.groupBy("domain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "n"))), lambda x: F.concat_ws("=", x["kind"], x["n"].cast("string"))), ",").alias("kinds"))
