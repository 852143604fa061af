"""Queries of quality dimensions, typed record rules, price coercions and counted categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categories, extraction, prices, quality
from ..operators import learned, records
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NOW = "1998-12-01 00:00:00"
#: A line of an order as a product: its price after discount, and what its brand, dates and media may be.
ITEMS = f"""
SELECT l_orderkey * 10 + l_linenumber AS id, p_name AS name, CASE WHEN l_linenumber % 3 = 0 THEN substr(p_name, 1, 4) ELSE p_brand END AS brand,
  l_extendedprice * CASE WHEN l_linenumber = 5 THEN 1.5e0 ELSE 1 - l_discount END AS price, l_extendedprice AS original, CASE WHEN l_linenumber = 1 THEN 40e0 ELSE l_discount * 100 END AS discount,
  CAST(l_quantity AS BIGINT) % 6 AS rating, CAST(l_suppkey AS BIGINT) % 3 AS reviews, CASE WHEN l_linenumber <> 4 THEN l_shipdate END AS published,
  CASE WHEN l_linenumber <> 6 THEN l_shipdate + (l_linenumber - 2) * INTERVAL '5' DAY END AS updated, l_returnflag AS flag, p_size AS size, l_linenumber AS images, CAST(l_quantity AS BIGINT) % 2 AS videos,
  TIMESTAMP '{NOW}' AS now
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def items(spark, d):
    for name in ("lineitem", "part"):
        table(spark, d, name).createOrReplaceTempView(f"scoring_{name}")
    return spark.sql(ITEMS.replace("FROM lineitem JOIN part", "FROM scoring_lineitem AS lineitem JOIN scoring_part AS part").replace("e0", "D"))


@query(f"""
WITH i AS ({ITEMS}), k AS (
  SELECT *, CAST(price <> 0 AND original <> 0 AS INT) AS c1, CAST(price <> 0 AND original <> 0 AND discount <> 0 AS INT) AS c2, CAST(rating > 0 AND reviews = 0 AS INT) AS c3,
    CAST(published IS NOT NULL AND updated IS NOT NULL AS INT) AS c4, epoch_us(greatest(published, updated)) AS seen FROM i
), s AS (
  SELECT id,
    0.5e0 * CASE WHEN c1 + c2 + c3 + c4 > 0 THEN greatest(0e0, 1 - (c1 * CAST(price > original AS INT) + c2 * CAST(abs(discount - (original - price) / original * 100) > 5 AS INT) + c3 + c4 * CAST(coalesce(updated < published, false) AS INT)) / CAST(c1 + c2 + c3 + c4 AS DOUBLE) * 0.5e0) ELSE 0.8e0 END
      + 0.5e0 * greatest(0e0, 1 - CASE WHEN contains(lower(name), lower(brand)) THEN 0e0 ELSE 0.5e0 END / CAST(2 + CAST(price <> 0 AS INT) AS DOUBLE) * 0.3e0) AS consistency,
    0.6e0 * CASE WHEN seen IS NULL THEN 0.3e0 WHEN epoch_us(now) - seen <= 86400000000 THEN 1e0 WHEN epoch_us(now) - seen <= 7 * 86400000000 THEN 0.9e0 WHEN epoch_us(now) - seen <= 30 * 86400000000 THEN 0.7e0
        WHEN epoch_us(now) - seen <= 90 * 86400000000 THEN 0.5e0 WHEN epoch_us(now) - seen <= 365 * 86400000000 THEN 0.3e0 ELSE 0.1e0 END
      + 0.4e0 * CASE WHEN c4 = 0 THEN 0.5e0 WHEN epoch_us(updated) - epoch_us(published) <= 86400000000 THEN 1e0 WHEN epoch_us(updated) - epoch_us(published) <= 7 * 86400000000 THEN 0.8e0 WHEN epoch_us(updated) - epoch_us(published) <= 30 * 86400000000 THEN 0.6e0 ELSE 0.4e0 END AS freshness,
    0.4e0 * least(1e0, (CAST(flag = 'R' AS INT) + CAST(size > 25 AS INT) + CAST(size > 40 AS INT)) / 5e0 * 1.5e0)
      + 0.3e0 * CASE WHEN images + 2 * videos >= 10 THEN 1e0 WHEN images + 2 * videos >= 5 THEN 0.8e0 WHEN images + 2 * videos >= 3 THEN 0.6e0 WHEN images + 2 * videos >= 1 THEN 0.4e0 ELSE 0.1e0 END
      + 0.3e0 * CASE WHEN flag = 'R' OR size > 40 THEN 1e0 ELSE 0.3e0 END AS richness
  FROM k
)
SELECT id, round(consistency, 6) AS consistency, round(freshness, 6) AS freshness, round(richness, 6) AS richness,
  concat_ws('; ', CASE WHEN round(consistency, 9) < 0.6 THEN 'Internal consistency issues' END, CASE WHEN round(freshness, 9) < 0.4 THEN 'Data may be stale' END, CASE WHEN round(richness, 9) < 0.4 THEN 'Limited detail and media' END) AS issues
FROM s
""")
def quality_dimensions(spark, d):
    """In steps, each a projection of its own: what several scores read is a column first, so that no generated method is so
    large that the JVM doesn't compile it."""
    c = F.col
    given = items(spark, d)
    days = given.withColumns({"age": quality.days_between(F.greatest("published", "updated"), c("now")), "gap": quality.days_between(c("published"), c("updated")), "returned": c("flag") == "R", "media": c("images") + 2 * c("videos"), "saved": (c("original") - c("price")) / F.nullif("original", F.lit(0)) * 100})
    fresh = days.withColumn("freshness", F.round(quality.freshness_of(c("age"), c("gap")), 9))
    rich = fresh.withColumn("richness", F.round(quality.richness([c("returned"), c("size") > 25, c("size") > 40, F.lit(False), F.lit(False)], c("media"), F.lit(0), [c("returned"), c("size") > 40]), 9))
    made = rich.withColumn("consistency", F.round(quality.consistency(c("price"), c("original"), c("discount"), c("rating"), c("reviews"), c("published"), c("updated"), c("brand"), c("name"), F.lit("USD")), 9))
    names = ("consistency", "freshness", "richness")
    return made.select("id", *[F.round(k, 6).alias(k) for k in names], F.concat_ws("; ", quality.issues(**{k: c(k) for k in names})).alias("issues"))


@query(f"""
WITH i AS (SELECT *, CASE WHEN size % 3 > 0 THEN 'http' || CASE WHEN size % 7 = 0 THEN ':/' ELSE 's://' END || flag || '.example/' || id END AS url, CASE WHEN size % 5 = 0 THEN 'no mail' WHEN size % 5 < 4 THEN flag || '@mail.example' END AS email,
  CASE size % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'XXX' END AS currency FROM ({ITEMS})
), k AS (
  SELECT id, CAST(published IS NOT NULL AS INT) + CAST(updated IS NOT NULL AS INT) + CAST(published IS NOT NULL AND updated IS NOT NULL AS INT) AS dn,
    CAST(coalesce(published <= now AND year(published) >= 2000, false) AS INT) + CAST(coalesce(updated <= now AND year(updated) >= 2000, false) AS INT) + CAST(coalesce(updated >= published, false) AS INT) AS dv,
    CAST(url IS NOT NULL AS INT) AS un, CAST(url IS NOT NULL AND size % 7 <> 0 AS INT) AS uv, CAST(email IS NOT NULL AS INT) + 1 + CAST(currency IS NOT NULL AS INT) AS fn, CAST(email IS NOT NULL AND size % 5 <> 0 AS INT) + CAST(rating <= 5 AS INT) + CAST(coalesce(currency = 'USD', false) AS INT) AS fv, price
  FROM (SELECT * REPLACE (published + INTERVAL 10 YEAR AS published, updated + INTERVAL 10 YEAR AS updated, TIMESTAMP '2005-06-01' AS now) FROM i)
)
SELECT id, round(least(1e0, 0.25e0 * (CASE WHEN price BETWEEN 0 AND 50000 THEN 1e0 ELSE 0e0 END + CASE WHEN dn > 0 THEN dv / CAST(dn AS DOUBLE) ELSE 0.5e0 END + CASE WHEN un > 0 THEN uv / CAST(un AS DOUBLE) ELSE 0.5e0 END + fv / CAST(fn AS DOUBLE))), 6) AS accuracy FROM k
""")
def accuracy_checks(spark, d):
    c = F.col
    ten = F.expr("INTERVAL 10 YEAR")
    t = items(spark, d).withColumns({"published": c("published") + ten, "updated": c("updated") + ten, "now": F.lit("2005-06-01").cast("timestamp")})
    t = t.withColumns({
        "url": F.when(c("size") % 3 > 0, F.concat(F.lit("http"), F.when(c("size") % 7 == 0, ":/").otherwise("s://"), "flag", F.lit(".example/"), "id")),
        "email": F.when(c("size") % 5 == 0, "no mail").when(c("size") % 5 < 4, F.concat("flag", F.lit("@mail.example"))), "currency": F.when(c("size") % 4 == 0, "USD").when(c("size") % 4 == 1, "XXX"),
    })
    checks = quality.accuracy([(F.lit(True), c("price").between(0, 50_000))], quality.date_checks([c("published"), c("updated")], c("published"), c("updated"), c("now")), quality.url_checks([c("url")]), quality.format_checks([c("email")], c("rating"), c("currency"), ("USD", "EUR")))
    return t.select("id", F.round(checks, 6).alias("accuracy"))


@query(f"""
WITH i AS (SELECT *, 'http' || CASE WHEN size % 7 = 0 THEN ':/' ELSE 's://' END || flag || '.example/' || id AS url, CASE WHEN size % 5 = 0 THEN 'no mail' ELSE flag || '@mail.example' END AS email FROM ({ITEMS})),
r AS (SELECT id,
  concat_ws(',', CASE WHEN trim(brand) = '' OR brand IS NULL THEN 'currency missing' END, CASE WHEN NOT regexp_full_match(url, '(?i)https?://[^\\s/$.?#].[^\\s]*') THEN 'url format' END,
    CASE WHEN NOT regexp_full_match(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 'email format' END, CASE WHEN published > now THEN 'published_at in the future' END, CASE WHEN updated > now THEN 'updated_at in the future' END,
    CASE WHEN updated < published THEN 'updated_at before published_at' END, CASE WHEN rating > 5 THEN 'rating range' END) AS errors,
  concat_ws(',', CASE WHEN length(name) < 10 THEN 'description short' END, CASE WHEN price > 1000000 THEN 'price high' END, CASE WHEN original > 1000000 THEN 'original_price high' END,
    CASE WHEN year(published) < 2000 THEN 'published_at old' END, CASE WHEN year(updated) < 2000 THEN 'updated_at old' END,
    CASE WHEN price <> 0 AND original > price AND discount <> 0 AND abs(discount - (original - price) / original * 100) > 1 THEN 'discount_pct mismatch' END) AS warnings FROM i)
SELECT id, errors, warnings, errors = '' AS valid, round(greatest(0e0, greatest(0e0, 1 - 0.1e0 * CASE WHEN errors = '' THEN 0 ELSE len(string_split(errors, ',')) END) - 0.02e0 * CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, ',')) END), 6) AS score FROM r
""")
def record_rules(spark, d):
    c = F.col
    t = items(spark, d)
    t = t.withColumn("url", F.concat(F.lit("http"), F.when(c("size") % 7 == 0, ":/").otherwise("s://"), c("flag"), F.lit(".example/"), c("id"))).withColumn("email", F.when(c("size") % 5 == 0, "no mail").otherwise(F.concat("flag", F.lit("@mail.example"))))
    fields = {"name": c("name"), "price": c("price"), "currency": c("brand"), "description": c("name"), "url": c("url"), "email": c("email"), "original_price": c("original"), "discount_pct": c("discount"), "published_at": c("published"), "updated_at": c("updated"), "rating": c("rating")}
    v = records.validated(t, *records.typed_rules(fields, "product", c("now")))
    return v.select("id", F.concat_ws(",", "errors").alias("errors"), F.concat_ws(",", "warnings").alias("warnings"), "valid", F.round("score", 6).alias("score"))


SAID = "CASE p_partkey % 5 WHEN 0 THEN '$' || CAST(p_size AS VARCHAR) || ',234.50' WHEN 1 THEN CAST(p_size AS VARCHAR) || '.234,5 EUR' WHEN 2 THEN CAST(p_size AS VARCHAR) || ',75' WHEN 3 THEN '- -' ELSE '-' || CAST(p_size AS VARCHAR) || ' USD' END"


@query(f"""
SELECT p_partkey, CAST(TRY_CAST(replace(regexp_replace(x, '[^0-9.,-]', '', 'g'), ',', '') AS DECIMAL(38, 10)) AS DOUBLE) AS bare,
  TRY_CAST(CASE WHEN contains(b, ',') AND contains(b, '.') THEN CASE WHEN strpos(reverse(b), ',') < strpos(reverse(b), '.') THEN replace(replace(b, '.', ''), ',', '.') ELSE replace(b, ',', '') END ELSE replace(b, ',', '.') END AS DOUBLE) AS lenient
FROM (SELECT *, regexp_replace(x, '[^0-9.,]', '', 'g') AS b FROM (SELECT p_partkey, {SAID} AS x FROM part))
""")
def price_coercions(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.expr(SAID.replace("VARCHAR", "STRING")).alias("x"))
    return t.select("p_partkey", prices.bare_number(F.col("x")).cast("double").alias("bare"), prices.lenient_number(F.col("x")).alias("lenient"))


@query("""
SELECT p_partkey, len(list_distinct(f)) AS n_prices, round(list_max(f), 2) AS best FROM (
  SELECT p_partkey, list_filter([CAST(p_retailprice AS DOUBLE), CAST(p_size AS DOUBLE), CAST(p_size % 3 AS DOUBLE), CAST(p_size AS DOUBLE)], lambda v: v > 0) AS f FROM part)
""")
def record_prices(spark, d):
    t = table(spark, d, "part")
    dollars = lambda v: F.concat(F.lit("$"), F.col(v).cast("decimal(12,2)").cast("string"))
    small = F.concat((F.col("p_size") % 3).cast("string"), F.lit(" USD"))
    found = prices.of_record({"price": dollars("p_retailprice"), "original_price": dollars("p_size"), "sale_price": small}, [F.concat(F.lit("now only "), dollars("p_size"))])
    return t.select("p_partkey", found.alias("f")).select("p_partkey", F.size("f").cast("long").alias("n_prices"), F.round(prices.greatest_price(F.col("f"))["value"], 2).alias("best"))


TAXONOMY = {"metals": ("steel", "copper", "brass", "tin", "nickel"), "plated": ("plated", "polished", "brushed"), "sizes": ("small", "medium", "large", "jumbo"), "standard": ("standard", "economy", "promo")}


def count_sql() -> str:
    hits = lambda w: f"len(regexp_extract_all(x, '\\b{w}\\b'))"
    said = lambda w: f"CASE WHEN regexp_matches(meta, '\\b{w}\\b') THEN 0.15e0 ELSE 0e0 END"
    parts = [
        f"SELECT p_partkey, {k} AS o, '{name}' AS name, round(least(1e0, ({' + '.join(map(hits, words))}) * 0.1e0) + CASE WHEN contains(src, '{name}') OR contains('{name}', src) THEN 0.3e0 ELSE 0e0 END + {' + '.join(map(said, words))}, 9) AS s, "
        f"array_to_string(list_sort(list_filter({list(words)!r}, lambda w: regexp_matches(x, '\\b' || w || '\\b'))), ' ') AS matched FROM rows"
        for k, (name, words) in enumerate(TAXONOMY.items())
    ]
    rows = "SELECT p_partkey, lower(p_name || ' ' || p_type) AS x, lower(p_brand) AS meta, CASE WHEN p_size % 4 = 0 THEN 'plated goods' ELSE 'none' END AS src FROM part"
    return f"WITH rows AS ({rows}), a AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY s DESC, o) AS rn FROM a) SELECT p_partkey, CASE WHEN s > 0 THEN name ELSE 'other' END AS category, CASE WHEN s > 0 THEN least(s, 1e0) ELSE 0.1e0 END AS confidence, CASE WHEN s > 0 THEN matched ELSE '' END AS matched FROM b WHERE rn = 1"


@query(count_sql())
def category_counts(spark, d):
    t = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("x"), "p_brand", F.when(F.col("p_size") % 4 == 0, "plated goods").otherwise("none").alias("src"))
    got = categories.counted(F.col("x"), TAXONOMY, F.col("src"), [F.col("p_brand")])
    return t.select("p_partkey", got.alias("g")).select("p_partkey", "g.category", "g.confidence", F.array_join("g.matched", " ").alias("matched"))


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS h, text IS NOT NULL AND lang IS NOT NULL AND n_chars >= 40 AS valid, least(1e0, n_chars / 800e0) AS quality FROM documents),
f AS (SELECT *, valid AND row_number() OVER (PARTITION BY valid, h ORDER BY doc_id) > 1 AS twice FROM d)
SELECT count(*) FILTER (coalesce(valid, false) AND NOT twice AND quality >= 0.2) AS processed, count(*) FILTER (coalesce(valid, false)) AS valid, count(*) FILTER (NOT coalesce(valid, false)) AS invalid,
  count(*) FILTER (coalesce(valid AND twice, false)) AS duplicates, count(*) FILTER (coalesce(valid AND NOT twice AND quality < 0.2, false)) AS dropped FROM f
""")
def run_counts(spark, d):
    t = table(spark, d, "documents").withColumn("h", F.sha2("text", 256))
    valid = F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.col("n_chars") >= 40)
    kept, seen = records.run_statistics(t, valid, "h", "doc_id", F.least(F.lit(1.0), F.col("n_chars") / 800), 0.2)
    kept.write.format("noop").mode("overwrite").save()  # the run itself; what it counted comes with it
    return spark.createDataFrame([tuple(seen.get[k] for k in ("processed", "valid", "invalid", "duplicates", "dropped"))], "processed long, valid long, invalid long, duplicates long, dropped long")


@query()
def learned_categories(spark, d):
    """Languages as categories: taught by documents whose hash of the id isn't 2 modulo 4, and at most learned.SAMPLE of them."""
    t = table(spark, d, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learned.trained(t.where(~held), "text", "lang")
    return learned.predicted(model, t, "text").select("doc_id", held.alias("held_out"), "predicted", F.round("probability", 6).alias("probability"))


#: Pages with what sites say of them: products in JSON-LD, articles in both, the rest nothing.
SITE_SAID = """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<script type="application/ld+json">{"@type": "Product", "name": "n' || page_id || '", "price": "' || page_id % 90 || '.50", "sku": ' || page_id || ', "rating": {"value": 4}}</script>'
  WHEN 1 THEN '<script type="application/ld+json">[{"@type": ["Article"], "title": "t' || page_id || '", "keywords": ["a", "b"]}, "x"]</script><meta property="og:title" content="og ' || page_id || '"><meta property="og:type" content="article">' ELSE '' END || html AS html FROM pages
"""


@query(f"""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'n' || page_id WHEN 1 THEN 'og ' || page_id END AS name, CASE WHEN page_id % 3 = 0 THEN page_id % 90 + 0.5e0 END AS price, CASE WHEN page_id % 3 = 0 THEN page_id END AS sku,
  CASE WHEN page_id % 3 = 1 THEN 't' || page_id END AS title, CASE WHEN page_id % 3 = 1 THEN 'a b' END AS keywords, CASE WHEN page_id % 3 = 1 THEN 'article' END AS category FROM pages
""")
def extracted_fields(spark, d):
    extraction.register(spark)
    table(spark, d, "pages").createOrReplaceTempView("scoring_pages")
    spark.sql(SITE_SAID.replace("FROM pages", "FROM scoring_pages")).createOrReplaceTempView("scoring_said")
    return spark.sql("""
        SELECT p.page_id, a.*, b.title, array_join(b.keywords, ' ') AS keywords, b.category FROM scoring_said p,
          LATERAL extract_fields(p.html, '{"properties": {"name": {"type": "string"}, "price": {"type": "number"}, "sku": {"type": "integer"}}}') a,
          LATERAL extract_fields(p.html, '{"properties": {"title": {}, "keywords": {"type": "array", "items": {"type": "string"}}, "category": {}}}') b
    """)
