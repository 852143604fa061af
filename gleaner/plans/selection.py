"""Queries that select elements of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dom, urls
from ..operators import selectors
from ..operators.selectors import Field
from ..sources import robots, scratch, search, sitemaps
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Pages as sites of several kinds show them: items in cards, in lists, in articles, or none.
KINDS = """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>') WHEN 1 THEN replace(html, '<div class="ad">', '<div class="ad item">')
  WHEN 2 THEN replace(html, '<li>', '<li class="product" data-item>') WHEN 3 THEN replace(html, '<div class="ad">', '<div data-item="ad">') ELSE html END AS html FROM pages
"""


def kinds(spark, d):
    table(spark, d, "pages").createOrReplaceTempView("selection_pages")
    return spark.sql(KINDS.replace("FROM pages", "FROM selection_pages"))


#: Tags apart, the character references of these pages resolved (the last semicolon may be cut off).
PLAIN = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))"""


@query(f"""
WITH p AS ({KINDS}), c AS (
  SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '.item' WHEN 2 THEN '.product' WHEN 3 THEN '[data-item]' ELSE 'article' END AS selector,
    CASE page_id % 5 WHEN 0 THEN [html] WHEN 1 THEN regexp_extract_all(html, '(?s)<div class="ad item">.*?</div>') WHEN 2 THEN regexp_extract_all(html, '(?s)<li class="product" data-item>.*?</li>')
      WHEN 3 THEN regexp_extract_all(html, '(?s)<div data-item="ad">.*?</div>') ELSE regexp_extract_all(html, '(?s)<article>.*?</article>') END AS parts FROM p
), i AS (SELECT page_id, selector, unnest(range(0, len(parts))) AS item, unnest(parts) AS x FROM c
)
SELECT page_id, selector, CAST(item AS INTEGER) AS item, {PLAIN.format("nullif(regexp_extract(x, '(?s)<h1>.*?</h1>'), '')")} AS heading,
  {PLAIN.format("nullif(regexp_extract(x, '(?s)<p>(.*?)</?(p|article|section)>', 1), '')")} AS first_paragraph,
  coalesce(nullif(regexp_extract(x, '<a href="([^"]*)"', 1), ''), 'none') AS link, CAST(len(regexp_extract_all(x, '<a ')) AS INTEGER) AS n_links
FROM i
""")
def container_items(spark, d):
    fields = {"heading": Field("h1"), "first_paragraph": Field("p"), "link": Field("a", attribute="href", default="none"), "links": Field("a", attribute="href", multiple=True)}
    got = selectors.items(kinds(spark, d), fields)
    return got.select("page_id", "selector", "item", "heading", "first_paragraph", "link", F.size("links").alias("n_links"))


@query(r"""
WITH n AS (SELECT page_id, html, regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1) AS nav FROM pages WHERE html IS NOT NULL)
SELECT page_id, array_to_string(list_transform(regexp_extract_all(nav, '(?s)<a href="([^"]*)">', 1), lambda x: lower(x)), ' ') AS menu,
  array_to_string(list_filter(regexp_extract_all(html, '(?s)<a href="([^"]*)">', 1), lambda x: starts_with(x, '/t')), ' ') AS with_t,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS n_paragraphs, CAST(len(regexp_extract_all(nav, '<li>')) > 5 AS BOOLEAN) AS long_menu,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS ad
FROM n
""")
def css_select(spark, d):
    page, e = F.col("page"), F.col("page")["elements"]
    t = table(spark, d, "pages").where("html is not null").select("page_id", dom.parsed(F.col("html")).alias("page"))
    of = lambda f: selectors.value_of(page, e, f)
    return t.select(
        "page_id",
        F.array_join(of(Field("body > nav > ul li > a[href]", attribute="href", multiple=True, transform="lower")), " ").alias("menu"),
        F.array_join(of(Field("a[href^='/t']", attribute="href", multiple=True)), " ").alias("with_t"),
        of(Field("html[lang]", attribute="lang")).alias("lang"),
        F.size(dom.matching(e, "article p, article > p")).alias("n_paragraphs"),
        (F.size(dom.matching(e, "nav li")) > 5).alias("long_menu"),
        of(Field("#ad", fallback=Field("html div.ad"))).alias("ad"),
    )


@query("""
WITH r AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank, 'https://' || coalesce(source, 'none') || '.example/' || doc_id AS url, source || '.example' AS site, lang AS language, TIMESTAMP '2024-01-01' + doc_id % 300 * INTERVAL 1 DAY AS published
  FROM documents
)
SELECT rank, url, site, language, published, CAST(ceil(rank / 200) AS INTEGER) AS page FROM r
WHERE site IN ('src0.example', 'src3.example', 'src5.example', 'src8.example', 'src9.example') AND site <> 'src5.example' AND published >= TIMESTAMP '2024-03-01' AND language IN ('en', 'fr') AND ceil(rank / 200) <= 100000 AND rank % 2 = 0
""")
def search_pages(spark, d):
    t = table(spark, d, "documents")
    results = t.select(
        "doc_id", F.concat(F.lit("https://"), F.coalesce("source", F.lit("none")), F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"), F.concat("source", F.lit(".example")).alias("site"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("language"), F.expr("timestamp'2024-01-01' + make_dt_interval(doc_id % 300)").alias("published"),
    )
    path = scratch.folder(spark, "pages")
    search.write_pages(results, "doc_id", path, 200)
    found = search.read_pages(spark, path)
    wanted = found.where(F.col("site").isin("src0.example", "src3.example", "src5.example", "src8.example", "src9.example") & (F.col("site") != "src5.example") & (F.col("published") >= F.lit("2024-03-01").cast("timestamp")) & F.col("language").isin("en", "fr") & (F.col("page") <= 100000))
    return wanted.where("rank % 2 = 0").select("rank", "url", "site", "language", F.col("published").cast("timestamp_ntz").alias("published"), "page")


#: Sitemaps of the pages: 20 pages a file, 5 files an index, one root; every tenth file is old, and so is every seventh page.
MAP = "https://maps.example/"


def sitemap_files(spark, d):
    esc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = F.when(F.col("page_id") % 7 == 0, "2020-01-01").when(F.col("page_id") % 3 == 0, "2024-06-01T10:00:00Z").otherwise("2024-06-02")
    one = F.concat(F.lit("<url><loc> "), esc, F.lit("</loc><lastmod>"), day, F.lit("</lastmod>"), F.when(F.col("page_id") % 2 == 0, "<priority>0.8</priority><image:image><image:loc>/i.png</image:loc></image:image>").otherwise(""), F.lit("</url>"))
    head = '<?xml version="1.0"?><{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">'
    t = table(spark, d, "pages").where("url is not null").select(F.floor(F.col("page_id") / 20).alias("f"), F.struct("page_id", one.alias("x")).alias("e"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda e: e["x"]), "")
    urlsets = t.groupBy("f").agg(text("e").alias("x")).select("f", F.concat(F.lit(MAP + "f"), F.col("f").cast("string")).alias("url"), F.concat(F.lit(head.format("urlset")), "x", F.lit("</urlset>")).alias("xml"))
    old = F.when(F.col("f") % 10 == 9, "2019-12-31").otherwise("2024-05-05")
    ref = F.concat(F.lit("<sitemap><loc>/f"), F.col("f").cast("string"), F.lit("</loc><lastmod>"), old, F.lit("</lastmod></sitemap>"))
    index = urlsets.select(F.floor(F.col("f") / 5).alias("i"), F.struct("f", ref.alias("x")).alias("e")).groupBy("i").agg(text("e").alias("x")).select("i", F.concat(F.lit(MAP + "i"), F.col("i").cast("string")).alias("url"), F.concat(F.lit(head.format("sitemapindex")), "x", F.lit("</sitemapindex>")).alias("xml"))
    back = F.concat(F.lit("<sitemap><loc>"), "url", F.lit("</loc></sitemap><sitemap><loc>/root</loc></sitemap>"))  # the root leads to itself too
    root = index.select(F.lit(0).alias("r"), F.struct("i", back.alias("x")).alias("e")).groupBy("r").agg(text("e").alias("x")).select(F.lit(MAP + "root").alias("url"), F.concat(F.lit(head.format("sitemapindex")), "x", F.lit("</sitemapindex>")).alias("xml"))
    return urlsets.select("url", "xml").unionByName(index.select("url", "xml")).unionByName(root)


@query(f"""
WITH p AS (SELECT page_id, url, page_id // 20 AS f, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS place FROM pages WHERE url IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY page_id) AS n FROM p WHERE f % 10 <> 9 AND page_id % 7 <> 0)
SELECT '{MAP}f' || f AS sitemap, 2 AS depth, url, CASE WHEN page_id % 3 = 0 THEN '2024-06-01T10:00:00Z' ELSE '2024-06-02' END AS lastmod, CASE WHEN page_id % 2 = 0 THEN 0.8e0 END AS priority, CASE WHEN page_id % 2 = 0 THEN '/i.png' ELSE '' END AS images,
  CAST(place AS INTEGER) AS place FROM k WHERE n <= 15
""")
def sitemap_urls(spark, d):
    roots = spark.createDataFrame([(MAP + "root",), (MAP + "none",)], "url string")
    got = sitemaps.entries(sitemap_files(spark, d), roots, max_depth=5, max_urls=15, min_lastmod_days=400, now=F.lit("2024-12-31 00:00:00").cast("timestamp"))
    return got.select("sitemap", "depth", "url", "lastmod", "priority", F.coalesce(F.array_join("images", " "), F.lit("")).alias("images"), "place")


#: Robots files by the length of a host's name: group for the agent, group for all, rules with wildcards and end marks.
ROBOTS = {
    0: "User-agent: *\nDisallow: /en/\nAllow: /en/1\nDisallow: /*?page=\n\nUser-agent: other\nDisallow: /\n",
    1: "User-agent: other\nUser-agent: gleaner\nCrawl-delay: 2.5\nDisallow: /*5$\nAllow: /fr/*5$\nDisallow: /de\n\nUser-agent: *\nDisallow: /\n",
    2: "# nothing\nUser-agent: *\nDisallow:\nCrawl-delay: 7\n",
}
#: The same rules for the agent: variant, regular expression, length of the path, whether it allows.
RULES = "(0, '^/en/', 4, false), (0, '^/en/1', 5, true), (0, '^/.*\\?page=', 8, false), (1, '^/.*5$', 4, false), (1, '^/fr/.*5$', 7, true), (1, '^/de', 3, false)"


@query(f"""
WITH p AS (SELECT page_id, length(h) % 4 AS v, CASE WHEN t = '' THEN '/' ELSE t END AS t FROM (
  SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS t FROM pages)),
m AS (SELECT p.page_id, max_by(r.allow, r.n * 2 + CAST(r.allow AS INT)) AS allow FROM p JOIN (VALUES {RULES}) r(v, pattern, n, allow) ON r.v = p.v AND regexp_matches(p.t, r.pattern) GROUP BY p.page_id)
SELECT p.page_id, coalesce(m.allow, true) AS allowed, CASE v WHEN 1 THEN 2.5e0 WHEN 2 THEN 7e0 END AS delay FROM p LEFT JOIN m ON m.page_id = p.page_id
""")
def robots_rules(spark, d):
    t = table(spark, d, "pages").select("page_id", urls.part(F.col("url"), 2).alias("host"), F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^#]*)", 1).alias("target"))
    files = t.select("host").distinct().select(F.col("host").alias("site"), F.try_element_at(F.create_map(*[F.lit(x) for kv in ROBOTS.items() for x in kv]), (F.length("host") % 4).cast("int")).alias("text")).where("text is not null")
    return robots.judged(t, "host", "target", robots.rules(files, "Gleaner/1.0")).select("page_id", "allowed", "delay")
