"""Sitemaps, robots files and crawl order against small models in Python."""

import random
import urllib.robotparser
from urllib.parse import urljoin

from pyspark.sql import functions as F

from gleaner.functions import urls
from gleaner.operators import graph
from gleaner.sources import robots, sitemaps


def test_sitemap_index(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    many = "".join(f"<url><loc>http://h/{k}</loc></url>" for k in range(30))
    files = [
        ("http://h/root", f'<?xml version="1.0" encoding="UTF-8"?><sitemapindex {ns}><sitemap><loc> /a </loc></sitemap><sitemap><loc>b</loc><lastmod>2020-01-01</lastmod></sitemap><sitemap><loc>/root</loc></sitemap><sitemap><loc></loc></sitemap><sitemap><loc>/gone</loc></sitemap></sitemapindex>'),
        ("http://h/a", f"<urlset {ns}><url><loc>http://h/x?a=1&amp;b=2</loc><lastmod>2024-06-01T00:00:00Z</lastmod><changefreq> daily </changefreq><priority>0.9</priority></url><url><loc>http://h/old</loc><lastmod>2001-01-01</lastmod></url><url><lastmod>2024-01-01</lastmod></url><url><loc>http://h/y</loc><lastmod>?</lastmod><priority>high</priority></url></urlset>"),
        ("http://h/b", f"<urlset {ns}>{many}</urlset>"), ("http://h/deep", f"<sitemapindex {ns}><sitemap><loc>deeper</loc></sitemap></sitemapindex>"), ("http://h/deeper", f"<urlset {ns}>{many}</urlset>"),
        ("http://h/bad", "<urlset><url>"), ("http://h/none", None), ("http://h/plain", f"<urlset>{many}</urlset>"), ("http://h/plain", f"<urlset>{many}</urlset>"),
        ("http://h/media", '<urlset xmlns:image="i" xmlns:video="v"><url><loc>http://h/m</loc><image:image><image:loc>1.png</image:loc></image:image><image:image><image:loc> 2.png</image:loc></image:image><video:video><video:loc>v.mp4</video:loc></video:video></url></urlset>'),
    ]
    df = spark.createDataFrame(files, "url string, xml string")
    now = F.lit("2024-07-01 00:00:00").cast("timestamp")

    def got(*roots, **options):
        rows = sitemaps.entries(df, spark.createDataFrame([(r,) for r in roots], "url string"), now=now, **options).collect()
        return sorted((r["sitemap"][9:], r["depth"], r["url"][9:], r["lastmod"], r["changefreq"], r["priority"], tuple(r["images"] or ()), tuple(r["videos"] or ())) for r in rows)

    x, old, y = ("a", 1, "x?a=1&b=2", "2024-06-01T00:00:00Z", "daily", 0.9, (), ()), ("a", 1, "old", "2001-01-01", None, None, (), ()), ("a", 1, "y", "?", None, None, (), ())
    assert got("http://h/root", min_lastmod_days=365) == sorted([x, y])
    whole = got("http://h/root")
    assert {r[0] for r in whole} == {"a", "b"} and len(whole) == 33 and old in whole
    assert len(got("http://h/root", max_urls=5)) == 8 and got("http://h/root", max_depth=0) == []
    assert [r[1] for r in got("http://h/deep", max_depth=1)] == [1] * 30 and got("http://h/deep", max_depth=0) == []
    assert got("http://h/bad", "http://h/none", "http://h/gone", None) == []
    assert len(got("http://h/plain")) == 30
    assert got("http://h/media")[0][6:] == (("1.png", "2.png"), ("v.mp4",))


def test_sitemap_candidates(spark):
    sites = spark.createDataFrame([("http://a",), ("http://b",)], "site string")
    files = spark.createDataFrame([("http://a", "x\nSitemap: http://a/one.xml\nsitemap:http://a/sitemap.xml\nSitemap:")], "site string, text string")
    got = {(r["site"], r["url"]) for r in sitemaps.candidates(sites, files).collect()}
    assert got == {(s, s + p) for s in ("http://a", "http://b") for p in sitemaps.COMMON_PATHS} | {("http://a", "http://a/one.xml")}


PLANTED = [
    "User-agent: *\nDisallow: /en/\nDisallow: /fr/1\n", "User-agent: *\nAllow: /en/1\nDisallow: /en/\n\nUser-agent: gleaner\nDisallow: /de/\nCrawl-delay: 3\n", "User-agent: gleaner\nUser-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow:\n", "", "# only\n# comments\n", "User-agent: other\nDisallow: /\n", "Disallow: /en/\nUser-agent: *\nDisallow: /es # spanish\nCrawl-delay: x\n", "user-agent: GLEANER\ndisallow: /en/5\nallow: /\ncrawl-delay: 10\n",
    "User-agent: *\nDisallow: /en/caf%C3%A9\nDisallow: /a b\nDisallow: /q?x=1\n",
]


def test_robots_like_the_standard_library(spark):
    pages = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url").distinct().collect()]
    targets = sorted({urls_target(u) for u in pages} | {"", "/", "/en/café", "/en/caf%C3%A9/x", "/a%20b", "/q?x=1", "/q?x=2", "/es", "/esp?y", "/en/1/2", "/de"})
    rows = [(f"h{k}", t) for k in range(len(PLANTED) + 1) for t in targets] + [(None, "/x")]
    files = spark.createDataFrame([(f"h{k}", t) for k, t in enumerate(PLANTED)], "site string, text string")
    df = spark.createDataFrame(rows, "host string, target string")
    for agent in ("Gleaner/2.0", "plain"):
        got = {(r["host"], r["target"]): (r["allowed"], r["delay"]) for r in robots.judged(df, "host", "target", robots.rules(files, agent), first=True).collect()}
        assert len(got) == len(rows) and got[None, "/x"] == (True, None) and got[f"h{len(PLANTED)}", "/en/1/2"] == (True, None)
        for k, text in enumerate(PLANTED):
            p = urllib.robotparser.RobotFileParser()
            # decoded, as the library quotes what a rule has quoted already
            p.parse(text.replace("%C3%A9", "é").splitlines())
            for t in targets:
                assert got[f"h{k}", t][0] == p.can_fetch(agent, f"http://h{t}"), (text, t, agent)
            delay = p.crawl_delay(agent)
            assert k in (7, 8) or {got[f"h{k}", t][1] for t in targets} == {None if delay is None else float(delay)}


def urls_target(url):
    rest = url.split("://", 1)[-1]
    return "/" + rest.partition("/")[2].split("#")[0]


def test_robots_wildcards_and_the_longest_rule(spark):
    text = "User-agent: *\nDisallow: /p/\nAllow: /p/open\nDisallow: /*.pdf$\nAllow: /p/*/free$\nDisallow: /*?*id=\nAllow: /same\nDisallow: /same\nDisallow: /a+b(c\nDisallow: *tail\n"
    want = {"/p/x": False, "/p/open/1": True, "/a.pdf": False, "/a.pdf?x": True, "/p/1/free": True, "/p/1/free/": False, "/z?id=1": False, "/z?x&id=2": False, "/same": True, "/a+b(c)": False, "/aab(c": True, "/other/tail/1": False, "": True}
    df = spark.createDataFrame([("h", t) for t in want], "host string, target string")
    got = {r["target"]: r["allowed"] for r in robots.judged(df, "host", "target", robots.rules(spark.createDataFrame([("h", text)], "site string, text string"), "any")).collect()}
    assert got == want


def test_crawl_is_the_queue(spark):
    r = random.Random(9)
    edges = [(a, r.randint(0, 300), k) for a in range(300) for k in range(r.randint(0, 14))]
    seeds = [5, 9, 200]
    for depth, pages in ((3, 50), (5, 1000), (2, 2), (0, 10)):
        links = {}
        for a, b, k in sorted(edges, key=lambda e: (e[0], e[2], e[1])):
            links.setdefault(a, []).append(b)
        queue, order = [(s, 0) for s in seeds], []
        seen = set(seeds)
        while queue and len(order) < pages:
            node, d = queue.pop(0)
            order.append((node, d, len(order) + 1))
            for b in links.get(node, [])[:10] if d < depth else []:
                if b not in seen:
                    seen.add(b)
                    queue.append((b, d + 1))
        got = graph.crawl(spark.createDataFrame([(s,) for s in seeds], "node long"), spark.createDataFrame(edges, "source long, target long, position int"), depth, pages).orderBy("rank").collect()
        assert [tuple(x) for x in got] == order
    assert graph.crawl(spark.createDataFrame([], "node long"), spark.createDataFrame(edges, "source long, target long, position int"), 2, 5).count() == 0


def test_crawl_takes_priority_within_a_depth(spark):
    edges = spark.createDataFrame([(0, 1, 0, 1), (0, 2, 1, 9), (0, 3, 2, 5)], "source long, target long, position int, priority int")
    got = graph.crawl(spark.createDataFrame([(0,)], "node long"), edges, 1, 3).orderBy("rank").collect()
    assert [x["node"] for x in got] == [0, 2, 3]


def test_addresses_relative_to_a_sitemap(spark):
    for base, ref in (("http://h/a/root", "b"), ("http://h/root", "/c/d"), ("https://h/x/y.xml", "http://o/z")):
        assert spark.range(1).select(urls.absolute(F.lit(ref), F.lit(base))).first()[0] == urljoin(base, ref)
