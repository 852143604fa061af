"""Sitemaps: entries of a file, recursion through indexes with depth, address and age caps, and where sitemaps may lie."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .scratch import checkpointed
from .tables import robots_sitemaps

#: Where a site's sitemap commonly is.
COMMON_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml")
MEDIA = "array<struct<loc: string>>"
FILE = f"sitemap array<struct<loc: string, lastmod: string>>, url array<struct<loc: string, lastmod: string, changefreq: string, priority: string, image: {MEDIA}, video: {MEDIA}>>"


def parsed(xml: Column) -> Column:
    """A sitemap file or index as struct(sitemap, url); name spaces are left out, what is no XML has null fields."""
    return F.from_xml(xml, FILE, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})


def filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def young(lastmod: Column, now: Column | None, days: int | None) -> Column:
    """Whether an entry passes the age cap; one without a time that can be read does."""
    if not days:
        return F.lit(True)
    at = F.coalesce(*[F.try_to_timestamp(lastmod, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")])
    return F.coalesce(at >= now - F.make_dt_interval(F.lit(days)), F.lit(True))


def entries(files: DataFrame, roots: DataFrame, max_depth: int = 10, max_urls: int = 50_000, min_lastmod_days: int | None = None, now: Column | None = None) -> DataFrame:
    """Entries that sitemap files (url, xml) under the roots (url) list: sitemap, depth, url, lastmod, changefreq, priority,
    images, videos and place. An index leads to its files, by addresses relative to its own; a file is read once, at its least
    depth, and none beyond max_depth; of a file the first max_urls entries count that are young enough. What a round finds is
    checkpointed, so lineage doesn't grow with depth."""
    level = roots.select(F.col("url").alias("at")).where("at is not null").distinct()
    known = files.select(F.col("url").alias("at"), "xml").dropDuplicates(["at"])
    seen, read = None, []
    for depth in range(max_depth + 1):
        opened = level.join(known, "at").select("at", parsed(F.col("xml")).alias("x"))
        opened = checkpointed(opened.select("at", F.lit(depth).alias("depth"), "x.sitemap", "x.url"))
        read.append(opened)
        seen = level if seen is None else seen.unionByName(level)
        children = opened.select("at", F.explode("sitemap").alias("s")).select("at", filled(F.col("s.loc")).alias("loc"), F.trim("s.lastmod").alias("lastmod")).where("loc is not null")
        children = children.where(young(F.col("lastmod"), now, min_lastmod_days)).select(urls.absolute(F.col("loc"), F.col("at")).alias("at")).distinct()
        level = checkpointed(children.join(seen, "at", "left_anti"))
        seen = checkpointed(seen)
        if level.isEmpty():
            break
    listed = reduce(DataFrame.unionByName, read).select(F.col("at").alias("sitemap"), "depth", F.posexplode("url").alias("place", "u"))
    listed = listed.select(
        "sitemap", "depth", "place", filled(F.col("u.loc")).alias("url"), filled(F.col("u.lastmod")).alias("lastmod"), filled(F.col("u.changefreq")).alias("changefreq"), F.trim("u.priority").try_cast("double").alias("priority"),
        *[F.filter(F.transform(f"u.{k}", lambda m: F.trim(m["loc"])), lambda x: x != "").alias(f"{k}s") for k in ("image", "video")],
    ).where(F.col("url").isNotNull() & young(F.col("lastmod"), now, min_lastmod_days))
    # a file's entries are one row of its table: counting them needs no window over other files'
    kept = listed.groupBy("sitemap", "depth").agg(F.slice(F.array_sort(F.collect_list(F.struct("place", "url", "lastmod", "changefreq", "priority", "images", "videos"))), 1, max_urls).alias("e"))
    return kept.select("sitemap", "depth", F.explode("e").alias("e")).select("sitemap", "depth", "e.*")


def candidates(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """(site, url) of all sitemaps that sites (site: scheme and host) may have: what their robots files (site, text) name, then
    the common paths."""
    named = robots.select("site", F.explode(robots_sitemaps(F.col("text"))).alias("url")).where("url <> ''")
    usual = sites.select("site", F.explode(F.array(*[F.lit(p) for p in COMMON_PATHS])).alias("p")).select("site", F.concat("site", "p").alias("url"))
    return named.unionByName(usual).distinct()
