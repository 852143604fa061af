"""Expressions over HTML and JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, collapse, count_of

#: Page types in order, with the words that speak for them.
PAGE_TYPES = (
    ("product", ("price", "add to cart", "buy now", "sku", "product", "rating", "review")),
    ("article", ("article", "blog", "post", "published", "author", "read time")),
    ("review", ("review", "rating", "stars", "verified purchase", "pros", "cons")),
    ("listing", ("listing", "for sale", "rent", "price", "location", "bedrooms", "bathrooms")),
    ("job", ("job", "career", "position", "salary", "apply", "requirements")),
    ("event", ("event", "conference", "meetup", "webinar", "date", "venue", "ticket")),
)


def title(html: Column) -> Column:
    return collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def visible_text(html: Column) -> Column:
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return collapse(F.regexp_replace(bare, r"<[^>]+>", " "))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit("""href=["']([^"']+)["']"""), F.lit(1))


def meta_map(html: Column, attribute: str, prefix: str) -> Column:
    """Meta tags whose attribute begins with a prefix, as a map without it; the last of a name wins."""
    pattern = rf"""(?i)<meta\s+{attribute}=["']{prefix}([^"']+)["']\s+content=["']([^"']*)["']"""
    keys, values = (F.regexp_extract_all(html, F.lit(pattern), F.lit(k)) for k in (1, 2))
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return last


def json_ld(html: Column) -> Column:
    """Texts of the JSON-LD blocks that parse."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    return F.filter(F.transform(blocks, lambda b: F.trim(b)), lambda b: F.try_parse_json(b).isNotNull())


def page_type_scores(html: Column, url: Column) -> Column:
    """array<struct<score,order,type>>: twice each word's count in the page and thrice that in the URL."""
    h, u = F.lower(html), F.lower(url)
    out = []
    for k, (name, parts) in enumerate(PAGE_TYPES):
        score = F.lit(0)
        for p in parts:
            score = score + count_of(h, p) * 2 + count_of(u, p) * 3
        out.append(F.struct(score.cast("long").alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("type")))
    return F.array(*out)


def page_type(html: Column, url: Column) -> Column:
    """struct(score, order, type) of the best type, the first of equals."""
    return F.array_max(page_type_scores(html, url))


def css_text(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Texts of the innermost elements of a tag, and of a class if given."""
    cls = rf"""[^>]*class=["'][^"']*\b{css_class}\b[^"']*["']""" if css_class else ""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b{cls}[^>]*>(.*?)</{tag}>"), F.lit(1))
    return F.transform(found, lambda x: collapse(F.regexp_replace(x, r"<[^>]+>", "")))


#: Kinds of sites in order, with the words that speak for them.
SITE_KINDS = {
    "ecommerce": ("product", "cart", "checkout", "price", "buy now", "add to cart", "shop", "store"), "news": ("article", "news", "blog", "post", "published", "author", "headline"),
    "social": ("profile", "followers", "following", "tweet", "post", "share", "like"), "forum": ("thread", "forum", "reply", "topic", "discussion", "comment"),
    "documentation": ("documentation", "docs", "api reference", "guide", "tutorial"), "job": ("job", "career", "position", "hiring", "apply", "salary"),
    "real_estate": ("property", "rent", "sale", "bedroom", "bathroom", "sqft", "listing"), "travel": ("hotel", "flight", "booking", "vacation", "resort", "trip"),
    "classified": ("classified", "listing", "for sale", "wanted", "marketplace"),
}


def site_kind(html: Column) -> Column:
    """struct(score, order, kind) of the kind most of whose words a page holds, the first of equals; `unknown` without any."""

    def of(low: Column) -> Column:
        rows = []
        for k, (name, words) in enumerate(SITE_KINDS.items()):
            score = F.lit(0)
            for w in words:
                score = score + F.contains(low, F.lit(w)).cast("int")
            rows.append(F.struct(score.alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("kind")))
        return F.array_max(F.array(*rows))

    best = bound(F.lower(html), of)
    return F.when(best["score"] > 0, best).otherwise(F.struct(F.lit(0).alias("score"), F.lit(-99).alias("order"), F.lit("unknown").alias("kind")))
