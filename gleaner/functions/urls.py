"""URL expressions: parts, keys, classes and safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that canonical URLs lose (a final * stands for any ending).
TRACKING = ("utm_*", "fbclid", "gclid", "ref", "source")
#: Page classes in order, with the parts of a URL that name them.
PAGE_CLASSES = (
    ("product", ("/product/", "/item/", "/p/")),
    ("category", ("/category", "/collection", "/c/")),
    ("search", ("/search", "/s?")),
    ("cart", ("/cart", "/checkout")),
    ("account", ("/account", "/profile", "/dashboard", "/settings")),
    ("login", ("/login", "/signin")),
    ("register", ("/register", "/signup")),
    ("article", ("/article", "/blog", "/post/", "/news/")),
    ("api", ("/api/", "/graphql", "/v1/", "/v2/")),
)
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where there is none."""
    return F.regexp_extract(url, PARTS, number)


def canonical(url: Column, strip: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme, host and path, without tracking parameters and fragment."""
    pattern = "^(?:" + "|".join(s[:-1] + "[^=]*" if s.endswith("*") else s for s in strip) + ")(?:=|$)"
    kept = F.array_join(F.filter(F.split(part(url, 4), "&"), lambda p: (p != "") & ~p.rlike(pattern)), "&")
    return F.concat(F.lower(part(url, 1)), F.lit("://"), F.lower(part(url, 2)), F.lower(part(url, 3)), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def strict_key(url: Column) -> Column:
    """No scheme, www, final slashes or query, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?i)^https?://", ""), r"(?i)^www\.", ""), "/+$", "")
    return F.lower(F.substring_index(bare, "?", 1))


def semantic_key(url: Column) -> Column:
    """https, no www, no fragment, no final slashes."""
    bare = F.replace(F.replace(F.regexp_replace(url, "#.*$", ""), F.lit("http://"), F.lit("https://")), F.lit("https://www."), F.lit("https://"))
    return F.regexp_replace(bare, "/+$", "")


def domain(url: Column) -> Column:
    return F.lower(part(url, 2))


def page_class(url: Column) -> Column:
    low, out = F.lower(url), F.lit("other")
    for name, parts in reversed(PAGE_CLASSES):
        hit = F.lit(False)
        for p in parts:
            hit = hit | low.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def absolute(link: Column, base: Column) -> Column:
    """A link against the URL of its page, without fragment."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.concat(root, F.regexp_replace(F.when(part(base, 3) == "", F.lit("/")).otherwise(part(base, 3)), "[^/]*$", ""))
    made = F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).when(link.startswith("#") | (link == ""), base).when(link.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), link)).otherwise(F.concat(folder, link))
    return F.regexp_replace(made, "#.*$", "")


def next_page(url: Column) -> Column:
    """The URL with its page parameter counted up; a first page becomes the second."""
    page = F.regexp_extract(url, r"[?&]page=([0-9]+)", 1)
    bare = F.regexp_replace(url, "#.*$", "")
    grown = F.concat(F.regexp_extract(bare, r"^(.*[?&]page=)[0-9]+", 1), (F.expr("1") + page.try_cast("long")).cast("string"), F.regexp_extract(bare, r"[?&]page=[0-9]+(.*)$", 1))
    return F.when(page != "", grown).otherwise(F.concat(bare, F.when(bare.contains("?"), "&page=2").otherwise("?page=2")))


def valid_url(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[^\s/$.?#].[^\s]*$")


def valid_email(c: Column) -> Column:
    return c.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")


def suspicious(url: Column) -> Column:
    return url.rlike(r"(?i)\.(exe|bat|sh|php|jsp|asp)(\?|$)|(javascript|data|vbscript):|(%[0-9a-fA-F]{2}){5,}")


def file_stem(url: Column) -> Column:
    """Host with underscores for dots, then the path's letters and digits (50 at most); 100 characters at most."""
    host = F.replace(domain(url), F.lit("."), F.lit("_"))
    path = F.substring(F.regexp_replace(F.regexp_replace(part(url, 3), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 50)
    return F.substring(F.when(path == "", host).otherwise(F.concat_ws("_", host, path)), 1, 100)


def with_scheme(value: Column) -> Column:
    """An address without white space at its ends, https before it where it has no scheme; null where that has no host."""
    bare = F.regexp_replace(value, r"^\s+|\s+$", "")
    full = F.when(bare.rlike("^(https?://|ftp://|mailto:)"), bare).when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).otherwise(F.concat(F.lit("https://"), bare))
    return F.when((bare != "") & (part(full, 1) != "") & (part(full, 2) != ""), full)
