"""Text expressions: cleaning, keys, fingerprints, lexicons, entities and classification by fixed patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words left out of title keys.
TITLE_STOPWORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: Sentiment lexicons.
POSITIVE = ("good", "great", "excellent", "amazing", "love", "best", "awesome", "fantastic", "perfect", "wonderful")
NEGATIVE = ("bad", "terrible", "awful", "hate", "worst", "poor", "disappointing", "horrible", "useless", "broken")
#: Entity patterns.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b"
URL = r"https?://[^\s]+"
#: Failure categories in order, each with the parts of a message that name it, its severity and whether to retry.
FAILURES = (
    ("network", ("timeout", "connection_refused", "connection_reset", "dns_failure", "ssl_error", "proxy_error", "certificate_verify_failed", "connection_aborted", "connection_closed"), "high", True),
    ("http", ("403", "429", "500", "502", "503", "504", "401", "400", "404", "408"), "high", True),
    ("blocking", ("captcha", "challenge", "access_denied", "blocked", "rate_limit", "waf", "cloudflare", "akamai", "incapsula", "perimeterx", "datadome", "please_verify", "unusual_traffic", "robot_check", "bot_detected", "access_forbidden", "ip_blocked", "geo_blocked"), "critical", False),
    ("content", ("empty_response", "zero_bytes", "redirect_loop", "login_required", "paywall", "geo_restricted", "age_gate", "membership_required", "javascript_required", "cookies_required"), "medium", False),
    ("parsing", ("schema_validation_failed", "no_matching_selectors", "json_decode_error", "encoding_error", "html_parse_error", "xpath_not_found", "css_selector_failed", "regex_no_match", "empty_selector_result"), "medium", False),
    ("engine", ("browser_crash", "out_of_memory", "process_killed", "cdp_disconnected", "playwright_timeout", "context_destroyed", "navigation_timeout", "script_execution_failed", "element_not_found", "stale_element"), "high", True),
    ("quality", ("completeness_below_threshold", "accuracy_below_threshold", "duplicate_rate_high", "staleness_high", "schema_mismatch", "data_integrity_failed", "enrichment_failed"), "medium", False),
)


def is_blank(c: Column) -> Column:
    """Missing as the record operators mean it: null, or nothing but white space."""
    return c.isNull() | ~c.cast("string").rlike(r"\S")


def is_zero(c: Column) -> Column:
    """Whether a value, read as text, is a zero; false for null. No cast is tried, as one that fails is dear."""
    return F.coalesce(c.cast("string").rlike(r"^\s*[+-]?(?:0+\.?0*|\.0+)(?:[eE][+-]?\d+)?\s*$"), F.lit(False))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", ""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def title_key(c: Column) -> Column:
    plain = collapse(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""))
    stop = F.array(*[F.lit(w) for w in TITLE_STOPWORDS])
    return F.array_join(F.filter(F.split(plain, " "), lambda w: ~F.array_contains(stop, w)), " ")


def fingerprint(c: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text, or of its first and last 500 characters if over 1000."""
    ends = F.concat(F.substring(c, 1, 500), F.right(c, F.lit(500)))
    return F.substring(F.sha2(F.when(F.length(c) > 1000, ends).otherwise(c), 256), 1, 16)


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, also where use() names it in a lambda."""
    return F.transform(F.array(value), use)[0]


def shingles(words: Column, n: int) -> Column:
    """Word n-grams; the words together where there are fewer than n."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, many).otherwise(F.array(F.array_join(w, " ")))

    return bound(words, of)


def sentiment(c: Column) -> Column:
    """struct(label, score, positive, negative) from the distinct words that the lexicons hold."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    hits = lambda lexicon: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in lexicon])))
    p, n = hits(POSITIVE), hits(NEGATIVE)
    label = F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")
    return F.struct(label.alias("label"), F.bround((p - n) / F.greatest(F.lit(1), p + n), 3).alias("score"), p.alias("positive"), n.alias("negative"))


def emails(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(EMAIL), F.lit(0)))


def phones(c: Column) -> Column:
    parts = [F.regexp_extract_all(c, F.lit(PHONE), F.lit(k)) for k in (1, 2, 3)]
    return F.array_distinct(F.transform(F.arrays_zip(*[p.alias(n) for p, n in zip(parts, "abc", strict=True)]), lambda z: F.concat_ws("-", z["a"], z["b"], z["c"])))


def links(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(URL), F.lit(0)))


def keywords(c: Column, stopwords: tuple[str, ...] = TITLE_STOPWORDS, most: int = 10) -> Column:
    """The first distinct words of over two characters that are neither stop words nor digits."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in stopwords])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2) & ~w.rlike("^[0-9]+$"))
    return F.slice(F.array_distinct(kept), 1, most)


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def count_of(c: Column, part: str) -> Column:
    """How often a part stands in a text, none overlapping."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")


def failure(message: Column) -> Column:
    """struct(category, severity, retry): the first category of which some pattern is in the message."""
    low, out = F.lower(message), F.struct(F.lit("unknown").alias("category"), F.lit("medium").alias("severity"), F.lit(True).alias("retry"))
    for name, parts, severity, retry in reversed(FAILURES):
        hit = low.rlike("|".join(parts))
        out = F.when(hit, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"), F.lit(retry).alias("retry"))).otherwise(out)
    return out


def error_kind(message: Column) -> Column:
    has = message.contains
    return F.when(has("timeout"), "timeout").when(has("connection"), "network_error").when(has("403") | has("429"), "http_error").when(has("captcha") | has("blocked"), "blocking").otherwise("engine_error")


def sanitized(c: Column, most: int = 10_000) -> Column:
    """Text without control characters, tags and script addresses, cut at a length."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"<[^>]+>", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?i)javascript:", "")), 1, most)


#: What in a body counts as script, and as SQL.
XSS, SQL = r"(?i)<script|javascript:|on\w+\s*=", r"(?i)\b(union|select|insert|update|delete|drop)\b"


def threats(c: Column) -> Column:
    """struct(xss, sql): whether a body shows signs of script or SQL injection."""
    return F.struct(c.rlike(XSS).alias("xss"), c.rlike(SQL).alias("sql"))
