"""Date expressions against a stated base time; months are 30 days and years 365."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Absolute forms in the order they are tried (day before month).
FORMS = ("yyyy-M-d'T'H:m:sXXX", "yyyy-M-d'T'H:m:s.SSSXXX", "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d", "d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyy/M/d", "yyyy.M.d")
#: Units of "n units ago" in seconds.
UNITS = (("sec|second|seconds", 1), ("min|minute|minutes", 60), ("hr|hour|hours", 3600), ("day|days", 86400), ("week|weeks", 604800), ("month|months", 2592000), ("year|years", 31536000))
#: Ages in days and their score.
RECENCY = ((1, 1.0), (7, 0.9), (30, 0.7), (90, 0.5), (365, 0.3))


def absolute(text: Column, forms: tuple[str, ...] = FORMS) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms])


def shifted(base: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_micros(base) / 1e6 + seconds)


def relative(text: Column, base: Column) -> Column:
    low = F.trim(F.lower(text))
    midnight = F.date_trunc("day", base)
    hour, minute, half = (F.regexp_extract(low, r"([0-9]{1,2}):([0-9]{2})\s*(am|pm)?", k) for k in (1, 2, 3))
    clock = F.when(hour == "", F.lit(0)).otherwise((hour.try_cast("int") % 12 + F.when(half == "pm", 12).when(half == "am", 0).otherwise(F.when(hour.try_cast("int") >= 12, 12).otherwise(0))) * 3600 + minute.try_cast("int") * 60)
    day = lambda n: shifted(midnight, n * 86400 + clock)
    weekday = F.weekday(base)
    out = F.when(low.contains("just now"), base).when(low.contains("today"), day(0)).when(low.contains("yesterday"), day(-1)).when(low.contains("tomorrow"), day(1))
    for names, seconds in UNITS:
        many = F.regexp_extract(low, rf"([0-9]+)\s*(?:{names})\s*ago", 1)
        out = out.when(many != "", shifted(base, -many.try_cast("long") * seconds))
    return out.when(low.contains("this week"), shifted(base, -weekday * 86400)).when(low.contains("last week"), shifted(base, -(weekday + 7) * 86400)).when(low.contains("next week"), shifted(base, (7 - weekday) * 86400))


def normalized(text: Column, base: Column) -> Column:
    """Relative, else absolute, else the base time."""
    return F.coalesce(relative(text, base), absolute(text), base)


def recency(then: Column, base: Column) -> Column:
    days = F.floor((F.unix_seconds(base) - F.unix_seconds(then.cast("timestamp"))) / 86400)
    out = F.lit(0.1)
    for most, score in reversed(RECENCY):
        out = F.when(days <= most, score).otherwise(out)
    return out


def epoch(value: Column) -> Column:
    """Seconds, or milliseconds where over 1e12, as a time."""
    return F.when(value > 1e12, F.timestamp_millis(value)).otherwise(F.timestamp_seconds(value))


def expired(created: Column, base: Column, ttl_seconds: int) -> Column:
    return F.unix_seconds(created.cast("timestamp")) < F.unix_seconds(base) - ttl_seconds


#: Forms of dates with the month first where that is in doubt, in the order they are tried.
MONTH_FIRST = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d-M-yyyy", "yyyy/M/d", "d.M.yyyy", "d MMM yyyy", "MMM d, yyyy")


def month_first(text: Column, base: Column) -> Column:
    """A text as a time: ISO forms, seconds (10 digits) or milliseconds (13) since 1970, dates with the month first, or a time
    before the base; null for anything else."""
    bare = F.trim(text)
    number = F.when(bare.rlike("^[0-9]{10}$|^[0-9]{13}$"), bare).try_cast("long")
    ago = F.when(F.lower(bare).contains("a moment ago"), shifted(base, F.lit(-30))).when(bare.rlike(r"(?i)ago|just now"), relative(bare, base))
    return F.coalesce(F.when(F.length(bare) == 13, F.timestamp_millis(number)).when(F.length(bare) == 10, F.timestamp_seconds(number)), absolute(bare, MONTH_FIRST), ago)
