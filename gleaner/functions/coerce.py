"""Lenient conversions of single values; what doesn't convert becomes null, or stays where that is said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words for true and false.
TRUE = ("true", "yes", "y", "1", "on", "enabled", "active", "t", "enable", "allow")
FALSE = ("false", "no", "n", "0", "off", "disabled", "inactive", "f", "disable", "deny", "block")


def boolean(c: Column) -> Column:
    low = F.lower(F.trim(c))
    number = c.try_cast("double")
    return F.when(low.isin(*TRUE), True).when(low.isin(*FALSE), False).when(number.isNotNull(), number != 0)


def phone(c: Column) -> Column:
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) == 10, F.concat(F.lit("+1"), d)).when(F.length(d) >= 10, F.concat(F.lit("+"), d)).otherwise(c)


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def number(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")


def measurement(c: Column) -> Column:
    """struct(value, unit): a number and the unit after it, or the digits alone."""
    value, unit = (F.regexp_extract(c, r"([0-9.,]+)\s*([a-zA-Z°%µμ]+)", k) for k in (1, 2))
    with_unit = F.when(value != "", F.replace(value, F.lit(","), F.lit("")).try_cast("double"))
    return F.struct(F.coalesce(with_unit, number(c)).alias("value"), F.when(with_unit.isNotNull(), F.lower(unit)).alias("unit"))


def kind(c: Column) -> Column:
    """What a literal is: null, boolean, integer, float or string."""
    low = F.lower(F.trim(c))
    return F.when(low.isin("none", "null", ""), "null").when(low.isin("true", "false"), "boolean").when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), "integer").when(c.try_cast("double").isNotNull(), "float").otherwise("string")


def coerced(c: Column, to: str) -> Column:
    """string, number, integer or boolean with the default '', 0.0, 0 or false."""
    bare = F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    return {"string": F.coalesce(c, F.lit("")), "number": F.coalesce(bare, F.lit(0.0)), "integer": F.coalesce(F.floor(bare).cast("long"), F.lit(0)), "boolean": F.lower(c).isin("true", "1", "yes")}[to]


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt))


def retryable(status: Column) -> Column:
    return status.isin(408, 425, 429, 500, 502, 503, 504)


#: Parts of a field name, in order, and what the field becomes.
FIELD_RULES = (("email", email), ("phone", phone), ("price", number), ("amount", number), ("url", F.trim), ("active", boolean), ("enabled", boolean), ("name", lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))))


def by_name(name: str):
    """The conversion that a field's name asks for, or None."""
    return next((f for part, f in FIELD_RULES if part in name.lower()), None)


def by_rule(rule: str, c: Column) -> Column:
    """A named conversion, `regex:pattern=>to`, `map:a=b,c=d`, `enum:a,b` (others null) or `range:low,high` (others null)."""
    head, _, rest = rule.partition(":")
    if head == "regex":
        pattern, _, to = rest.partition("=>")
        return F.regexp_replace(c, pattern, to)
    if head == "map":
        known = F.create_map(*[F.lit(x) for pair in rest.split(",") if "=" in pair for x in pair.split("=", 1)])
        return F.coalesce(F.try_element_at(known, c), c)
    if head == "enum":
        return F.when(c.isin(*rest.split(",")), c)
    if head == "range":
        low, high = map(float, rest.split(","))
        return F.when(c.between(low, high), c)
    return {"lower": F.lower, "upper": F.upper, "strip": F.trim, "boolean": boolean, "phone": phone, "email": email, "number": number}[head](c)
