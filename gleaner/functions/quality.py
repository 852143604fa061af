"""Quality scores of typed records as single expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

#: Weights of the dimensions and of their parts.
DIMENSIONS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "freshness": 0.15, "richness": 0.15}
COMPLETENESS = {"required": 0.3, "optional": 0.2, "content": 0.2, "media": 0.15, "metadata": 0.15}
#: Average content lengths and their score; counts of media and theirs.
CONTENT = ((500, 1.0), (200, 0.7), (100, 0.4), (50, 0.2))
MEDIA = ((5, 1.0), (3, 0.8), (1, 0.5))


def steps(value: Column, table: tuple[tuple[float, float], ...], below: float) -> Column:
    out = F.lit(below)
    for least, score in reversed(table):
        out = F.when(value >= least, score).otherwise(out)
    return out


def share(present: list[Column]) -> Column:
    """Share of the given conditions that hold."""
    total = F.lit(0)
    for p in present:
        total = total + F.coalesce(p.cast("int"), F.lit(0))
    return total / len(present)


def completeness(required: list[Column], optional: list[Column], content: Column, media: Column, metadata: list[Column]) -> Column:
    w = COMPLETENESS
    length = F.when(F.coalesce(F.length(content), F.lit(0)) == 0, 0.0).otherwise(steps(F.length(content), CONTENT, 0.1))
    score = share(required) * w["required"] + F.least(share(optional) * 1.5, F.lit(1.0)) * w["optional"] + length * w["content"] + steps(media, MEDIA, 0.1) * w["media"] + share(metadata) * w["metadata"]
    return F.least(score, F.lit(1.0))


def mean_of(checks: list[tuple[Column, Column]]) -> Column:
    """Share of the checks that apply and hold, 0.5 where none applies; each is (applies, holds)."""
    applies, holds = F.lit(0), F.lit(0)
    for a, h in checks:
        a = F.coalesce(a, F.lit(False))
        applies = applies + a.cast("int")
        holds = holds + (a & F.coalesce(h, F.lit(False))).cast("int")
    return F.when(applies > 0, holds / applies).otherwise(0.5)


def accuracy(prices: list, dates: list, urls: list, formats: list) -> Column:
    return F.least((mean_of(prices) + mean_of(dates) + mean_of(urls) + mean_of(formats)) * 0.25, F.lit(1.0))


#: Fixed value: the year from which a date is believed.
BELIEVED = 2000


def date_checks(dates: list[Column], published: Column, updated: Column, now: Column) -> list[tuple[Column, Column]]:
    """Checks for accuracy(): each date there is lies between the year BELIEVED and now, and the update after the publication."""
    own = [(d.isNotNull(), (d.cast("timestamp") <= now) & (F.year(d) >= BELIEVED)) for d in dates]
    return [*own, (published.isNotNull() & updated.isNotNull(), updated >= published)]


def url_checks(addresses: list[Column]) -> list[tuple[Column, Column]]:
    """Checks for accuracy(): each address there is has the form of one."""
    return [(F.coalesce(a != "", F.lit(False)), urls.valid_url(a)) for a in addresses]


def format_checks(emails: list[Column], rating: Column | None = None, currency: Column | None = None, known: tuple[str, ...] = ()) -> list[tuple[Column, Column]]:
    """Checks for accuracy(): e-mail addresses, a rating from 0 to 5, a known currency."""
    out = [(F.coalesce(e != "", F.lit(False)), urls.valid_email(e)) for e in emails]
    if rating is not None:
        out.append((rating.isNotNull(), rating.between(0, 5)))
    if currency is not None:
        out.append((F.coalesce(currency != "", F.lit(False)), currency.isin(*known)))
    return out


def overall(**dimensions: Column) -> Column:
    out = F.lit(0.0)
    for name, weight in DIMENSIONS.items():
        out = out + dimensions[name] * weight
    return out


def validity(errors: Column, warnings: Column) -> Column:
    """Score of a record's errors and warnings: 1, less 0.1 an error, less 0.02 a warning, never below 0."""
    return F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), 1 - 0.1 * errors) - 0.02 * warnings)


#: Weights of the parts of consistency, freshness and richness.
CONSISTENCY = {"internal": 0.5, "cross_field": 0.5}
FRESHNESS = {"recency": 0.6, "update_frequency": 0.4}
RICHNESS = {"detail_level": 0.4, "media_count": 0.3, "structured_data": 0.3}
#: Days at most and their score, for a record's age and for the time between publication and update; counts of
#: media (a video counts as two) and theirs.
RECENCY = ((1, 1.0), (7, 0.9), (30, 0.7), (90, 0.5), (365, 0.3))
UPDATES = ((1, 1.0), (7, 0.8), (30, 0.6))
VARIETY = ((10, 1.0), (5, 0.8), (3, 0.6), (1, 0.4))
#: A dimension's bound below which a record has an issue, and what it says.
ISSUES = {
    "completeness": (0.5, "Low field completeness"),
    "accuracy": (0.6, "Data accuracy issues detected"),
    "consistency": (0.6, "Internal consistency issues"),
    "freshness": (0.4, "Data may be stale"),
    "richness": (0.4, "Limited detail and media"),
}


def some(value: Column) -> Column:
    """Neither null nor zero."""
    return F.coalesce(value != 0, F.lit(False))


def contradictions(checks: list[tuple[Column, Column, float]], share_of: float, none: float) -> Column:
    """1 less a share of the issues per check; each check is (applies, fails, how much an issue counts); `none` without checks."""
    made, found = F.lit(0), F.lit(0.0)
    for applies, fails, counts in checks:
        made = made + applies.cast("int")
        found = found + F.when(applies & F.coalesce(fails, F.lit(False)), counts).otherwise(0.0)
    return F.when(made > 0, F.greatest(F.lit(0.0), 1 - found / made * share_of)).otherwise(none)


def consistency(price: Column, original: Column, discount: Column, rating: Column, reviews: Column, published: Column, updated: Column, brand: Column, name: Column, currency: Column, tagged: bool = True) -> Column:
    """Contradictions of prices, discount, rating and dates, and across brand and name; `tagged`: the type has category and tags."""
    priced, dated = some(price) & some(original), published.isNotNull() & updated.isNotNull()
    internal = contradictions(
        [
            (priced, price > original, 1.0),
            (priced & some(discount), F.abs(discount - (original - price) / F.nullif(original, F.lit(0)) * 100) > 5, 1.0),
            (F.coalesce((rating > 0) & (reviews == 0), F.lit(False)), F.lit(True), 1.0),
            (dated, updated < published, 1.0),
        ],
        0.5, 0.8,
    )
    named = F.coalesce((brand != "") & (name != ""), F.lit(False))
    no = F.lit(False)
    cross = contradictions([(F.lit(tagged), no, 0.0), (named, ~F.contains(F.lower(name), F.lower(brand)), 0.5), (F.coalesce(currency != "", no) & some(price), no, 0.0)], 0.3, 0.9)
    return F.least(internal * CONSISTENCY["internal"] + cross * CONSISTENCY["cross_field"], F.lit(1.0))


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 86_400_000_000


def upto(value: Column, table: tuple[tuple[float, float], ...], beyond: float) -> Column:
    out = F.lit(beyond)
    for most, score in reversed(table):
        out = F.when(value <= most, score).otherwise(out)
    return out


def freshness(now: Column, published: Column, updated: Column, *others: Column) -> Column:
    """Age of the latest date and how soon an update came; all are timestamps."""
    return freshness_of(days_between(F.greatest(published, updated, *others), now), days_between(published, updated))


def freshness_of(age: Column, gap: Column) -> Column:
    """freshness() from the days since the latest date and those from publication to update; null where there is none."""
    recency = F.when(age.isNull(), 0.3).otherwise(upto(age, RECENCY, 0.1))
    update = F.when(gap.isNull(), 0.5).otherwise(upto(gap, UPDATES, 0.4))
    return F.least(recency * FRESHNESS["recency"] + update * FRESHNESS["update_frequency"], F.lit(1.0))


def richness(details: list[Column], images: Column, videos: Column, structured: list[Column]) -> Column:
    """Details present (0.5 for a type without any), media, and whether anything structured is there."""
    detail = F.least(share(details) * 1.5, F.lit(1.0)) if details else F.lit(0.5)
    any_of = F.lit(False)
    for s in structured:
        any_of = any_of | F.coalesce(s, F.lit(False))
    media = steps(F.coalesce(images, F.lit(0)) + F.coalesce(videos, F.lit(0)) * 2, VARIETY, 0.1)
    return F.least(detail * RICHNESS["detail_level"] + media * RICHNESS["media_count"] + F.when(any_of, 1.0).otherwise(0.3) * RICHNESS["structured_data"], F.lit(1.0))


def issues(**dimensions: Column) -> Column:
    """What is wrong, by dimension: array of texts."""
    return F.array_compact(F.array(*[F.when(dimensions[k] < least, F.lit(said)) for k, (least, said) in ISSUES.items() if k in dimensions]))
