"""Record operators: validation with errors and warnings, types, set-level quality, upserts, retention and eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import quality, urls
from ..functions.text import is_blank, is_zero
from .ordering import upto


def validated(df: DataFrame, errors: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """df with errors, warnings (names of the rules that hold), valid and score. The arrays are made in a projection of their
    own; what follows reads them."""
    names = lambda rules: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])) if rules else F.array().cast("array<string>")
    out = df.withColumns({"errors": names(errors), "warnings": names(warnings)})
    return out.withColumns({"valid": F.size("errors") == 0, "score": quality.validity(F.size("errors"), F.size("warnings"))})


#: Fields that a type must have; those of contents, addresses, e-mail, prices and dates; lengths of a content.
REQUIRED = {"product": ("name", "price", "currency"), "article": ("title", "content"), "review": ("rating", "content"), "listing": ("title", "price")}
CONTENTS, PRICES = ("content", "description", "body"), ("price", "original_price", "sale_price", "discount_pct")
ADDRESSES, EMAILS = ("source_url", "url", "link", "image", "thumbnail", "author_url"), ("email", "author_email", "contact_email")
DATES = ("scraped_at", "published_at", "updated_at", "posted_at", "release_date")
SHORT, LONG, HIGH, OLD = 10, 1_000_000, 1_000_000, 2000


def typed_rules(fields: dict[str, Column], kind: str, now: Column) -> tuple[dict[str, Column], dict[str, Column]]:
    """Errors and warnings (name: condition) for validated(), of a record of a type (product, article, review, listing or
    generic) whose fields are given by name: numbers for prices, ratings, counts and places, timestamps for dates."""
    errors: dict[str, Column] = {}
    warnings: dict[str, Column] = {}
    has = lambda *names: all(n in fields for n in names)
    said = lambda n: F.coalesce(fields[n] != "", F.lit(False))
    for n in REQUIRED.get(kind, ()):
        errors[f"{n} missing"] = is_blank(fields[n]) | is_zero(fields[n]) if has(n) else F.lit(True)
    for n in filter(has, CONTENTS):
        warnings[f"{n} short"] = said(n) & (F.length(fields[n]) < SHORT)
        warnings[f"{n} long"] = F.length(fields[n]) > LONG
    for names, valid in ((ADDRESSES, urls.valid_url), (EMAILS, urls.valid_email)):
        for n in filter(has, names):
            errors[f"{n} format"] = said(n) & ~valid(fields[n])
    for n in filter(has, PRICES):
        errors[f"{n} negative"] = fields[n] < 0
        warnings[f"{n} high"] = fields[n] > HIGH
    for n in filter(has, DATES):
        errors[f"{n} in the future"] = fields[n] > now
        warnings[f"{n} old"] = F.year(fields[n]) < OLD
    if has("published_at", "updated_at"):
        errors["updated_at before published_at"] = fields["updated_at"] < fields["published_at"]
    if kind == "product" and has("price", "original_price", "discount_pct"):
        price, before, stated = fields["price"], fields["original_price"], fields["discount_pct"]
        warnings["discount_pct mismatch"] = (price != 0) & (before > price) & (stated != 0) & (F.abs(stated - (before - price) / F.nullif(before, F.lit(0)) * 100) > 1)
    if kind in ("product", "listing") and has("price"):
        errors["price not positive"] = fields["price"] < 0
    if kind == "product" and has("rating"):
        errors["rating range"] = ~fields["rating"].between(0, 5)
    if kind == "product" and has("images"):
        errors["images format"] = F.exists(fields["images"], lambda u: (u != "") & ~urls.valid_url(u))
    if kind == "article" and has("word_count"):
        warnings["word_count low"] = (fields["word_count"] != 0) & (fields["word_count"] < 50)
    if kind == "article" and has("reading_time_min"):
        warnings["reading_time_min short"] = (fields["reading_time_min"] != 0) & (fields["reading_time_min"] < 1)
    if kind == "review" and has("rating"):
        errors["rating range"] = (fields["rating"] < 0) | (fields["rating"] > fields.get("max_rating", F.lit(5)))
    if kind == "review" and has("helpful_votes", "total_votes"):
        errors["votes"] = fields["helpful_votes"] > fields["total_votes"]
    for n, most in (("latitude", 90), ("longitude", 180)):
        if kind == "listing" and has(n):
            errors[f"{n} range"] = ~fields[n].between(-most, most)
    return errors, warnings


def missing(df: DataFrame, *fields: str) -> DataFrame:
    """Fields that some row lacks: one aggregate over all, then a row a field."""
    row = df.agg(*[F.coalesce(F.bool_or(is_blank(F.col(f))), F.lit(False)).alias(f) for f in fields])
    return row.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("lacks")) for f in fields])).alias("f")).where("f.lacks").select("f.field")


def item_type(fields: Column) -> Column:
    """Type of a record by the fields it has (an array of names)."""
    has = lambda n: F.array_contains(fields, n)
    return F.when(has("price") & has("name"), "product").when(has("rating"), "review").when(has("content") & has("title"), "article").when(has("price") & has("title"), "listing").otherwise("generic")


def completeness(df: DataFrame) -> Column:
    """Share of cells neither null nor empty."""
    total = F.lit(0)
    for c in df.columns:
        total = total + F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0)
    return F.sum(total) / (F.count("*") * len(df.columns))


def duplicate_rate(*keys: str) -> Column:
    return 1 - F.count_distinct(F.struct(*keys)) / F.count("*")


def upserted(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Rows of old with those of new put over them by key; null values of new leave what is there."""
    o, n = old.alias("o"), new.alias("n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    return o.join(n, on, "full").select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def newest(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("__r") <= n).drop("__r")


def evicted(df: DataFrame, key: str, size: str, limit: int, low: float = 0.8) -> DataFrame:
    """df with `gone`: if all sizes exceed the limit, the oldest go until at most `low` of it is left."""
    total = df.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        return df.withColumn("gone", F.lit(False))
    return upto(df, key, F.col(size), "__upto").withColumn("gone", F.col("__upto") - F.col(size) < total - limit * low).drop("__upto")


def evicted_share(df: DataFrame, key: str, share: float) -> DataFrame:
    """df with `gone` for the oldest share of rows."""
    cut = int(df.count() * share)
    return upto(df, key, F.lit(1), "__n").withColumn("gone", F.col("__n") <= cut).drop("__n")


def run_statistics(df: DataFrame, valid: Column, key: str, order: str, quality: Column, least: float) -> tuple[DataFrame, Observation]:
    """What a run keeps of df, and what it says about the rest when it is written: processed, valid, invalid, duplicates and
    dropped, taken in the pass that does the work. Invalid rows go first; of valid ones with a key the first by order stays;
    then those below the least quality go. A null key is no key."""
    flagged = df.withColumn("__valid", F.coalesce(valid, F.lit(False)))
    heads = flagged.where(F.col("__valid") & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    told = flagged.join(heads, F.col("__valid") & (F.col(key) == F.col("__key")), "left")
    told = told.withColumn("__twice", F.col("__valid") & F.coalesce(F.col(order) > F.col("__first"), F.lit(False)))
    told = told.withColumn("__low", F.col("__valid") & ~F.col("__twice") & F.coalesce(quality < least, F.lit(True)))
    seen = Observation("run")
    keeps = F.col("__valid") & ~F.col("__twice") & ~F.col("__low")
    counts = {"processed": keeps, "valid": F.col("__valid"), "invalid": ~F.col("__valid"), "duplicates": F.col("__twice"), "dropped": F.col("__low")}
    return told.observe(seen, *[F.count_if(c).alias(k) for k, c in counts.items()]).where(keeps).drop("__valid", "__key", "__first", "__twice", "__low"), seen
