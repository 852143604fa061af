"""Set-level quality of records without a schema, held as VARIANT: each record its own fields, each field its own types.

A record that is no JSON object (or no JSON) counts as one without fields. Types go by their Python names. JSON numbers keep
no mark of how they were written: one with a fraction of zero is a float where it has fewer than 19 digits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: Weights of the composite, fields that hold dates, fields that name a record.
WEIGHTS = {
    "completeness": 0.25, "accuracy": 0.20, "duplicates": 0.15, "validity": 0.10, "normalization": 0.10, "freshness": 0.10, "consistency": 0.10, "reliability": 0.05,
    "adherence": 0.05, "anomaly": 0.05,
}
DATE_FIELDS = ("created", "updated", "published", "modified", "timestamp", "date", "created_at", "updated_at")
ID_FIELDS = ("id", "sku", "uuid")
#: Scores by number of types, in a field's type consistency and in its share of the whole's.
ONE_TYPE, TWO_TYPES, MORE_TYPES, MIXED = 1.0, 0.7, 0.3, 0.5
#: Odd values of text.
INJECTION, REPEATED, SCRIPT = r"(?i)(union|select|insert|delete|drop|exec)\s", r"(.)\1{10,}", "<script"


def kind(value: Column) -> Column:
    """Python's name of a JSON value's type; null for a JSON null."""
    t = F.schema_of_variant(value)
    whole = F.regexp_extract(t, r"^DECIMAL\((\d+),0\)$", 1)
    number = F.when((t == "BIGINT") | (whole.try_cast("int") >= 19), "int").when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
    return F.when(t == "VOID", F.lit(None)).when(t == "STRING", "str").when(t == "BOOLEAN", "bool").when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "dict").otherwise(number)


def fields(record: Column) -> Column:
    """array<struct<key, kind, text>> of a record's fields; text is null for what is no string."""
    entries = F.map_entries(F.try_variant_get(record, "$", "map<string,variant>"))
    typed = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), kind(e["value"]).alias("kind"), e["value"].alias("value")))
    text = lambda e: F.when(e["kind"] == "str", F.try_variant_get(e["value"], "$", "string"))
    made = F.transform(typed, lambda e: F.struct(e["key"].alias("key"), e["kind"].alias("kind"), text(e).alias("text")))
    return F.coalesce(made, F.array().cast("array<struct<key:string,kind:string,text:string>>"))


def alike(a: Sequence[str], left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in a], F.lit(True))


def field_profiles(records: DataFrame, by: Sequence[str], record: str) -> DataFrame:
    """A row for each group and field: present (records in which it isn't null), types (sorted), presence, consistency and
    type_consistency. A field is one key of a partial aggregate, whatever the number of records that have it."""
    items = records.select(*by, F.explode(fields(F.col(record))).alias("f"))
    found = items.groupBy(*by, F.col("f.key").alias("field")).agg(F.count("f.kind").alias("present"), F.array_sort(F.collect_set("f.kind")).alias("types"))
    many = records.groupBy(*by).agg(F.count("*").alias("items"))
    joined = found.alias("f").join(many.alias("m"), alike(by, "f", "m")).select(*[f"f.{c}" for c in by], "field", "present", "types", "items")
    presence, n = F.col("present") / F.col("items"), F.size("types")
    return joined.select(
        *by, "field", "present", "types", presence.alias("presence"), ((presence + F.when(n <= 1, ONE_TYPE).otherwise(MIXED)) / 2).alias("consistency"),
        F.when(n <= 1, ONE_TYPE).when(n == 2, TWO_TYPES).otherwise(MORE_TYPES).alias("type_consistency"),
    )


def consistency(profiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """A row for each group that has fields: the mean of how often, and in how few types, they come."""
    return profiles.groupBy(*by).agg((F.avg("presence") + F.avg(F.when(F.size("types") <= 1, ONE_TYPE).otherwise(MIXED))).alias("twice")).select(*by, (F.col("twice") / 2).alias("consistency"))


def total(items: Column, of) -> Column:
    """Sum of of(item) over an array."""
    return F.aggregate(items, F.lit(0), lambda s, x: s + F.coalesce(of(x).cast("int"), F.lit(0)))


def reliability(f: Column) -> Column:
    """A record's score by what its values show: an id, an address, structure; less where its words repeat."""
    texts = F.array_join(F.transform(F.filter(f, lambda x: x["text"].isNotNull()), lambda x: x["text"]), " ")
    words = F.filter(F.split(texts, r"\s+"), lambda w: w != "")
    bonus = lambda condition, by: F.when(condition, by).otherwise(0.0)
    score = (
        0.5 + bonus(F.exists(f, lambda x: x["key"].isin(*ID_FIELDS)), 0.2) + bonus(F.exists(f, lambda x: F.coalesce(x["text"].rlike("^https?://"), F.lit(False))), 0.1)
        + bonus(F.exists(f, lambda x: F.coalesce(x["kind"].isin("dict", "list"), F.lit(False))), 0.1)
        - bonus((F.length(texts) > 100) & (F.size(F.array_distinct(words)) / F.greatest(F.size(words), F.lit(1)) < 0.3), 0.2)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def odd(text: Column) -> Column:
    """How many signs of an odd value a text shows, of six."""
    signs = [
        F.length(text) > 10_000, (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 10),
        (F.length(text) > 5) & (F.size(F.array_distinct(F.split(text, ""))) < 3), text.rlike(rf"(?s){REPEATED}"), text.rlike(INJECTION), F.contains(F.lower(text), F.lit(SCRIPT)),
    ]
    return reduce(lambda a, b: a + b, [F.coalesce(s.cast("int"), F.lit(0)) for s in signs])


def set_quality(records: DataFrame, by: Sequence[str], record: str, now: Column, order: str, dedup: Sequence[str] = (), required: Sequence[str] = (), adheres: Column | None = None) -> DataFrame:
    """A row for each group: its measures and their composite, `quality` (0 where a record lacks a required field).
    `order` tells which record is a group's first, by whose number of fields accuracy is scaled; `adheres` says whether a
    record keeps to a schema."""
    f = F.col("__f")
    dated = F.filter(F.transform(F.filter(f, lambda x: x["key"].isin(*DATE_FIELDS)), lambda x: dates.absolute(x["text"])), lambda t: t.isNotNull())
    value = lambda name: F.get(F.filter(f, lambda x: x["key"] == name), F.lit(0))
    lacks = [value(n)["kind"].isNull() | F.coalesce(value(n)["text"] == "", F.lit(False)) for n in required]
    keys = [F.coalesce(F.try_variant_get(F.col(record), f"$.{n}", "string"), F.lit("\0")) for n in dedup]
    scored = records.withColumn("__f", fields(F.col(record))).select(
        *by, F.col(order).alias("order"), F.size(f).alias("fields"), total(f, lambda x: x["kind"].isNotNull() & ~F.coalesce(x["text"] == "", F.lit(False))).alias("filled"),
        total(f, lambda x: (F.length(x["text"]) > 5000).cast("int") + (x["text"].rlike(r"^\p{Nd}{21,}$")).cast("int")).alias("suspicious"),
        total(f, lambda x: odd(x["text"])).alias("odd"), reliability(f).alias("reliability"), F.transform(dated, lambda t: dates.recency(t, now)).alias("fresh"),
        (adheres if adheres is not None else F.lit(True)).cast("int").alias("adheres"), reduce(lambda a, b: a | b, lacks, F.lit(False)).alias("lacks"), F.array(*keys).cast("array<string>").alias("keys"),
    )
    n = F.count("*")
    fresh, dates_seen = F.sum(F.aggregate("fresh", F.lit(0.0), lambda s, x: s + x)), F.sum(F.size("fresh"))
    measured = scored.groupBy(*by).agg(
        n.alias("items"), F.coalesce(F.sum("filled") / F.nullif(F.sum("fields"), F.lit(0)), F.lit(0.0)).alias("completeness"),
        F.greatest(F.lit(0.0), F.coalesce(1 - F.sum("suspicious") / F.nullif(n * F.min_by("fields", "order"), F.lit(0)), F.lit(1.0))).alias("accuracy"),
        (1 - F.count_distinct("keys") / n if dedup else F.lit(0.0)).alias("duplicate_rate"), F.coalesce(fresh / F.nullif(dates_seen, F.lit(0)), F.lit(0.5)).alias("freshness"),
        F.avg("reliability").alias("reliability"), F.avg("adheres").alias("adherence"), F.least(F.lit(1.0), F.sum("odd") / F.greatest(F.lit(1), F.sum("fields"))).alias("anomaly"),
        F.bool_or("lacks").alias("lacks"),
    )
    whole = consistency(field_profiles(records, by, record), by)
    joined = measured.alias("m").join(whole.alias("c"), alike(by, "m", "c"), "left").select("m.*", F.when(F.col("items") < 2, 1.0).otherwise(F.coalesce("c.consistency", F.lit(1.0))).alias("consistency"))
    parts = {
        "completeness": F.col("completeness"), "accuracy": F.col("accuracy"), "duplicates": 1 - F.least(F.col("duplicate_rate"), F.lit(1.0)), "validity": F.lit(1.0), "normalization": F.lit(1.0),
        "freshness": F.col("freshness"), "consistency": F.col("consistency"), "reliability": F.col("reliability"), "adherence": F.col("adherence"), "anomaly": 1 - F.col("anomaly"),
    }
    quality = reduce(lambda a, b: a + b, [parts[k] * w for k, w in WEIGHTS.items()])
    return joined.withColumn("quality", F.when(F.col("lacks"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), quality)))).drop("lacks")
