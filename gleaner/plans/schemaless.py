"""Queries of records without a schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import schema
from ..operators import schemaless
from ..sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


NOW = "2024-12-31 00:00:00"
#: Documents as JSON records that differ in their fields and in the types of these.
RECORDS = """
SELECT doc_id, lang AS grp, concat(left(text_json, length(text_json) - 1),
  CASE WHEN doc_id % 3 <> 0 THEN concat(',"id":', doc_id) ELSE '' END,
  CASE doc_id % 4 WHEN 0 THEN concat(',"size":', n_chars) WHEN 1 THEN concat(',"size":"', n_chars, '"') WHEN 2 THEN concat(',"size":', n_chars, '.5') ELSE ',"size":null' END,
  CASE doc_id % 5 WHEN 0 THEN ',"meta":{"a":1}' WHEN 1 THEN ',"meta":[1,2]' WHEN 2 THEN ',"meta":true' ELSE '' END,
  CASE WHEN doc_id % 2 = 0 THEN concat(',"url":"https://x.example/', doc_id, '"') ELSE ',"url":"none"' END,
  CASE WHEN doc_id % 6 < 4 THEN concat(',"updated":"', date_add(DATE'2024-01-01', cast(doc_id % 400 AS int)), '"') ELSE '' END, '}') AS json
FROM (SELECT *, to_json(named_struct('text', text), map('ignoreNullFields', 'false')) AS text_json FROM schemaless_documents)
"""


def records(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("schemaless_documents")
    return spark.sql(RECORDS).withColumn("record", F.try_parse_json("json")).drop("json")


#: The same records' fields, a row each: key, Python's type, text.
FIELDS = """
f AS (
  SELECT doc_id, lang AS grp, unnest([
    {'k': 'text', 't': CASE WHEN text IS NOT NULL THEN 'str' END, 'x': text, 'there': true},
    {'k': 'id', 't': 'int', 'x': NULL, 'there': doc_id % 3 <> 0},
    {'k': 'size', 't': CASE doc_id % 4 WHEN 0 THEN CASE WHEN n_chars IS NOT NULL THEN 'int' END WHEN 1 THEN 'str' WHEN 2 THEN 'float' END, 'x': CASE WHEN doc_id % 4 = 1 THEN CAST(n_chars AS VARCHAR) END, 'there': true},
    {'k': 'meta', 't': CASE doc_id % 5 WHEN 0 THEN 'dict' WHEN 1 THEN 'list' ELSE 'bool' END, 'x': NULL, 'there': doc_id % 5 < 3},
    {'k': 'url', 't': 'str', 'x': CASE WHEN doc_id % 2 = 0 THEN 'https://x.example/' || doc_id ELSE 'none' END, 'there': true},
    {'k': 'updated', 't': 'str', 'x': CAST(DATE '2024-01-01' + CAST(doc_id % 400 AS INTEGER) AS VARCHAR), 'there': doc_id % 6 < 4}]) AS f FROM documents
), e AS (SELECT doc_id, grp, f.k AS k, f.t AS t, f.x AS x FROM f WHERE f.there
), n AS (SELECT lang AS grp, count(*) AS items FROM documents GROUP BY lang
), p AS (
  SELECT e.grp, e.k AS field, count(e.t) AS present, count(DISTINCT e.t) AS types, list_sort(list(DISTINCT e.t) FILTER (e.t IS NOT NULL)) AS names, any_value(n.items) AS items
  FROM e JOIN n ON e.grp IS NOT DISTINCT FROM n.grp GROUP BY e.grp, e.k
)
"""


@query(f"""
WITH {FIELDS} SELECT grp, field, present, coalesce(array_to_string(names, ' '), '') AS types, round(present / items, 6) AS presence, round((present / items + CASE WHEN types <= 1 THEN 1 ELSE 0.5 END) / 2, 6) AS consistency,
  CASE WHEN types <= 1 THEN 1e0 WHEN types = 2 THEN 0.7e0 ELSE 0.3e0 END AS type_consistency FROM p
""")
def field_consistency(spark, d):
    got = schemaless.field_profiles(records(spark, d), ["grp"], "record")
    return got.select("grp", "field", "present", F.array_join("types", " ").alias("types"), F.round("presence", 6).alias("presence"), F.round("consistency", 6).alias("consistency"), "type_consistency")


@query("SELECT event_type, 'k' AS field, count(*) AS present, round(1.0, 6)::DOUBLE AS presence, 1e0 AS type_consistency FROM events WHERE json_type(props, '$.k') = 'UBIGINT' GROUP BY event_type")
def event_fields(spark, d):
    t = table(spark, d, "events").select("event_type", F.try_parse_json("props").alias("props"))
    return schemaless.field_profiles(t, ["event_type"], "props").select("event_type", "field", "present", F.round("presence", 6).alias("presence"), "type_consistency")


@query(f"""
WITH {FIELDS}, i AS (
  SELECT doc_id, grp, count(*) AS fields, count(*) FILTER (t IS NOT NULL AND coalesce(x, '?') <> '') AS filled,
    sum(CAST(coalesce(length(x) > 5000, false) AS INT) + CAST(coalesce(regexp_full_match(x, '[0-9]{{21,}}'), false) AS INT)) AS suspicious,
    sum(CAST(coalesce(length(x) > 10000, false) AS INT) + CAST(coalesce(upper(x) = x AND lower(x) <> x AND length(x) > 10, false) AS INT) + CAST(coalesce(length(x) > 5 AND len(list_distinct(string_split(x, ''))) < 3, false) AS INT)
      + CAST(coalesce(len(list_filter(range(1, length(x) - 9), lambda j: x[j] = x[j + 1] AND x[j : j + 10] = repeat(x[j], 11))) > 0, false) AS INT)
      + CAST(coalesce(regexp_matches(x, '(?i)(union|select|insert|delete|drop|exec)\\s'), false) AS INT) + CAST(coalesce(contains(lower(x), '<script'), false) AS INT)) AS odd,
    0.5e0 + CASE WHEN bool_or(k = 'id') THEN 0.2e0 ELSE 0 END + CASE WHEN bool_or(coalesce(regexp_matches(x, '^https?://'), false)) THEN 0.1e0 ELSE 0 END + CASE WHEN bool_or(t IN ('dict', 'list')) THEN 0.1e0 ELSE 0 END AS base,
    string_agg(x, ' ') AS said, max(CASE WHEN k = 'updated' THEN CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(CAST(TRY_CAST(x AS DATE) AS TIMESTAMP))) / 86400) AS BIGINT) END) AS age, max(CASE WHEN k = 'text' THEN x END) AS text
  FROM e GROUP BY doc_id, grp
), r AS (
  SELECT *, greatest(0e0, least(1e0, base - CASE WHEN length(said) > 100 AND len(list_distinct(w)) / greatest(len(w), 1) < 0.3 THEN 0.2e0 ELSE 0 END)) AS reliability,
    CASE WHEN age <= 1 THEN 1e0 WHEN age <= 7 THEN 0.9e0 WHEN age <= 30 THEN 0.7e0 WHEN age <= 90 THEN 0.5e0 WHEN age <= 365 THEN 0.3e0 WHEN age IS NOT NULL THEN 0.1e0 END AS fresh
  FROM (SELECT *, list_filter(string_split_regex(said, '\\s+'), lambda z: z <> '') AS w FROM i)
), g AS (
  SELECT grp, count(*) AS items, sum(filled) / sum(fields) AS completeness, greatest(0, 1 - sum(suspicious) / (count(*) * min_by(fields, doc_id))) AS accuracy, 1 - count(DISTINCT coalesce(text, chr(0))) / count(*) AS duplicate_rate,
    coalesce(avg(fresh), 0.5) AS freshness, avg(reliability) AS reliability, least(1, sum(odd) / sum(fields)) AS anomaly FROM r GROUP BY grp
), c AS (SELECT grp, (avg(present / items) + avg(CASE WHEN types <= 1 THEN 1 ELSE 0.5 END)) / 2 AS consistency FROM p GROUP BY grp
)
SELECT g.grp AS lang, items, round(completeness, 6) AS completeness, round(accuracy, 6)::DOUBLE AS accuracy, round(duplicate_rate, 6) AS duplicate_rate, round(freshness, 6) AS freshness, round(reliability, 6) AS reliability, round(anomaly, 6)::DOUBLE AS anomaly,
  round(CASE WHEN items < 2 THEN 1 ELSE consistency END, 6) AS consistency,
  round(least(1, 0.25 * completeness + 0.2 * accuracy + 0.15 * (1 - duplicate_rate) + 0.1 + 0.1 + 0.1 * freshness + 0.1 * CASE WHEN items < 2 THEN 1 ELSE consistency END + 0.05 * reliability + 0.05 + 0.05 * (1 - anomaly)), 6)::DOUBLE AS quality
FROM g JOIN c ON g.grp IS NOT DISTINCT FROM c.grp
""")
def composite_quality(spark, d):
    got = schemaless.set_quality(records(spark, d), ["grp"], "record", F.lit(NOW).cast("timestamp"), "doc_id", dedup=["text"], required=["url"])
    names = ("completeness", "accuracy", "duplicate_rate", "freshness", "reliability", "anomaly", "consistency", "quality")
    return got.select(F.col("grp").alias("lang"), "items", *[F.round(k, 6).alias(k) for k in names])


@query(f"""
WITH {FIELDS}, i AS (
  SELECT doc_id, 0.5e0 + CASE WHEN bool_or(k = 'id') THEN 0.2e0 ELSE 0 END + CASE WHEN bool_or(coalesce(regexp_matches(x, '^https?://'), false)) THEN 0.1e0 ELSE 0 END + CASE WHEN bool_or(t IN ('dict', 'list')) THEN 0.1e0 ELSE 0 END AS base,
    string_agg(x, ' ') AS said FROM e GROUP BY doc_id
)
SELECT doc_id, round(greatest(0e0, least(1e0, base - CASE WHEN length(said) > 100 AND len(list_distinct(w)) / greatest(len(w), 1) < 0.3 THEN 0.2e0 ELSE 0 END)), 6) AS reliability
FROM (SELECT *, list_filter(string_split_regex(said, '\\s+'), lambda z: z <> '') AS w FROM i)
""")
def source_reliability(spark, d):
    return records(spark, d).select("doc_id", F.round(schemaless.reliability(schemaless.fields(F.col("record"))), 6).alias("reliability"))


RECORD_SCHEMA = {
    "type": "object", "required": ["id", "url"], "additionalProperties": False, "$defs": {"count": {"type": "integer", "minimum": 300}},
    "properties": {
        "id": {"type": "integer"}, "text": {"type": "string", "maxLength": 2000}, "url": {"type": "string", "pattern": "^https?://"}, "size": {"oneOf": [{"$ref": "#/$defs/count"}, {"type": "string", "minLength": 4}]},
        "meta": {"anyOf": [{"type": "object", "properties": {"a": {"const": 1}}}, {"type": "array", "items": {"enum": [1, 3]}}]},
    },
}


@query("""
SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 3 = 0 THEN '$.id: required' END, CASE WHEN text IS NULL THEN '$.text: type' WHEN length(text) > 2000 THEN '$.text: maxLength' END,
  CASE WHEN doc_id % 2 <> 0 THEN '$.url: pattern' END, CASE WHEN NOT CASE doc_id % 4 WHEN 0 THEN coalesce(n_chars >= 300, false) WHEN 1 THEN length(CAST(n_chars AS VARCHAR)) >= 4 ELSE false END THEN '$.size: oneOf' END,
  CASE WHEN doc_id % 5 IN (1, 2) THEN '$.meta: anyOf' END, CASE WHEN doc_id % 6 < 4 THEN '$.updated: additionalProperties' END) AS faults FROM documents
""")
def nested_schema(spark, d):
    return records(spark, d).select("doc_id", F.concat_ws("; ", schema.record_faults(F.col("record"), RECORD_SCHEMA)).alias("faults"))
