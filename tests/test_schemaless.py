"""Quality of records without a schema against the same measures in Python."""

import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleaner.operators import schemaless

NOW = datetime(2024, 12, 31)
RECORDS = [
    ("a", 1, '{"id": 1, "name": "x", "price": 5, "tags": ["a"]}'), ("a", 2, '{"id": "2", "name": null, "price": 5.5, "tags": {"k": 1}}'), ("a", 3, '{"id": 3, "name": "", "price": "five", "url": "https://e/"}'),
    ("a", 4, '{"name": "x", "price": true, "updated": "2024-12-30", "created": "2024-06-01T10:00:00"}'), ("a", 5, '{"id": 99999999999999999999, "name": "AAAAAAAAAAAAAAAAAAAA", "date": "no date"}'),
    ("b", 1, "not json"), ("b", 2, None), ("b", 3, "[1, 2]"), ("b", 4, "{}"), (None, 1, '{"only": 1.0, "name": "n"}'), (None, 2, '{"only": 2e3, "name": "n"}'),
    ("c", 1, '{"name": "DROP TABLE users", "body": "<SCRIPT>x</SCRIPT>", "digits": "123456789012345678901234"}'), ("d", 1, json.dumps({"name": "ab " * 60, "text": "y" * 12000})), ("d", 2, json.dumps({"name": "ab " * 60, "text": "line\n" + "z" * 12})),
    ("e", 1, '{"name": null}'), ("e", 2, '{"name": null}'), ("f", 1, '{"name": {"id": 1}}'), ("f", 2, '{"name": 1}'),
]


def parsed(text):
    try:
        v = json.loads(text) if text is not None else None
    except ValueError:
        v = None
    return v if isinstance(v, dict) else {}


def freshness(v):
    for form in ("%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"):
        try:
            days = (NOW - datetime.strptime(v, form)).days
        except ValueError:
            continue
        return next((s for most, s in ((1, 1.0), (7, 0.9), (30, 0.7), (90, 0.5), (365, 0.3)) if days <= most), 0.1)
    return None


def reliability(item):
    texts = " ".join(v for v in item.values() if isinstance(v, str))
    score = 0.5 + 0.2 * any(k in item for k in ("id", "sku", "uuid")) + 0.1 * any(isinstance(v, str) and v.startswith(("http://", "https://")) for v in item.values()) + 0.1 * any(isinstance(v, (dict, list)) for v in item.values())
    words = texts.split()
    if len(texts) > 100 and len(set(words)) / max(1, len(words)) < 0.3:
        score -= 0.2
    return max(0.0, min(1.0, score))


def odd(v):
    return (len(v) > 10000) + (v.isupper() and len(v) > 10) + (len(v) > 5 and len(set(v)) < 3) + bool(re.search(r"(.)\1{10,}", v, re.S)) + bool(re.search(r"(union|select|insert|delete|drop|exec)\s", v, re.I)) + ("<script" in v.lower())


def by_hand(items):
    n, keys = len(items), sorted({k for i in items for k in i})
    present = {k: sum(i.get(k) is not None for i in items) for k in keys}
    types = {k: sorted({type(i[k]).__name__ for i in items if i.get(k) is not None}) for k in keys}
    fields = {k: (present[k], types[k], present[k] / n, (present[k] / n + (1.0 if len(types[k]) <= 1 else 0.5)) / 2, {0: 1.0, 1: 1.0, 2: 0.7}.get(len(types[k]), 0.3)) for k in keys}
    whole = 1.0 if n < 2 or not keys else (sum(present.values()) / n / len(keys) + sum(1.0 if len(t) <= 1 else 0.5 for t in types.values()) / len(keys)) / 2
    total = sum(map(len, items))
    texts = [v for i in items for v in i.values() if isinstance(v, str)]
    suspicious = sum((len(v) > 5000) + (v.isdigit() and len(v) > 20) for v in texts)
    fresh = [x for i in items for k in schemaless.DATE_FIELDS if isinstance(i.get(k), str) and (x := freshness(i[k])) is not None]
    m = {
        "completeness": sum(v is not None and v != "" for i in items for v in i.values()) / total if total else 0.0, "accuracy": max(0.0, 1 - suspicious / (n * len(items[0]))) if items[0] else 1.0,
        "duplicate_rate": (n - len({json.dumps(i.get("name")) for i in items})) / n, "freshness": sum(fresh) / len(fresh) if fresh else 0.5, "consistency": whole, "reliability": sum(map(reliability, items)) / n,
        "adherence": 1.0, "anomaly": min(1.0, sum(map(odd, texts)) / max(1, total)),
    }
    q = 0.25 * m["completeness"] + 0.2 * m["accuracy"] + 0.15 * (1 - m["duplicate_rate"]) + 0.2 + 0.1 * m["freshness"] + 0.1 * whole + 0.05 * m["reliability"] + 0.05 + 0.05 * (1 - m["anomaly"])
    m["quality"] = 0.0 if any(i.get("name") in (None, "") for i in items) else max(0.0, min(1.0, q))
    return fields, m


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(RECORDS, "grp string, n long, json string").withColumn("record", F.try_parse_json("json"))


def test_fields_and_quality(df):
    groups = {}
    for g, _, text in RECORDS:
        groups.setdefault(g, []).append(parsed(text))
    profiles = {(r["grp"], r["field"]): (r["present"], r["types"], r["presence"], r["consistency"], r["type_consistency"]) for r in schemaless.field_profiles(df, ["grp"], "record").collect()}
    assert profiles == {(g, k): v for g, items in groups.items() for k, v in by_hand(items)[0].items()}
    got = {r["grp"]: r for r in schemaless.set_quality(df, ["grp"], "record", F.lit("2024-12-31 00:00:00").cast("timestamp"), "n", dedup=["name"], required=["name"]).collect()}
    assert set(got) == set(groups)
    for g, items in groups.items():
        for name, want in by_hand(items)[1].items():
            assert got[g][name] == pytest.approx(want), (g, name)


def test_no_records(df):
    assert schemaless.field_profiles(df.limit(0), ["grp"], "record").count() == 0
    assert schemaless.set_quality(df.limit(0), ["grp"], "record", F.current_timestamp(), "n").count() == 0


def test_a_schema_lowers_adherence(df):
    got = {r["grp"]: r["adherence"] for r in schemaless.set_quality(df, ["grp"], "record", F.current_timestamp(), "n", adheres=F.col("n") > 2).collect()}
    assert got["a"] == pytest.approx(0.6) and got["c"] == 0
