"""JSON Schema over VARIANT against a small recursive checker."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions import schema

VALUES = [
    {"a": 1, "b": "x", "c": [1, 2, 2], "d": {"e": None, "f": True}}, {"a": 1.0, "b": "", "c": [], "d": {}}, {"a": 1.5, "b": "longer text", "c": ["x", {"k": 3}, [0]]}, {"a": "1", "z": 0, "it's": 5}, {"a": -3, "c": [9, 8, 7, 6, 5], "d": {"e": "s", "extra": [1]}},
    [], [1, "two", None], "text", "", 5, 0.25, True, None, {}, {"tree": {"v": 1, "kids": [{"v": 2, "kids": []}, {"v": "bad"}, {"kids": [{"v": -1}]}]}}, {"a": 10, "b": "id-77", "c": [[1, 2], [3]]},
]
SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": "integer", "minimum": 0, "exclusiveMaximum": 10}, "b": {"type": "string", "minLength": 1, "maxLength": 6, "pattern": "^[a-z]"}}},
    {"properties": {"c": {"type": "array", "minItems": 1, "maxItems": 4, "uniqueItems": True, "items": {"type": ["number", "string"], "maximum": 8}}, "d": {"additionalProperties": {"type": ["null", "boolean"]}}}},
    {"additionalProperties": False, "properties": {"a": True, "b": False, "d": {"required": ["e"]}}}, {"minProperties": 1, "maxProperties": 3}, {"enum": [5, "text", None, True, {"a": 1}]}, {"const": 0.25},
    {"oneOf": [{"type": "number"}, {"type": "integer"}, {"type": "object", "required": ["z"]}]}, {"anyOf": [{"type": "string"}, {"type": "array", "prefixItems": [{"type": "integer"}, {"type": "string"}], "items": False}]},
    {"allOf": [{"type": "object"}, {"properties": {"a": {"multipleOf": 0.5}}}], "not": {"required": ["z"]}}, {"properties": {"it's": {"maximum": 4}}}, True, False,
    {"$defs": {"node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "minimum": 0}, "kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}}}}, "properties": {"tree": {"$ref": "#/$defs/node"}}},
]


def number(v):
    return isinstance(v, (int, float)) and not isinstance(v, bool)


TYPES = {
    "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool), "string": lambda v: isinstance(v, str), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict), "number": number,
    "integer": lambda v: number(v) and v == int(v),
}


def faults(v, s, root, path="$"):
    if isinstance(s, bool):
        return [] if s else [f"{path}: false"]
    if "$ref" in s:
        at = root
        for part in s["$ref"][2:].split("/"):
            at = at[part]
        return faults(v, at, root, path)
    out, say = [], lambda name, bad: out.append(f"{path}: {name}") if bad else None
    if "type" in s:
        say("type", not any(TYPES[t](v) for t in ([s["type"]] if isinstance(s["type"], str) else s["type"])))
    same = lambda a, b: json.dumps(a) == json.dumps(b)
    say("enum", "enum" in s and not any(same(v, x) for x in s["enum"]))
    say("const", "const" in s and not same(v, s["const"]))
    if number(v):
        for name, bad in (("minimum", lambda x: v < x), ("maximum", lambda x: v > x), ("exclusiveMinimum", lambda x: v <= x), ("exclusiveMaximum", lambda x: v >= x), ("multipleOf", lambda x: abs(v / x - round(v / x)) > 1e-9)):
            say(name, name in s and bad(s[name]))
    if isinstance(v, str):
        for name, bad in (("minLength", lambda x: len(v) < x), ("maxLength", lambda x: len(v) > x), ("pattern", lambda x: not re.search(x, v))):
            say(name, name in s and bad(s[name]))
    if isinstance(v, dict):
        out += [f"{path}.{n}: required" for n in s.get("required", ()) if n not in v]
        for n, child in s.get("properties", {}).items():
            out += faults(v[n], child, root, f"{path}.{n}") if n in v else []
        for n in v:
            if n not in s.get("properties", {}) and (extra := s.get("additionalProperties", True)) is not True:
                out += [f"{path}.{n}: additionalProperties"] if extra is False else faults(v[n], extra, root, f"{path}.{n}")
        say("minProperties", len(v) < s.get("minProperties", 0))
        say("maxProperties", len(v) > s.get("maxProperties", 99))
    if isinstance(v, list):
        first = s.get("prefixItems", [])
        for k, x in enumerate(v):
            out += faults(x, first[k] if k < len(first) else s.get("items", True), root, f"{path}[{k}]")
        say("minItems", len(v) < s.get("minItems", 0))
        say("maxItems", len(v) > s.get("maxItems", 99))
        say("uniqueItems", s.get("uniqueItems") and len({json.dumps(x) for x in v}) < len(v))
    for child in s.get("allOf", ()):
        out += faults(v, child, root, path)
    fit = lambda name: sum(not faults(v, c, root, path) for c in s[name])
    say("anyOf", "anyOf" in s and fit("anyOf") == 0)
    say("oneOf", "oneOf" in s and fit("oneOf") != 1)
    say("not", "not" in s and not faults(v, s["not"], root, path))
    return out


def test_schemas(spark):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(VALUES)], "k int, j string").withColumn("v", F.try_parse_json("j")).repartition(2)
    for s in SCHEMAS:
        got = {r["k"]: sorted(r["f"]) for r in df.select("k", schema.record_faults(F.col("v"), s).alias("f")).collect()}
        for k, v in enumerate(VALUES):
            assert got[k] == sorted(faults(v, s, s)), (s, v)


def test_null_records_and_foreign_references(spark):
    df = spark.sql("select try_parse_json(cast(null as string)) as v")
    assert df.select(schema.record_faults(F.col("v"), {"type": "object"})).first()[0] == []
    with pytest.raises(ValueError):
        schema.record_faults(F.col("v"), {"$ref": "http://x/y"})
