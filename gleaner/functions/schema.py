"""JSON Schema as column conditions: of a flat row's columns, and of nested records held as VARIANT."""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def faults(schema: dict, columns: list[str]) -> Column:
    """Array of "field: rule" of a flat object schema that a row breaks: required, enum, bounds, lengths and patterns."""
    out = []
    for name, spec in schema.get("properties", {}).items():
        if name not in columns:
            if name in schema.get("required", ()):
                out.append(F.lit(f"{name}: required"))
            continue
        c = F.col(name)
        rules = {
            "enum": lambda v, c=c: ~c.isin(*v), "minimum": lambda v, c=c: c < v, "maximum": lambda v, c=c: c > v,
            "minLength": lambda v, c=c: F.length(c) < v, "maxLength": lambda v, c=c: F.length(c) > v, "pattern": lambda v, c=c: ~c.rlike(v),
        }
        if name in schema.get("required", ()):
            out.append(F.when(c.isNull(), F.lit(f"{name}: required")))
        out += [F.when(rules[k](v), F.lit(f"{name}: {k}")) for k, v in spec.items() if k in rules]
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


# JSON Schema over VARIANT


def kinds(v: Column) -> dict[str, Column]:
    """For each type of JSON Schema whether a value is of it; a number without a fraction is an integer too."""
    t = F.schema_of_variant(v)
    number = t.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    double = F.try_variant_get(v, "$", "double")
    return {
        "null": t == "VOID", "boolean": t == "BOOLEAN", "string": t == "STRING", "array": t.startswith("ARRAY"), "object": t.startswith("OBJECT"), "number": number,
        "integer": number & F.coalesce(double == F.floor(double), F.lit(False)),
    }


def resolved(ref: str, root: dict) -> dict | bool:
    if not ref.startswith("#"):
        raise ValueError(f"only references within the schema are known: {ref}")
    at = root
    for part in ref.lstrip("#").strip("/").split("/") if ref != "#" else []:
        at = at[part.replace("~1", "/").replace("~0", "~")]
    return at


def record_faults(record: Column, schema: dict | bool, depth: int = 6) -> Column:
    """Array of "path: rule" that a VARIANT value breaks; a null column breaks nothing.

    Compiled to column conditions when the plan is made: types, enum, const, bounds, lengths, patterns, objects (required,
    properties, additionalProperties, numbers of properties), arrays (items, prefixItems, numbers, uniqueItems), allOf, anyOf,
    oneOf, not, and references within the schema. A schema that refers to itself is unfolded `depth` times; values nested deeper
    than that break nothing below."""
    root = schema
    nothing = F.array().cast("array<string>")

    def told(path: Column, rule: str) -> Column:
        return F.concat(path, F.lit(f": {rule}"))

    def check(v: Column, path: Column, spec: dict | bool, left: int) -> Column:
        if isinstance(spec, bool):
            return nothing if spec else F.array(told(path, "false"))
        if "$ref" in spec:
            return check(v, path, resolved(spec["$ref"], root), left - 1) if left > 0 else nothing
        is_a = kinds(v)
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        found: list[Column] = []  # texts, null where a rule holds
        nested: list[Column] = []  # arrays of texts

        def rule(name: str, applies: Column, broken: Column) -> None:
            found.append(F.when(applies & F.coalesce(broken, F.lit(False)), told(path, name)))

        if "type" in spec:
            types = [spec["type"]] if isinstance(spec["type"], str) else spec["type"]
            rule("type", F.lit(True), ~functools.reduce(lambda a, b: a | b, [is_a[t] for t in types]))
        for name, allowed in (("enum", spec.get("enum")), ("const", [spec["const"]] if "const" in spec else None)):
            if allowed is not None:
                rule(name, F.lit(True), ~F.to_json(v).isin([json.dumps(x, separators=(",", ":"), ensure_ascii=False) for x in allowed]))
        bounds = {"minimum": lambda x: number < x, "maximum": lambda x: number > x, "exclusiveMinimum": lambda x: number <= x, "exclusiveMaximum": lambda x: number >= x, "multipleOf": lambda x: F.abs(number / x - F.round(number / x)) > 1e-9}
        texts = {"minLength": lambda x: F.length(text) < x, "maxLength": lambda x: F.length(text) > x, "pattern": lambda x: ~text.rlike(x)}
        for name, broken in bounds.items():
            if name in spec:
                rule(name, is_a["number"], broken(spec[name]))
        for name, broken in texts.items():
            if name in spec:
                rule(name, is_a["string"], broken(spec[name]))
        held = F.try_variant_get(v, "$", "map<string,variant>")
        own = lambda name: F.try_element_at(held, F.lit(name)) if "'" in name else F.try_variant_get(v, f"$['{name}']", "variant")
        for name in spec.get("required", ()):
            found.append(F.when(is_a["object"] & own(name).isNull(), told(F.concat(path, F.lit(f".{name}")), "required")))
        for name, child in spec.get("properties", {}).items():
            nested.append(F.when(own(name).isNotNull(), check(own(name), F.concat(path, F.lit(f".{name}")), child, left)).otherwise(nothing))
        entries = F.coalesce(F.map_entries(held), F.expr("cast(array() as array<struct<key: string, value: variant>>)"))
        if spec.get("additionalProperties", True) is not True:
            others = F.filter(entries, lambda e: ~e["key"].isin(*spec["properties"])) if spec.get("properties") else entries
            if spec["additionalProperties"] is False:
                nested.append(F.transform(others, lambda e: F.concat(path, F.lit("."), e["key"], F.lit(": additionalProperties"))))
            else:
                nested.append(F.flatten(F.transform(others, lambda e: check(e["value"], F.concat(path, F.lit("."), e["key"]), spec["additionalProperties"], left))))
        for name, broken in (("minProperties", lambda n: F.size(entries) < n), ("maxProperties", lambda n: F.size(entries) > n)):
            if name in spec:
                rule(name, is_a["object"], broken(spec[name]))
        items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        first = spec.get("prefixItems", ())
        for k, child in enumerate(first):
            nested.append(F.when(F.size(items) > k, check(F.get(items, F.lit(k)), place(F.lit(k)), child, left)).otherwise(nothing))
        if "items" in spec:
            numbered = F.transform(items, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
            nested.append(F.flatten(F.transform(F.filter(numbered, lambda p: p["i"] >= len(first)), lambda p: check(p["x"], place(p["i"]), spec["items"], left))))
        counts = {"minItems": lambda n: F.size(items) < n, "maxItems": lambda n: F.size(items) > n, "uniqueItems": lambda on: F.lit(bool(on)) & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items))}
        for name, broken in counts.items():
            if name in spec:
                rule(name, is_a["array"], broken(spec[name]))
        nested += [check(v, path, s, left) for s in spec.get("allOf", ())]
        for name in ("anyOf", "oneOf"):
            if name in spec:
                fit = functools.reduce(lambda a, b: a + b, [(F.size(check(v, path, s, left)) == 0).cast("int") for s in spec[name]])
                rule(name, F.lit(True), fit == 0 if name == "anyOf" else fit != 1)
        if "not" in spec:
            rule("not", F.lit(True), F.size(check(v, path, spec["not"], left)) == 0)
        flat = F.array_compact(F.array(*found)) if found else nothing
        return F.concat(flat, *nested) if nested else flat

    return F.when(record.isNotNull(), check(record, F.lit("$"), schema, depth)).otherwise(nothing)
