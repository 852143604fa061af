"""Fields of a page by a schema given with the query, as a table function whose output is that schema."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Fields taken from JSON-LD by type, and names under which OpenGraph's are known.
JSON_LD = {
    "Product": ("name", "price", "description", "image", "brand", "sku", "rating", "review"),
    "Article": ("title", "author", "datePublished", "dateModified", "articleBody", "keywords"),
    "Review": ("itemReviewed", "reviewRating", "author", "reviewBody", "pros", "cons"),
    "Event": ("name", "startDate", "endDate", "location", "description"),
    "JobPosting": ("title", "hiringOrganization", "baseSalary", "description", "datePosted"),
}
OPEN_GRAPH = {"title": "name", "description": "description", "image": "image", "url": "url", "type": "category", "site_name": "source"}
BLOCK = re.compile(r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>""")
META = re.compile(r"""(?i)<meta\s+property=["']og:([^"']+)["']\s+content=["']([^"']*)["']""")


def structured(html: str) -> dict:
    """What a page's JSON-LD blocks and then its OpenGraph tags say, the first of a name counting."""
    out: dict = {}
    for block in BLOCK.findall(html):
        try:
            held = json.loads(block)
        except ValueError:
            continue
        for item in held if isinstance(held, list) else [held]:
            if isinstance(item, dict):
                kind = item.get("@type", "")
                for name in JSON_LD.get(kind[0] if isinstance(kind, list) and kind else kind if isinstance(kind, str) else "", ()):
                    if name in item:
                        out.setdefault(name, item[name])
    for name, value in META.findall(html):
        if name in OPEN_GRAPH:
            out.setdefault(OPEN_GRAPH[name], value)
    return out


def fitted(value, kind: T.DataType):
    """A JSON value as a column's type, or null where it is none; what is no text becomes JSON text."""
    if value is None:
        return None
    try:
        if isinstance(kind, T.ArrayType):
            return [fitted(x, kind.elementType) for x in (value if isinstance(value, list) else [value])]
        if isinstance(kind, T.StructType):
            return {f.name: fitted(value.get(f.name), f.dataType) for f in kind.fields} if isinstance(value, dict) else None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        if isinstance(kind, T.BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).lower())
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return float(value)
        if isinstance(kind, (T.LongType, T.IntegerType)):
            return int(float(value))
    except (TypeError, ValueError, OverflowError):
        return None
    return None


SIMPLE = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def type_of(spec: dict) -> T.DataType:
    """The column type of a JSON Schema; what has no type is text."""
    kind = spec.get("type", "string")
    if kind == "array":
        return T.ArrayType(type_of(spec.get("items", {})))
    if kind == "object":
        return T.StructType([T.StructField(k, type_of(v)) for k, v in spec.get("properties", {}).items()])
    if kind not in SIMPLE:
        raise ValueError(f"no column has the type {kind}")
    return SIMPLE[kind]


class ExtractFields:
    """extract_fields(html, schema): one row for each page, of the columns that a JSON Schema of an object names; the schema is
    a constant text."""

    @staticmethod
    def analyze(html: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if not schema.isConstantExpression or not isinstance(schema.value, str):
            raise ValueError("the schema is a constant text")
        return AnalyzeResult(schema=type_of({"type": "object", **json.loads(schema.value)}))

    def __init__(self, result: AnalyzeResult):
        self.schema = result.schema

    def eval(self, html: str | None, schema: str):
        found = structured(html or "")
        yield tuple(fitted(found.get(f.name), f.dataType) for f in self.schema.fields)


def register(spark: SparkSession, name: str = "extract_fields") -> None:
    """Make the table function known to SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(ExtractFields))
