"""Records from pages by CSS selectors: containers with a fallback to the whole page, and fields within each."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dom
from ..functions.text import bound, collapse

#: Selectors of item containers, in the order in which they are tried.
CONTAINERS = (".product", ".item", ".listing", ".card", "[data-product]", "[data-item]", "article", "li.product", "div.product-item")

#: What can be done to a value: text to a column.
TRANSFORMS = {
    "lower": F.lower,
    "upper": F.upper,
    "strip": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""),
    "int": lambda c: F.when(c == "", F.lit(0).cast("long")).otherwise(c.try_cast("double").cast("long")),
    "float": lambda c: F.when(c == "", 0.0).otherwise(c.try_cast("double")),
    "bool": lambda c: c != "",
    "abs_url": lambda c: c,
}


@dataclass(frozen=True)
class Field:
    """A field of a record: the text, or an attribute, of what a selector finds; the first of them, or all (`multiple`).
    Without any, that of `fallback`, and then `default`."""

    selector: str
    attribute: str | None = None
    multiple: bool = False
    clean: bool = True
    transform: str | None = None
    default: str | None = None
    fallback: Field | None = None


def values_of(page: Column, elements: Column, field: Field, first: bool) -> Column:
    """Values of what the field's selector finds in the elements, null ones left out; `first`: of the first found alone, so
    that no other element's text is put together."""

    def value(e: Column) -> Column:
        if not field.attribute:
            return dom.text_of(page["texts"], e, field.clean)
        raw = dom.attribute(e, field.attribute)
        return collapse(raw) if field.clean else raw

    found = dom.matching(elements, field.selector)
    return F.filter(F.transform(F.slice(found, 1, 1) if first else found, value), lambda v: v.isNotNull())


def value_of(page: Column, elements: Column, field: Field) -> Column:
    """The field of a page's elements, transformed."""
    change = TRANSFORMS[field.transform] if field.transform else lambda c: c
    if field.multiple:
        return F.transform(values_of(page, elements, field, False), change)
    value = change(F.get(values_of(page, elements, field, True), F.lit(0)))
    if field.fallback:
        value = F.coalesce(value, value_of(page, elements, field.fallback))
    return value if field.default is None else F.coalesce(value, F.lit(field.default))


def contained(elements: Column, containers: Sequence[str]) -> Column:
    """struct(selector, found) of the first selector that finds any container; null if none does."""

    def tried(selector: str) -> Column:
        return bound(dom.matching(elements, selector), lambda f: F.when(F.size(f) > 0, F.struct(F.lit(selector).alias("selector"), f.alias("found"))))

    return F.coalesce(*[tried(s) for s in containers])


def items(pages: DataFrame, fields: Mapping[str, Field], containers: Sequence[str] = CONTAINERS, html: str = "html") -> DataFrame:
    """A row for each container that the first matching selector finds in a page, or for the page itself where none does:
    the page's other columns, selector (null for the page), item (its number) and the fields. A null page has no items."""
    kept = [c for c in pages.columns if c != html]
    read = pages.where(F.col(html).isNotNull()).select(*kept, dom.parsed(F.col(html)).alias("__page"))
    page, elements = F.col("__page"), F.col("__page")["elements"]
    tried = read.withColumn("__in", contained(elements, containers))
    none = F.expr("array(cast(null as struct<n: int, last: int, parent: int, tag: string, id: string, classes: array<string>, attributes: array<struct<name: string, value: string>>>))")
    rows = tried.select(*kept, "__page", F.col("__in")["selector"].alias("selector"), F.posexplode(F.coalesce(F.col("__in")["found"], none)).alias("item", "__container"))
    rows = rows.withColumn("__own", dom.part_of(elements, F.col("__container")))
    return rows.select(*kept, "selector", "item", *[value_of(page, F.col("__own"), f).alias(name) for name, f in fields.items()])
