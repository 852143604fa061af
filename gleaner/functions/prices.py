"""Price expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Units of a currency per US dollar.
RATES = {"USD": 1.0, "EUR": 0.92, "GBP": 0.79, "JPY": 149.5, "CAD": 1.35, "AUD": 1.52, "CHF": 0.88, "CNY": 7.24, "INR": 83.1, "BRL": 4.95}
#: Currency signs, the first that a text holds wins.
SIGNS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("¥", "JPY"), ("₹", "INR"), ("₩", "KRW"), ("₽", "RUB"), ("₺", "TRY"), ("CHF", "CHF"))
#: Currency codes in order.
CODES = ("USD", "EUR", "GBP", "JPY", "CAD", "AUD", "CHF", "CNY", "INR", "BRL", "KRW", "RUB", "TRY")
#: Words of a sale.
SALE = ("sale", "discount", "offer", "deal", "special", "clearance", "reduced", "markdown", "promo", "coupon", "save", "off")


def currency(text: Column, default: str = "USD") -> Column:
    word = F.upper(F.regexp_extract(text, rf"(?i)\b({'|'.join(CODES)})\b", 1))
    several = text.rlike(rf"(?i)\b(?:{'|'.join(CODES)})\b.*\b(?:{'|'.join(CODES)})\b")
    first = F.lit(default)
    for code in reversed(CODES):
        first = F.when(text.rlike(rf"(?i)\b{code}\b"), code).otherwise(first)
    out = F.when(several, first).when(word != "", word).otherwise(default)
    for sign, code in reversed(SIGNS):
        out = F.when(text.contains(sign), code).otherwise(out)
    return out


def amount(text: Column) -> Column:
    """The first number of a text, with the decimal sign guessed: the later of comma and point, or one comma near the end."""

    def of(bare: Column) -> Column:
        commas = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
        last = lambda sign: F.length(bare) - F.instr(F.reverse(bare), sign)
        european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        plain = F.replace(bare, F.lit(","), F.lit(""))
        near_end = (commas == 1) & (last(",") > F.length(bare) - 4)
        both = bare.contains(",") & bare.contains(".")
        fixed = F.when(both, F.when(last(",") > last("."), european).otherwise(plain)).when(near_end, F.replace(bare, F.lit(","), F.lit("."))).otherwise(plain)
        return F.regexp_extract(fixed, r"-?[0-9]+\.?[0-9]*", 0).try_cast("decimal(38,10)")

    return bound(F.regexp_replace(text, r"[^0-9.,\-]", " "), of)


def rate(code: Column) -> Column:
    known = F.create_map(*[x for k, v in RATES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(known, code), F.lit(1.0))


def is_sale(text: Column) -> Column:
    return F.lower(text).rlike("|".join(SALE))


def normalized(text: Column, target: str = "USD") -> Column:
    """struct(value, currency, usd, is_sale); as the rates are per dollar, normalising multiplies by them."""

    def of(p: Column) -> Column:
        usd = F.when(p["code"] == target, p["value"]).otherwise(F.bround(p["value"] * rate(p["code"]).cast("decimal(12,6)"), 2))
        return F.struct(p["value"].cast("double").alias("value"), p["code"].alias("currency"), usd.cast("double").alias("usd"), p["sale"].alias("is_sale"))

    return bound(F.struct(amount(text).cast("decimal(24,6)").alias("value"), currency(text).alias("code"), is_sale(text).alias("sale")), of)


def convert(value: Column, source: Column, target: Column, digits: int | None = 2) -> Column:
    """From one currency to another by way of dollars."""
    made = value / rate(source) * rate(target)
    return made if digits is None else F.bround(made, digits)


def all_prices(text: Column) -> Column:
    """Distinct positive amounts with a currency sign before or after them, in order."""
    before = F.regexp_extract_all(text, F.lit(r"[$€£¥₹]\s*[0-9,]+\.?[0-9]*"), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(r"[0-9,]+\.?[0-9]*\s*[$€£¥₹]"), F.lit(0))
    found = F.transform(F.concat(before, after), lambda p: F.struct(amount(p).cast("double").alias("value"), currency(p).alias("currency")))
    return F.array_distinct(F.filter(found, lambda p: p["value"] > 0))


def discount_fits(price: Column, original: Column, percent: Column, tolerance: float) -> Column:
    expected = (original - price) / original * 100
    return F.abs(percent - expected) <= tolerance


def formatted(value: Column, code: Column, european: bool = False) -> Column:
    plain = F.format_number(value, 2)
    return F.concat_ws(" ", F.translate(plain, ",.", ".,") if european else plain, code)


def bare_number(text: Column) -> Column:
    """The digits, points and signs of a text as a number, commas dropped; null where that is no number."""
    return F.replace(F.regexp_replace(text, r"[^0-9.,\-]", ""), F.lit(","), F.lit("")).try_cast("decimal(38,10)")


def lenient_number(text: Column) -> Column:
    """A number without its sign: the later of comma and point is the decimal sign, and a comma alone always is."""

    def of(bare: Column) -> Column:
        last = lambda sign: F.length(bare) - F.instr(F.reverse(bare), sign)
        both = bare.contains(",") & bare.contains(".")
        plain = F.replace(bare, F.lit(","), F.lit(""))
        european = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        return F.when(both, F.when(last(",") > last("."), european).otherwise(plain)).otherwise(F.replace(bare, F.lit(","), F.lit("."))).try_cast("double")

    return F.when(text != "", bound(F.regexp_replace(text, r"[^0-9.,]", ""), of))


def of_record(fields: dict[str, Column], texts: list[Column]) -> Column:
    """Distinct prices of a record, by value and currency: positive ones of its fields, then those its texts hold."""
    direct = [F.when(p["value"] > 0, F.struct(p["value"].cast("double").alias("value"), p["currency"].alias("currency"))) for p in map(normalized, fields.values())]
    found = [F.transform(all_prices(t), lambda x: F.struct(x["value"].cast("double").alias("value"), x["currency"].alias("currency"))) for t in texts]
    return F.array_distinct(F.filter(F.concat(F.array_compact(F.array(*direct)), *found), lambda p: p["value"] > 0))


def greatest_price(found: Column) -> Column:
    """The price of the greatest value among those of of_record()."""
    return F.array_max(found)
