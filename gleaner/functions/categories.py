"""Category of a text by keywords."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories in order with their keywords.
CATEGORIES = {
    "electronics": ("phone", "laptop", "computer", "tablet", "camera", "headphone", "tv", "monitor", "smartphone", "gadget", "device", "electronic", "gaming", "console", "headset", "speaker", "charger", "cable", "battery", "power bank"),
    "clothing": ("shirt", "pants", "dress", "shoe", "jacket", "sweater", "jeans", "sneaker", "boot", "t-shirt", "hoodie", "coat", "blazer", "skirt", "shorts", "sock", "underwear", "swimwear", "activewear"),
    "home": ("furniture", "decor", "kitchen", "bedding", "lamp", "chair", "table", "sofa", "mattress", "pillow", "curtain", "rug", "mirror", "wall art", "vase", "candle", "storage", "organizer", "appliance"),
    "beauty": ("makeup", "skincare", "perfume", "cosmetic", "cream", "serum", "lipstick", "foundation", "mascara", "eyeliner", "moisturizer", "cleanser", "toner", "sunscreen", "hair care", "nail polish"),
    "sports": ("fitness", "exercise", "yoga", "running", "gym", "weight", "protein", "supplement", "dumbbell", "treadmill", "bike", "swim", "tennis", "basketball", "soccer", "golf", "outdoor", "camping", "hiking"),
    "books": ("book", "novel", "ebook", "author", "chapter", "page", "read", "library", "magazine", "comic", "manga", "textbook", "guide", "manual", "dictionary", "encyclopedia"),
    "automotive": ("car", "auto", "vehicle", "tire", "wheel", "brake", "engine", "oil", "filter", "battery", "spark plug", "headlight", "mirror", "seat", "dashboard", "gps", "carplay"),
    "health": ("vitamin", "supplement", "medicine", "pill", "tablet", "capsule", "syrup", "ointment", "cream", "bandage", "first aid", "thermometer", "monitor", "device"),
    "toys": ("toy", "game", "puzzle", "lego", "doll", "action figure", "board game", "card game", "video game", "console", "controller", "remote control", "drone", "robot"),
    "food": ("food", "snack", "drink", "beverage", "coffee", "tea", "wine", "beer", "chocolate", "candy", "cookie", "chip", "nut", "fruit", "vegetable", "meal", "recipe", "ingredient"),
    "jewelry": ("jewelry", "ring", "necklace", "bracelet", "earring", "watch", "pendant", "chain", "gold", "silver", "diamond", "gemstone", "pearl", "cufflink", "brooch"),
    "pet": ("pet", "dog", "cat", "food", "toy", "bed", "collar", "leash", "carrier", "grooming", "litter", "treat", "vitamin", "medicine"),
    "office": ("office", "desk", "chair", "monitor", "keyboard", "mouse", "printer", "paper", "pen", "notebook", "folder", "binder", "stapler", "scissors", "tape", "envelope"),
}


def worth(keyword: str) -> float:
    """A keyword counts a tenth a letter, 1 at most, and a tenth more, 1 at most."""
    return min(1.0, min(1.0, len(keyword) / 10) + 0.1)


def score(text: Column, words: tuple[str, ...]) -> Column:
    """The most that any keyword in the text counts; longer ones are tried first."""
    out = F.lit(0.0)
    for w in sorted(words, key=worth):
        out = F.when(text.contains(w), worth(w)).otherwise(out)
    return out


def scores(text: Column, table: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    return F.array(*[F.struct(score(text, words).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, words) in enumerate(table.items())])


def best(text: Column, table: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """struct(score, order, name) of the best category, the first of equals, or `other` where none has a keyword."""
    top = F.array_max(scores(text, table))
    return F.when(top["score"] > 0, top).otherwise(F.struct(F.lit(0.1).alias("score"), F.lit(-99).alias("order"), F.lit("other").alias("name")))


def kept(text: Column, least: float = 0.7, table: dict[str, tuple[str, ...]] = CATEGORIES) -> Column:
    """Names of all categories whose score is at least so much."""
    return F.transform(F.filter(scores(text, table), lambda s: s["score"] >= least), lambda s: s["name"])


def oracle(rows: str, key: str) -> str:
    """SQL of best() over rows (key, x)."""
    parts = []
    for k, (name, words) in enumerate(CATEGORIES.items()):
        got = "greatest(0.0, " + ", ".join(f"CASE WHEN contains(x, '{w}') THEN {worth(w)!r} ELSE 0.0 END" for w in words) + ")"
        parts.append(f"SELECT {key}, {k} AS o, '{name}' AS name, CAST({got} AS DOUBLE) AS s FROM rows")
    return f"WITH rows AS ({rows}), s AS ({' UNION ALL '.join(parts)}), b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, o) AS rn FROM s) SELECT {key}, CASE WHEN s > 0 THEN name ELSE 'other' END AS category, CASE WHEN s > 0 THEN s ELSE 0.1 END AS confidence FROM b WHERE rn = 1"


def counted(text: Column, taxonomy: dict[str, tuple[str, ...]], source: Column | None = None, metadata: list[Column] = ()) -> Column:
    """struct(category, confidence, matched) by whole-word matches of a taxonomy given as a parameter: a tenth a match, 1 at
    most; 0.3 more where the source's category holds or is part of the name, 0.15 more a keyword in a metadata value."""
    word = lambda w: rf"(?i)\b{re.escape(w)}\b"
    low, rows = F.lower(text), []
    for k, (name, words) in enumerate(taxonomy.items()):
        hits = sum((F.regexp_count(low, F.lit(word(w))) for w in words), F.lit(0))
        score = F.least(hits * 0.1, F.lit(1.0))
        extra = F.lit(0.0)
        if source is not None:
            given = F.lower(source)
            extra = extra + F.when((given != "") & (F.contains(given, F.lit(name)) | F.contains(F.lit(name), given)), 0.3).otherwise(0.0)
        for value in metadata:
            extra = extra + sum((F.when(F.lower(value).rlike(word(w)), 0.15).otherwise(0.0) for w in words), F.lit(0.0))
        matched = F.array_compact(F.array(*[F.when(low.rlike(word(w)), F.lit(w)) for w in words]))
        rows.append(F.struct(F.round(score + extra, 9).alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name"), F.array_sort(F.array_distinct(matched)).alias("matched")))
    top = F.array_max(F.array(*rows))
    none = F.struct(F.lit("other").alias("category"), F.lit(0.1).alias("confidence"), F.array().cast("array<string>").alias("matched"))
    return F.when(top["score"] > 0, F.struct(top["name"].alias("category"), F.least(top["score"], F.lit(1.0)).alias("confidence"), top["matched"].alias("matched"))).otherwise(none)


def taxonomy_path(category: Column, parents: dict[str, list[str]]) -> Column:
    """The category below the names that a taxonomy puts above it."""
    known = F.create_map(*[x for k, v in parents.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if parents else None
    above = F.coalesce(F.try_element_at(known, category), F.array().cast("array<string>")) if parents else F.array().cast("array<string>")
    return F.concat(above, F.array(category))
