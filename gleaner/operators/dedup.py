"""Deduplication of records: exact, within a window of arrivals, by SimHash, by title and by embedding."""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .ordering import PART, ROW, carried, ordered, ordinals


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by an order; a partial aggregate, so that a hot key is one row a task."""
    return df.join(df.groupBy(key).agg(F.min(order).alias("__first")), key).where(F.col(order) == F.col("__first")).drop("__first")


def marked(df: DataFrame, key: str, order: str) -> DataFrame:
    """df with `first` (the least order value of the row's key) and `duplicate`."""
    heads = df.groupBy(key).agg(F.min(order).alias("first"))
    return df.join(heads, key).withColumn("duplicate", F.col(order) != F.col("first"))


def within(df: DataFrame, key: str, order: str, rows: int) -> DataFrame:
    """df with `ordinal` and `repeat`: whether the key came among the given number of arrivals before. A key that is hot fills
    several ranges; each knows the last arrival in those before."""
    placed = ordered(ordinals(df, order), key, "ordinal")
    last = F.coalesce(F.lag("ordinal").over(Window.partitionBy(PART, key).orderBy(ROW)), F.col("__last"))
    numbered = carried(placed, key, F.max("ordinal"), F.max("__sum"), "__last")
    return numbered.withColumn("repeat", F.coalesce(F.col("ordinal") - last <= rows, F.lit(False))).drop("__last", PART, ROW)


def simhash_counts(docs: DataFrame, id_: str, c: str) -> DataFrame:
    """SimHash of every text as a bit string: one pass with Arrow over batches, as 64 votes per n-gram are arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        import numpy as np

        for b in batches:
            out = []
            for t in b[c]:
                w = [x for x in " ".join((t or "").lower().split()).split(" ") if x]
                grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
                bits = np.unpackbits(np.frombuffer(b"".join(hashlib.md5(g.encode()).digest()[8:] for g in grams), np.uint8).reshape(-1, 8), axis=1)
                out.append("".join("1" if v > 0 else "0" for v in 2 * bits.sum(0, dtype=np.int64) - len(grams)))
            yield pd.DataFrame({id_: b[id_], "bits": out})

    return docs.select(id_, c).mapInPandas(run, f"{id_} long, bits string")


def hamming_pairs(signs: DataFrame, id_: str, most: int = 3, pieces: int = 6) -> DataFrame:
    """Pairs within a Hamming distance. The 64 bits are cut into `pieces`; `most` bits can spoil as many pieces at most, so a
    pair has all others in common and meets under that choice of pieces, which is about 32 bits long at 6 pieces. Equal bit
    strings are one class first, so that copies make no pairs among themselves (left and right are their least ids)."""
    edges = [round(64 * k / pieces) for k in range(pieces + 1)]
    classes = signs.groupBy("bits").agg(F.min(id_).alias("id")).select("id", *[F.conv(F.substring("bits", k, 32), 2, 10).cast("long").alias(n) for k, n in ((1, "high"), (33, "low"))], "bits")
    chosen = list(combinations(range(pieces), pieces - most))
    keys = F.array(*[F.concat(F.lit(f"{n}:"), *[F.substring("bits", edges[k] + 1, edges[k + 1] - edges[k]) for k in c]) for n, c in enumerate(chosen)])
    cut = classes.select("id", "high", "low", F.explode(keys).alias("key"))
    other = cut.select(F.col("id").alias("right"), F.col("high").alias("high2"), F.col("low").alias("low2"), "key")
    far = F.bit_count(F.col("high").bitwiseXOR(F.col("high2"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("low2")))
    return cut.join(other, "key").where(F.col("id") < F.col("right")).where(far <= most).select(F.col("id").alias("left"), "right", far.alias("distance")).distinct()


def spoiled(n: Column, threshold: float) -> Column:
    """How many of the n bigrams of a title (the first with a mark before it) a title of the ratio can lack at most.

    Matching blocks are in order, so all that they leave out are deletions, which spoil two bigrams each, and insertions,
    which spoil one. Their number for a partner of m characters follows from the threshold; the most is at the shortest
    partner that the ratio allows, or at the longest."""
    short, long = threshold / (2 - threshold), (2 - threshold) / threshold
    return F.floor(n * max(2 * (1 - short), long - 1) + 1e-9).cast("int")


def title_grams(title: str) -> dict:
    """A title's bigrams, each with how many of its kind came before it, so that they are a set; and 512 bits of which each
    of them sets one."""
    seen: dict[str, int] = {}
    grams, bits = [], 0
    for k in range(len(title)):
        gram = title[k - 1 : k + 1] if k else f"\n{title[0]}"
        seen[gram] = n = seen.get(gram, -1) + 1
        grams.append(f"{gram}{n}")
        bits |= 1 << (zlib.crc32(grams[-1].encode("utf-8", "replace")) & 511)
    return {"grams": grams, "bits": [int.from_bytes((bits >> at & (1 << 64) - 1).to_bytes(8, "little"), "little", signed=True) for at in range(0, 512, 64)]}


def ratios(old: pd.Series, new: pd.Series, threshold: float) -> list[float]:
    """Ratio of matching blocks, 0 where common characters alone rule the threshold out."""
    from difflib import SequenceMatcher

    out, m, last = [], SequenceMatcher(None), None
    for b, a in zip(old, new, strict=True):
        if b != last:  # what is kept of the second text serves all pairs with it
            m.set_seq2(b)
            last = b
        m.set_seq1(a)
        out.append(m.ratio() if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold else 0.0)
    return out


def fuzzy_titles(df: DataFrame, id_: str, title: str, threshold: float = 0.9) -> DataFrame:
    """Pairs (left, right, ratio) of different titles whose matching blocks reach the ratio; none is missed.

    A title's bigrams are ordered by rarity. Two titles of the ratio share all but `spoiled` of either's bigrams, so they
    share one of the rarest spoiled + 1 of both. They meet on such a bigram, in bands of length that the ratio spans, and
    only where the bigrams after it could still make up what is needed, and where their bits differ in no more places than
    there can be bigrams of one alone. The exact ratio comes from an Arrow function."""
    keys = df.select(F.col(id_).alias("id"), F.col(title).alias("t")).where("t is not null and t <> ''").groupBy("t").agg(F.min("id").alias("id"))
    read = F.udf(title_grams, "struct<grams: array<string>, bits: array<long>>", useArrow=True)
    held = keys.select("id", F.length("t").alias("n"), read("t").alias("g"))
    gram = held.select("id", "n", *[F.col("g.bits")[k].alias(f"b{k}") for k in range(8)], F.explode("g.grams").alias("w"))
    many = gram.groupBy("w").agg(F.count("*").alias("df"))
    rarest = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    rare = gram.join(many, "w").withColumn("rank", rarest).where(F.col("rank") <= spoiled(F.col("n"), threshold) + 1)
    band = F.floor(F.log("n") / math.log((2 - threshold) / threshold)).cast("int")
    bits = [f"b{k}" for k in range(8)]
    a = rare.select("w", band.alias("band"), "id", "n", "rank", *bits).alias("a")
    b = rare.select("w", F.explode(F.array(band - 1, band, band + 1)).alias("band"), "id", "n", "rank", *bits).alias("b")
    # what of each is left from this bigram on, against what they must share
    left = F.least(F.col("a.n") - F.col("a.rank"), F.col("b.n") - F.col("b.rank")) + 1
    shared = F.greatest(F.col("a.n") - spoiled(F.col("a.n"), threshold), F.col("b.n") - spoiled(F.col("b.n"), threshold))
    fits = (F.col("a.id") < F.col("b.id")) & (2 * F.least("a.n", "b.n") >= threshold * (F.col("a.n") + F.col("b.n"))) & (left >= shared)
    # a character that the blocks leave out spoils three bigrams at most, of both titles together
    apart = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"a.{k}").bitwiseXOR(F.col(f"b.{k}"))) for k in bits])
    fits = fits & (apart <= 3 * (1 - threshold) * (F.col("a.n") + F.col("b.n")) + 1e-6)
    near = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col("a.band") == F.col("b.band")) & fits).select(F.col("a.id").alias("left"), F.col("b.id").alias("right")).distinct()
    old, new = (keys.select(F.col("id").alias(side), F.col("t").alias(t)) for side, t in (("left", "old"), ("right", "new")))
    near = near.join(old, "left").join(new, "right")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"left": x["left"], "right": x["right"], "ratio": ratios(x["old"], x["new"], threshold)})

    return near.mapInPandas(run, "left long, right long, ratio double").where(F.col("ratio") >= threshold)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def similar(vectors: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(query_id, vec_id, score) of cosine similarity at or above a threshold: queries in packed blocks meet shards of vectors.
    Vectors that are null or zero, or hold nulls or what is no finite number, are like nothing; lengths must agree."""
    import numpy as np

    fine = F.exists("embedding", lambda c: c != 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors, queries = vectors.where(fine), queries.where(fine)

    schema = "query_id long, vec_id long, score double"
    spark, parts, block = vectors.sparkSession, [], []

    def sent(rows: list) -> DataFrame:
        ids, q = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
        held = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x = np.array(b["embedding"].tolist(), np.float64)
                s = held.value[1] @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                i, j = np.nonzero(s >= threshold)
                ids = b["vec_id"].to_numpy()
                ok = held.value[0][i] != ids[j]
                yield pd.DataFrame({"query_id": held.value[0][i][ok], "vec_id": ids[j][ok], "score": s[i, j][ok]})

        return vectors.select("vec_id", "embedding").mapInPandas(run, schema)

    for r in queries.select("vec_id", "embedding").toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == 8192:
            parts.append(sent(block))
            block = []
    if block:
        parts.append(sent(block))
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
