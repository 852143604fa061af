"""A store of what has been seen, over batches: entries with a time to live, and membership behind a Bloom sketch.

A sketch is a table (word, mask) of at most WORDS rows: keys set bits, and sketches of parts, days or sources are merged by
a union and one more aggregate. What it rules out needs no exact look-up and so no shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

WORDS = 1 << 17
PROBES = 4


def entries(events: DataFrame, key: str, ts: str, ttl_seconds: float) -> DataFrame:
    """key, created, last_seen, hits (all arrivals, the first included) and expired of every entry.

    An entry lives ttl_seconds from its first arrival; the first arrival after that opens the next. Each round takes one
    entry of every key, by partial aggregates, and what lies behind it goes on: there are as many rounds as a key's arrivals
    have lifetimes. Expired is what ended before the last arrival of all. A null key is a key; a null time is no arrival."""
    ttl = int(ttl_seconds * 1_000_000)
    rest = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at")).where("at is not null")
    last = rest.agg(F.max("at").alias("last"))
    rounds = []
    while True:
        first = rest.groupBy("key").agg(F.min("at").alias("created")).withColumnRenamed("key", "of")
        opened = rest.join(first, F.col("key").eqNullSafe(F.col("of"))).drop("of")
        rounds.append(opened.where(F.col("at") <= F.col("created") + ttl).groupBy("key", "created").agg(F.max("at").alias("last_seen"), F.count("*").alias("hits")))
        rest = checkpointed(opened.where(F.col("at") > F.col("created") + ttl).select("key", "at"))
        if rest.isEmpty():
            break
    found = reduce(DataFrame.unionByName, rounds).join(F.broadcast(last))  # one row
    return found.select("key", *[F.timestamp_micros(c).alias(c) for c in ("created", "last_seen")], "hits", (F.col("created") + ttl < F.col("last")).alias("expired"))


def bits(key: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(WORDS * 64)) for k in range(PROBES)]


def sketch(keys: DataFrame, key: str) -> DataFrame:
    """Bloom sketch (word, mask) of a table's keys; null keys are left out."""
    set_ = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*bits(F.col(key)))).alias("bit"))
    return set_.groupBy(F.shiftright("bit", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketch of all keys of several."""
    return reduce(DataFrame.unionByName, sketches).groupBy("word").agg(F.bit_or("mask").alias("mask"))


def maybe(key: Column, filled: DataFrame) -> Column:
    """Whether a sketch may hold a key: false is certain. WORDS rows at most go through the driver, 1 MB as one broadcast."""
    spark = filled.sparkSession
    table = np.zeros(WORDS, np.int64)
    for word, mask in filled.toLocalIterator():
        table[word] = mask
    sent = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def probe(*at: pd.Series) -> pd.Series:
        ok = np.ones(len(at[0]), bool)
        for bit in at:
            b = bit.to_numpy(np.int64)
            ok &= (sent.value[b >> 6] >> (b & 63)) & 1 == 1
        return pd.Series(ok)

    return probe(*bits(key))


def looked_up(df: DataFrame, key: str, store: DataFrame, store_key: str, filled: DataFrame | None = None) -> DataFrame:
    """df with `seen`: whether the store holds the row's key. Rows that the sketch rules out are new and meet no join; the
    others are looked up exactly. A null key is never seen."""
    checked = df.withColumn("__maybe", F.col(key).isNotNull() & maybe(F.col(key), filled if filled is not None else sketch(store, store_key)))
    known = store.select(F.col(store_key).alias("__known")).where("__known is not null").distinct().withColumn("__seen", F.lit(True))
    exact = checked.where("__maybe").join(known, F.col(key) == F.col("__known"), "left").withColumn("seen", F.coalesce("__seen", F.lit(False))).drop("__known", "__seen", "__maybe")
    return checked.where("not __maybe").drop("__maybe").withColumn("seen", F.lit(False)).unionByName(exact)
