"""Global order without one task: rows lie in sorted ranges, and totals of the ranges carry over from one to the next.

The ranges are checkpointed, as bounds are sampled anew each time a plan runs: what is counted and what is numbered must be
the same ranges. Broadcast are totals: a row a range, or two where a key is carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpointed

PART, ROW = "__part", "__row"


def ordered(df: DataFrame, *keys: str | Column, parts: int | None = None) -> DataFrame:
    """df in sorted ranges of the keys, with the range's number and, from 0, the row's in it. As many ranges as the session's
    shuffles, or as df's input has partitions where these are more."""
    parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    at = F.monotonically_increasing_id()  # the range's number and, below 2^33, the row's
    return checkpointed(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumns({PART: F.shiftright(at, 33).cast("int"), ROW: at.bitwiseAND((1 << 33) - 1)}))


def earlier(placed: DataFrame, total: Column, name: str) -> DataFrame:
    """placed with the sum of a total over all ranges before the row's."""
    totals = placed.groupBy(PART).agg(total.alias("__sum"))
    before = F.sum("__sum").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(totals.select(PART, F.coalesce(before, F.lit(0)).alias(name))), PART)


def carried(placed: DataFrame, key: str, total: Column, over: Column, name: str) -> DataFrame:
    """placed, ordered by the key first, with what earlier ranges hold of a row's key: `total` of each, put together by the
    aggregate `over` of `__sum`; null where none holds it. Only the first and last key of a range can lie in another."""
    edges = placed.groupBy(PART).agg(F.min(F.struct(F.col(key).isNotNull().alias("n"), F.col(key).alias("k"))).alias("a"), F.max(F.struct(F.col(key).isNotNull().alias("n"), F.col(key).alias("k"))).alias("b"))
    several = edges.select(F.explode(F.array("a", "b")).alias("e")).groupBy("e").count().where("count > 1").select(F.col("e.k").alias("__key"))
    own = placed.join(F.broadcast(several), F.col(key).eqNullSafe(F.col("__key")), "left_semi").groupBy(PART, key).agg(total.alias("__sum"))
    before = over.over(Window.partitionBy(key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    known = own.select(F.col(PART).alias("__p"), F.col(key).alias("__key"), before.alias(name))
    return placed.join(F.broadcast(known), (F.col(PART) == F.col("__p")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__p", "__key")


def upto(df: DataFrame, key: str, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with the sum of a value over all rows up to and with this one, by a unique key."""
    placed = earlier(ordered(df.withColumn("__value", value), key, parts=parts), F.sum("__value"), "__before")
    inside = F.sum("__value").over(Window.partitionBy(PART).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn(name, inside + F.col("__before")).drop("__value", "__before", PART, ROW)


def ordinals(df: DataFrame, *keys: str | Column, name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """df with rows numbered from 1 by keys that are unique together."""
    return earlier(ordered(df, *keys, parts=parts), F.count("*"), "__before").withColumn(name, F.col("__before") + F.col(ROW) + 1).drop("__before", PART, ROW)
