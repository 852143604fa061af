"""Operational metrics: rollups, percentiles by index, histograms, rates, streaks and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import PART, ROW, carried, ordered

#: Upper bounds of histogram buckets.
BUCKETS = (10.0, 25.0, 50.0, 75.0, 100.0, 250.0)


def rollup(df: DataFrame, key: str, ok: Column, latency: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.avg(latency).alias("avg_latency"), (F.count_if(ok) / F.count("*")).alias("success_rate"))


def ranks(df: DataFrame, key: str, value: str, parts: int | None = None) -> DataFrame:
    """(key, value, upto, all): for each distinct value of a key how many rows are no greater, and how many there are. Counts
    lie in ranges of (key, value), so that a key's values are as many ranges as they fill."""
    placed = ordered(df.groupBy(key, value).agg(F.count("*").alias("n")), key, value, parts=parts)
    inside = F.sum("n").over(Window.partitionBy(PART, key).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    summed = carried(placed, key, F.sum("n"), F.sum("__sum"), "__before").withColumn("upto", inside + F.coalesce("__before", F.lit(0)))
    whole = placed.groupBy(F.col(key).alias("__k")).agg(F.sum("n").alias("all"))
    return summed.join(whole, F.col(key).eqNullSafe(F.col("__k"))).drop("__k", "__before", "n", PART, ROW)


def by_index(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Per key the value at index int(n * share) of the ascending order."""
    at = lambda s: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("all") * s), F.col("all") - 1), F.col(value)))
    return ranks(df, key, value).groupBy(key).agg(*[at(s).alias(name) for name, s in shares.items()])


def exclusive(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """(key, q): the quantile at place share * (n + 1), between the values on both sides of it."""
    place = share * (F.col("all") + 1)
    low, high = (F.min(F.when(F.col("upto") >= F.floor(place) + k, F.col(value))) for k in (0, 1))
    g = ranks(df, key, value).groupBy(key).agg(low.alias("v"), high.alias("w"), F.max(place - F.floor(place)).alias("f"))
    return g.select(key, (F.col("v") + F.col("f") * (F.coalesce("w", "v") - F.col("v"))).alias("q"))


def histogram(df: DataFrame, key: str, value: str, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(key, le, n): cumulative counts, the last bound infinite."""
    row = df.groupBy(key).agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count("*").alias("all"))
    cells = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)] + [F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n"))]
    return row.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.le", "c.n")


def quantile(buckets: DataFrame, key: str, q: float) -> DataFrame:
    """(key, q) by linear interpolation within the bucket that holds the quantile; the last finite bound beyond."""
    w = Window.partitionBy(key).orderBy("le")
    b = buckets.withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(w), F.lit(0))).withColumn("want", F.max("n").over(Window.partitionBy(key)) * q)
    hit = b.where(F.col("n") >= F.col("want"))
    value = F.when(F.col("le") == float("inf"), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * (F.col("want") - F.col("below")) / F.greatest(F.col("n") - F.col("below"), F.lit(1)))
    return hit.groupBy(key).agg(F.min_by(value, "le").alias("q"))


def rate(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Rows a second over the seconds up to each row. A row also goes to the next stretch of as many seconds, whose rows may
    look back at it, so that a window holds two stretches of a key and never all of it."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    stretch = F.floor(micros / (seconds * 1_000_000))
    both = df.withColumn("__at", micros).withColumn("__s", F.explode(F.array(F.struct(stretch.alias("k"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("k"), F.lit(False).alias("own")))))
    w = Window.partitionBy(key, "__s.k").orderBy("__at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return both.withColumn("rate", F.count("*").over(w) / seconds).where("__s.own").drop("__at", "__s")


def streaks(df: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """Length of the run of equal outcomes up to each row."""
    w = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("__ok", ok).withColumn("__turn", F.sum(F.when(F.col("__ok") != F.lag("__ok").over(w), 1).otherwise(0)).over(w))
    return marked.withColumn("streak", F.row_number().over(Window.partitionBy(key, "__turn").orderBy(order))).drop("__ok", "__turn")


def holds_for(df: DataFrame, key: str, order: str, condition: Column, rows: int) -> DataFrame:
    """df with `alert`: the condition held on this row and on as many before as are asked for."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(rows - 1), 0)
    held = F.min(condition.cast("int")).over(w)
    return df.withColumn("alert", (held == 1) & (F.count("*").over(w) == rows))


def worst(statuses: Column) -> Column:
    """Health of a whole from the array of its parts."""
    has = lambda s: F.array_contains(statuses, s)
    return F.when(F.size(statuses) == 0, "unknown").when(has("unhealthy"), "unhealthy").when(has("degraded"), "degraded").otherwise("healthy")


def holds_since(df: DataFrame, key: str, ts: str, condition: Column, seconds: int, order: str | None = None) -> DataFrame:
    """df with `alert`: whether the condition has held, without a reading that breaks it, for so long up to this reading. Rows
    lie in ranges of key and time; what a range must know of those before is the key's last reading that broke it and, after
    that, the first that held."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    ok = F.coalesce(condition, F.lit(False))
    placed = ordered(df.withColumns({"__at": at, "__ok": ok}), key, "__at", *([order] if order else []))
    upto = Window.partitionBy(PART, key).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    # the run of rows that hold begins after the last break in this range, or goes on from the ranges before
    broken = F.max(F.when(~F.col("__ok"), F.col(ROW))).over(upto)
    placed = placed.withColumn("__broke", broken)
    own = F.min(F.when(F.col("__ok"), F.col("__at"))).over(Window.partitionBy(PART, key, "__broke").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("__start", own)
    # of each earlier range: its number, whether it broke, and since when its end holds
    tail = F.struct(F.max(PART).alias("p"), F.bool_or(~F.col("__ok")).alias("broke"), F.max_by(F.when(F.col("__ok"), F.col("__start")), ROW).alias("since"))
    told = carried(placed, key, tail, F.collect_list("__sum"), "__before")  # a row for each range that the key fills
    none = F.lit(None).cast("long")
    since = F.aggregate(F.coalesce("__before", F.array().cast("array<struct<p:int,broke:boolean,since:bigint>>")), none, lambda held, x: F.when(x["broke"], x["since"]).otherwise(F.coalesce(held, x["since"])))
    start = F.when(F.col("__broke").isNull(), F.coalesce(since, F.col("__start"))).otherwise(F.col("__start"))
    return told.withColumn("alert", F.col("__ok") & (F.col("__at") - start >= seconds * 1_000_000)).drop("__at", "__ok", "__broke", "__start", "__before", PART, ROW)
