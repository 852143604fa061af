"""Mixing sources to target weights by Pareto order sampling.

Targets: sources by code point (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at MOST times its
source's size and the excess is shared again by weight, which is a level: target = min(MOST * size, level * weight).
Every document is first taken as many whole times as its source's target holds its size. The rest of the target is a
Pareto sample whose size is fixed in words: inclusion probabilities grow as the root of a document's size, scaled so that
the expected words of the sample are that rest; where a probability would reach 1 the document is certain and the others
are scaled anew. Documents are ranked by the odds of a random number over their odds of inclusion, certain ones first, and
taken in that order until the words are full; in the bin of the cut, ROUNDS passes fill the gap with the next that fit.
Of rows alike at the cut as many are taken as fit.

Nothing is sorted as a whole: the scale comes from a histogram of sizes, and ranks fall in bins whose sums (a row each)
find the bin in which a source's cut lies; only that bin's rows are ordered. Bins are as many as the root of a source's
documents, so that neither their number nor what one holds grows in proportion. Rows alike in (doc_id, text, source) are
one unit with one rank, so that a hot row is one; where a part of a unit is taken, its rows are numbered by the partitions
they lie in, and the first get a copy more. The random number is the md5 of the doc_id, so that reruns agree.

Defined results: a null text has size 0; rows of size 0 are no words and are taken as often as the whole copies of their
source; null sources are one source; sources of no words get target 0; a null doc_id draws as an empty id; no document is
taken more than MOST times; an empty table gives no rows; other columns are ignored (mixed() keeps all of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, only, table

WEIGHTS = (5, 2, 1)
MOST = 3
ROUNDS = 3
SIZE = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5e0) / 4503599627370496e0 AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s
), lv AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
         3 * source_size / CAST(weight AS DOUBLE) AS full_at,
         CAST(coalesce(sum(3 * source_size) OVER b, 0) AS BIGINT) AS full_before,
         CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER b, 0) AS BIGINT) AS weight_left
  FROM w WINDOW b AS (ORDER BY 3 * source_size / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT max((total - full_before) / CAST(weight_left AS DOUBLE)) FILTER (WHERE (total - full_before) / CAST(weight_left AS DOUBLE) <= full_at) AS level FROM lv
), t AS (
  SELECT source, source_size, n, least(3e0 * source_size, coalesce(level, 0) * weight) AS target FROM w CROSS JOIN l
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
         greatest(1, CAST(floor(sqrt(CAST(n AS DOUBLE)) / 4e0) AS BIGINT)) AS bins
  FROM t
), cr AS (SELECT *, target - whole * source_size AS rest FROM c
), z AS (
  SELECT d.source, d.size, cr.rest, count(*) AS n, CAST(floor(16e0 * sqrt(CAST(d.size AS DOUBLE))) AS BIGINT) AS w
  FROM d JOIN cr ON d.source IS NOT DISTINCT FROM cr.source WHERE d.size > 0 AND cr.rest > 0 GROUP BY d.source, d.size, cr.rest
), zz AS (
  SELECT *, (rest - CAST(coalesce(sum(size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT))
         / CAST(CAST(sum(w * size * n) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS DOUBLE) AS scale
  FROM z
), sc AS (SELECT source, max_by(scale, size) AS scale, max(size) AS most FROM zz WHERE scale * w < 1 GROUP BY source
), q0 AS (
  SELECT d.doc_id, d.h, d.source, d.size, d.u, count(*) AS same, d.size * count(*) AS unit, cr.rest, cr.bins, sc.most,
         greatest(sc.scale * CAST(floor(16e0 * sqrt(CAST(d.size AS DOUBLE))) AS BIGINT), 1e-12) AS p
  FROM d JOIN cr ON d.source IS NOT DISTINCT FROM cr.source JOIN sc ON d.source IS NOT DISTINCT FROM sc.source
  WHERE d.size > 0 AND cr.rest > 0
  GROUP BY d.doc_id, d.h, d.source, d.size, d.u, cr.rest, cr.bins, sc.most, sc.scale
), q AS (
  SELECT *, CASE WHEN size > most THEN 0e0 ELSE (u / (1 - u)) / (p / (1 - p)) END AS r FROM q0
), qb AS (SELECT *, CAST(floor(r / (1 + r) * bins) AS BIGINT) AS bin FROM q
), b AS (
  SELECT source, bin, sum(unit) AS words, any_value(rest) AS rest, sum(sum(unit)) OVER (PARTITION BY source ORDER BY bin) AS upto FROM qb GROUP BY source, bin
), cut AS (SELECT source, min(bin) AS cut, min_by(upto - words, bin) AS before FROM b WHERE upto > rest GROUP BY source
), k AS (
  SELECT qb.*, cut.cut, cut.before FROM qb LEFT JOIN cut ON qb.source IS NOT DISTINCT FROM cut.source
), r0 AS (
  SELECT *, rest - before AS gap, CAST(greatest(0, least(same, floor((rest - before - CAST(sum(unit) OVER (PARTITION BY source ORDER BY r, doc_id, h) - unit AS DOUBLE)) / size))) AS BIGINT) AS t0 FROM k WHERE bin = cut
), r1 AS (
  SELECT *, gap - sum(size * t0) OVER (PARTITION BY source) AS g1 FROM r0
), c1 AS (
  SELECT *, CASE WHEN size <= g1 THEN same - t0 ELSE 0 END AS m1, sum(CASE WHEN size <= g1 THEN size * (same - t0) ELSE 0 END) OVER (PARTITION BY source ORDER BY r, doc_id, h) AS s1 FROM r1
), r1b AS (
  SELECT *, t0 + CAST(greatest(0, least(m1, floor((g1 - CAST(s1 - size * m1 AS DOUBLE)) / size))) AS BIGINT) AS t1 FROM c1
), r2 AS (
  SELECT *, gap - sum(size * t1) OVER (PARTITION BY source) AS g2 FROM r1b
), c2 AS (
  SELECT *, CASE WHEN size <= g2 THEN same - t1 ELSE 0 END AS m2, sum(CASE WHEN size <= g2 THEN size * (same - t1) ELSE 0 END) OVER (PARTITION BY source ORDER BY r, doc_id, h) AS s2 FROM r2
), r2b AS (
  SELECT *, t1 + CAST(greatest(0, least(m2, floor((g2 - CAST(s2 - size * m2 AS DOUBLE)) / size))) AS BIGINT) AS t2 FROM c2
), r3 AS (
  SELECT *, gap - sum(size * t2) OVER (PARTITION BY source) AS g3 FROM r2b
), c3 AS (
  SELECT *, CASE WHEN size <= g3 THEN same - t2 ELSE 0 END AS m3, sum(CASE WHEN size <= g3 THEN size * (same - t2) ELSE 0 END) OVER (PARTITION BY source ORDER BY r, doc_id, h) AS s3 FROM r3
), r3b AS (
  SELECT *, t2 + CAST(greatest(0, least(m3, floor((g3 - CAST(s3 - size * m3 AS DOUBLE)) / size))) AS BIGINT) AS t3 FROM c3
), e AS (
  SELECT doc_id, h, source, CASE WHEN bin < cut OR cut IS NULL THEN same ELSE 0 END AS sel FROM k WHERE cut IS NULL OR bin <> cut
  UNION ALL SELECT doc_id, h, source, t3 FROM r3b
), dn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, h, source) AS number FROM d
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, c.source_size, c.target, CAST(d.size * (c.whole + CASE WHEN d.number <= coalesce(e.sel, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM dn d LEFT JOIN e ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.h = e.h AND d.source IS NOT DISTINCT FROM e.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n) with each source's target in words: a row per source, ordered twice."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int") + 1))
    full = F.col("source_size") * most / F.col("weight").cast("double")
    before = Window.orderBy(full, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double")
    levelled = weighed.withColumn("own", level).withColumn("level", F.max(F.when(F.col("own") <= full, F.col("own"))).over(every))
    return levelled.select("source", "source_size", "n", F.least(F.col("source_size") * F.lit(float(most)), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "source", "text").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce(F.regexp_count("text", F.lit(SIZE)), F.lit(0)).cast("long").alias("size"))


def scales(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(at, scale, most): what a source's roots of sizes are multiplied by to be probabilities, and the greatest size that
    isn't certain; from sums by size."""
    n = rows.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    known = n.join(plan.select(F.col("source").alias("at"), "rest").where("rest > 0"), F.col("source").eqNullSafe(F.col("at"))).drop("at").withColumn("w", root())
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.sum(F.col("w") * F.col("size") * F.col("n")).over(down.rowsBetween(0, Window.unboundedFollowing))
    found = known.withColumn("scale", (F.col("rest") - larger) / own.cast("double")).where("scale * w < 1")
    return found.groupBy(F.col("source").alias("at")).agg(F.max_by("scale", "size").alias("scale"), F.max("size").alias("most"))


def root() -> Column:
    return F.floor(F.lit(16.0) * F.sqrt(F.col("size").cast("double"))).cast("long")


def copies(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """From sized() rows: a row per unit (doc_id, h, source) with its source's size and target, the copies of each of its
    rows, and how many of them get one `more` (0 where all rows have the same copies)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    size, n = F.col("source_size"), F.col("n")
    plan = targets(sources, weights, most).select(
        "source", "source_size", "target",
        F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long").alias("whole"),
        F.greatest(F.lit(1), F.floor(F.sqrt(n.cast("double")) / 4.0)).cast("long").alias("bins"),
    ).withColumn("rest", F.col("target") - F.col("whole") * size)
    plan = checkpointed(plan)
    scale = checkpointed(scales(rows, plan))
    units = rows.groupBy("doc_id", "h", "source", "size").agg(F.count("*").alias("same"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("long") + 0.5) / 4503599627370496.0
    ranked = units.join(plan.withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at"))).drop("at")
    ranked = ranked.join(scale, F.col("source").eqNullSafe(F.col("at")), "left").drop("at").withColumn("p", F.greatest(F.col("scale") * root(), F.lit(1e-12)))
    # rank 0: certain; no rank: not in the sample
    odds = F.when(F.col("size") > F.col("most"), 0.0).otherwise((F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    ranked = ranked.withColumn("u", u).withColumn("r", F.when((F.col("size") > 0) & (F.col("rest") > 0), odds))
    ranked = ranked.withColumn("bin", F.floor(F.col("r") / (1 + F.col("r")) * F.col("bins")).cast("long")).withColumn("unit", F.col("size") * F.col("same"))
    ranked = checkpointed(ranked.select("doc_id", "h", "source", "size", "same", "unit", "source_size", "target", "whole", "rest", "r", "bin"))
    out = ranked.where("r is null").withColumn("sel", F.lit(0).cast("long"))
    ranked = ranked.where("r is not null")
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = ranked.groupBy("source", "bin").agg(F.sum("unit").alias("words"), F.first("rest").alias("rest")).withColumn("upto", F.sum("words").over(upto))
    cuts = bins.where("upto > rest").groupBy("source").agg(F.min("bin").alias("cut"), F.min_by(F.col("upto") - F.col("words"), "bin").alias("before")).withColumnRenamed("source", "at")
    placed = ranked.join(cuts, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")
    far = placed.where("cut is null or bin <> cut").withColumn("sel", F.when(F.coalesce(F.col("bin") < F.col("cut"), F.lit(True)), F.col("same")).otherwise(0))
    order = Window.partitionBy("source").orderBy("r", "doc_id", "h").rowsBetween(Window.unboundedPreceding, 0)
    whole_bin = Window.partitionBy("source")
    near = placed.where("bin = cut").withColumn("gap", F.col("rest") - F.col("before")).withColumn("sel", F.lit(0).cast("long")).withColumn("could", F.col("same")).withColumn("left", F.col("gap"))
    for k in range(rounds + 1):
        if k:
            near = near.withColumn("left", F.col("gap") - F.sum(F.col("size") * F.col("sel")).over(whole_bin))
            near = near.withColumn("could", F.when(F.col("size") <= F.col("left"), F.col("same") - F.col("sel")).otherwise(0))
        before = F.sum(F.col("size") * F.col("could")).over(order) - F.col("size") * F.col("could")
        fit = F.floor((F.col("left") - before.cast("double")) / F.col("size")).cast("long")
        near = near.withColumn("sel", F.col("sel") + F.greatest(F.lit(0), F.least(F.col("could"), fit)))
    all_of, part_of = (F.col("sel") == F.col("same")).cast("long"), F.when(F.col("sel") < F.col("same"), F.col("sel")).otherwise(0)
    cols = ["doc_id", "h", "source", "size", "source_size", "target", (F.col("whole") + all_of).alias("copies"), part_of.alias("more")]
    return far.select(*cols).unionByName(near.select(*cols)).unionByName(out.select(*cols))


def dealt(rows: DataFrame) -> DataFrame:
    """rows (__d, __k, __s, __copies, __more, others) where the first __more rows of each unit have one copy more. The units
    of which a part is taken are a few for each source; their rows are written, so that their order holds, and numbered
    within each partition, from what the unit has in partitions before."""
    unit = ["__d", "__k", "__s"]
    place = F.monotonically_increasing_id()
    some = checkpointed(rows.where("__more > 0")).withColumn("__at", place).withColumn("__part", F.shiftright("__at", 33))
    counts = some.groupBy(*unit, "__part").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"{c}2") for c in unit], F.col("__part").alias("__part2"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    numbered = some.withColumn("__own", F.row_number().over(Window.partitionBy(*unit, "__part").orderBy("__at")))
    on = F.col("__part") == F.col("__part2")
    for c in unit:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}2"))
    numbered = numbered.join(counts, on).withColumn("__copies", F.col("__copies") + (F.col("__own") + F.col("__before") <= F.col("__more")).cast("long"))
    return rows.where("__more = 0").unionByName(numbered.select(*rows.columns))


def chosen(rows: DataFrame, **options) -> DataFrame:
    """sized() rows with source_size, target and copies."""
    unit = copies(rows, **options).select(F.col("doc_id").alias("__d"), F.col("h").alias("__k"), F.col("source").alias("__s"), "source_size", "target", F.col("copies").alias("__copies"), F.col("more").alias("__more"))
    joined = rows.join(checkpointed(unit), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")))
    return dealt(joined).withColumn("copies", F.col("__copies")).drop("__d", "__k", "__s", "__copies", "__more")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with every row as often as the mix takes it."""
    names = docs.columns
    unit = copies(checkpointed(sized(docs)), **options).where("copies > 0 or more > 0").select(F.col("doc_id").alias("__d"), F.col("h").alias("__k"), F.col("source").alias("__s"), F.col("copies").alias("__copies"), F.col("more").alias("__more"))
    joined = docs.join(checkpointed(unit), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.md5(F.coalesce("text", F.lit(""))) == F.col("__k")) & F.col("source").eqNullSafe(F.col("__s")))
    rows = dealt(joined).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in names])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checkpointed(sized(table(spark, sf_dir, "documents")))
    return chosen(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
