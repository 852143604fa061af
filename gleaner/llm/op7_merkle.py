"""Merkle fixity audit of WARC replicas.

A replica is a sequence of WARC records; a record's leaf is the SHA-256 of its offset and of the SHA-256 of its header and
body, which the scan takes, so that no page moves between tasks. Records lie in order in ranges of RANGE numbers, and a range's tree has FAN children a node: an inner node hashes its
children's hashes in order. Levels are DataFrames, a groupBy each, up to one root. The audit compares roots and goes down
one level at a time with the nodes that differ, so that of an intact replica only the root is read, and of a damaged one
only the branches above damage. A record that only one replica has differs in its leaf.

Offsets come from range totals: within a range by a window, across ranges by a sum of totals (a row a range).

Defined results: a null url or html is an empty one; records are numbered by page_id (null first), then url and digest, so
repeated rows each are a record; both replicas empty are alike and give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, only, table, written

FAN = 64

ORACLE_SQL = r"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), b AS (
  SELECT page_id, url, html, strlen(html) AS n,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
         || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
         || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) AS head
  FROM r
), h AS (SELECT *, sha256(head || html || chr(13) || chr(10) || chr(13) || chr(10)) AS leaf FROM b
), o AS (
  SELECT *, row_number() OVER w - 1 AS record, strlen(head) + n + 4 AS size,
         CAST(sum(strlen(head) + n + 4) OVER w AS BIGINT) - (strlen(head) + n + 4) AS start
  FROM h WINDOW w AS (ORDER BY page_id NULLS FIRST, url, leaf ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT page_id, CAST(record AS BIGINT) AS record, CAST(start AS BIGINT) AS start, CAST(size AS BIGINT) AS size,
       sha256(CAST(start AS VARCHAR) || ':' || leaf) AS leaf,
       substr(md5('rot-' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 1) = '0' AND substr(md5('rot-' || coalesce(CAST(page_id AS VARCHAR), '')), 2, 1) < '4' AND n > 0 AS corrupt
FROM o
"""


def header(url: Column, page_id: Column, html: Column) -> Column:
    """Fixed format: a WARC 1.1 response record's header."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )


def digest(html: Column, url: Column | None = None, page_id: Column | None = None) -> Column:
    """SHA-256 of a record's header and body."""
    return F.sha2(F.concat(header(F.col("url") if url is None else url, F.col("page_id") if page_id is None else page_id, html), html, F.lit("\r\n\r\n")), 256)


def records(pages: DataFrame, ranges: int, **copies: Column) -> DataFrame:
    """page_id, record number, start offset, size and leaf of every page, as one WARC sequence; a further leaf for each
    further replica, given as the html it holds."""
    given = only(pages, "page_id", "url", "html").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    held = {"leaf": F.col("html"), **copies}
    size = F.octet_length(header(F.col("url"), F.col("page_id"), F.col("html"))) + F.octet_length("html") + 4
    # the partition a row comes from is the last key: equal records, which are alike in all that follows, are dealt apart
    slim = given.select("page_id", "url", F.spark_partition_id().alias("from"), size.cast("long").alias("size"), *[digest(html).alias(name) for name, html in held.items()])
    placed = slim.repartitionByRange(ranges, F.col("page_id").asc_nulls_first(), "url", "leaf", "from").drop("from").withColumn("part", F.spark_partition_id())
    placed = written(placed, "warc")  # the ranges now are data, whatever runs again
    inside = Window.partitionBy("part").orderBy(F.col("page_id").asc_nulls_first(), "url", "leaf")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    numbered = placed.withColumn("k", F.row_number().over(inside) - 1).withColumn("b", F.sum("size").over(upto) - F.col("size")).join(F.broadcast(starts), "part")
    start = F.col("b") + F.col("b0")
    leaves = [F.sha2(F.concat(start.cast("string"), F.lit(":"), F.col(name)), 256).alias(name) for name in held]
    return numbered.select("page_id", (F.col("k") + F.col("n0")).cast("long").alias("record"), start.alias("start"), "size", *leaves)


def parents(level: DataFrame, fan: int) -> DataFrame:
    """The level above (node, hash): each node hashes its children's hashes in order."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x["hash"])  # fan children at most
    return level.groupBy(F.floor(F.col("node") / fan).cast("long").alias("up")).agg(F.sha2(F.array_join(own, ","), 256).alias("hash")).withColumnRenamed("up", "node")


def tree(leaves: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """Levels (node, hash) from the leaves (record, leaf) to a root; its height is the logarithm of their number."""
    levels = [checkpointed(leaves.select(F.col("record").alias("node"), F.col("leaf").alias("hash")))]
    most = levels[0].agg(F.max("node")).first()[0]
    while most:
        levels.append(checkpointed(parents(levels[-1], fan)))
        most //= fan
    return levels


def damaged(a: list[DataFrame], b: list[DataFrame], fan: int = FAN) -> DataFrame:
    """Numbers of the records whose leaves differ: from the top down, below nodes that differ."""
    while len(a) < len(b):
        a = [*a, parents(a[-1], fan)]
    while len(b) < len(a):
        b = [*b, parents(b[-1], fan)]
    found = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if found is not None:
            up = found.withColumnRenamed("node", "up")
            x, y = (z.join(up, F.floor(z["node"] / fan) == up["up"], "left_semi") for z in (x, y))
        y = y.withColumnRenamed("hash", "other")
        found = checkpointed(x.join(y, "node", "full").where("not (hash <=> other)").select("node"))
        if found.isEmpty():
            break
    return found


def rotten(page_id: Column) -> Column:
    """Which records of the audited copy get a flipped character: about one in 64, by the md5 of the id."""
    h = F.md5(F.concat(F.lit("rot-"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return (F.substring(h, 1, 1) == "0") & (F.substring(h, 2, 1) < "4")


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as a WARC replica, audited against a copy in which some records rotted; a row per record."""
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bad = rotten(F.col("page_id")) & (F.length("html") > 0)
    rot = F.when(bad, F.concat(F.translate(F.substring("html", 1, 1), "<a", "a<"), F.lit("\u0001"), F.expr("substring(html, 3)"))).otherwise(F.col("html"))
    kept = written(records(table(spark, sf_dir, "pages"), ranges, copy=rot), "leaves")
    found = damaged(tree(kept), tree(kept.select("record", F.col("copy").alias("leaf")))).withColumnRenamed("node", "record").withColumn("corrupt", F.lit(True))
    return kept.join(found, "record", "left").select("page_id", "record", "start", "size", "leaf", F.coalesce("corrupt", F.lit(False)).alias("corrupt"))
