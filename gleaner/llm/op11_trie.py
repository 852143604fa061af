"""Conversation prefix trie in preorder intervals.

1. Turns are numbered within their conversation, and rebuilt conversations get a digest for each prefix: the exclusive or
   of 128-bit digests of (place, role, text). Rows lie in ranges of (conversation, place), so a long conversation fills
   many ranges; what its earlier ranges add up to is a row for each range. A node is a depth and a digest.
2. Rebuilt conversations with the same turns are one from here on, with a weight. They are ranked in lexicographic order
   (turns compare by digest, a prefix is before what goes on from it). A conversation's sort key has only its turns after
   a node with several children, as only these tell conversations apart; equal keys lie on one path and go by length. So a
   key is as long as there are branches on the path, however long the conversation.
3. A node's members have neighbouring ranks. Ordered by least rank, then depth, nodes are in preorder, and a subtree ends
   at the last node whose least rank is the subtree's greatest. With prefix sums of leaves and savings over that order, by
   ranges and a row of totals a range, a subtree's sums are differences of two of them.
4. The ids that end at a node are joined in pieces by ranges, and the pieces hashed in order, row by row.

Defined results: turns of equal number go by role, then by the md5 of the text, so repeated rows each are a turn; null role
or text is empty; rows with a null conv_id belong to no conversation and take no part; c % 100 is the remainder with c's
sign; no conversations give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_table, only, table, written

HEADS, BASES = 6, 100
PIECE = 1 << 16
NODE = ["depth", "x1", "x2"]
NONE = hashlib.sha256(b"").hexdigest()

ORACLE_SQL = """
WITH k AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc
), i AS (
  SELECT DISTINCT conv_id AS c, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL
), hs AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda j: CAST(ascii(s[j]) AS BIGINT))), lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % 6 AS h
  FROM i, k
), own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS o, coalesce(role, '') AS r, coalesce(text, '') AS x
  FROM conversations WHERE conv_id IS NOT NULL
), many AS (SELECT c, count(*) AS n FROM own GROUP BY c
), reb AS (
  SELECT hs.c, b.o AS pos, b.r, b.x FROM hs JOIN own b ON b.c = hs.base AND b.o <= hs.h
  UNION ALL
  SELECT hs.c, w.o - hs.h + least(hs.h, coalesce(m.n, 0)), w.r, w.x FROM hs JOIN own w ON w.c = hs.c AND w.o > hs.h LEFT JOIN many m ON m.c = hs.base
), seq AS (
  SELECT hs.c, coalesce(list(md5(length(r) || ':' || r || x) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns,
         coalesce(list(length(x) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS chars
  FROM hs LEFT JOIN reb ON reb.c = hs.c GROUP BY hs.c
), pre AS (
  SELECT c, unnest(range(0, len(turns) + 1)) AS d, turns, chars FROM seq
), nodes AS (
  SELECT d, turns[1:d] AS node, min(c) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars[d]), 0) AS own_chars,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(turns) = d), '')) AS ends
  FROM pre GROUP BY d, turns[1:d]
), kids AS (
  SELECT node[1:d - 1] AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY node[1:d - 1]
), below AS (
  SELECT n.node[1:a.d] AS node, count(*) FILTER (kids.n_children IS NULL) AS leaves, sum((n.n_convs - 1) * n.own_chars) AS saved
  FROM nodes n JOIN (SELECT DISTINCT d FROM nodes) a ON a.d <= n.d LEFT JOIN kids ON kids.node = n.node GROUP BY n.node[1:a.d]
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(coalesce(kids.n_children, 0) AS BIGINT) AS n_children,
       CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN below ON below.node = n.node LEFT JOIN kids ON kids.node = n.node LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[1:n.d - 1]
"""


def halves(text: Column) -> list[Column]:
    """The 128-bit digest of a text as two longs."""
    digest = F.md5(text)
    return [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]


def ranges_of(df: DataFrame) -> int:
    """As many ranges as the input has partitions, or the session's shuffles."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def laid(df: DataFrame, ranges: int, *keys) -> DataFrame:
    """df in ranges of the keys, sorted, with the range's number as part."""
    return df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())


def runs(keys: np.ndarray) -> np.ndarray:
    """Where in sorted keys a new one begins; the first place always."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n: a row's number among the rows of its conversation in this range."""
    last, held = None, 0
    for b in batches:
        if not len(b):
            continue
        conv = b["conv"].to_numpy(np.int64)
        begin = runs(conv)
        n = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b)))) + 1
        if conv[0] == last:
            n[: begin[1] if len(begin) > 1 else None] += held
        last, held = conv[-1], int(n[-1])
        yield b.assign(n=n)


def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """x1, x2: exclusive or of a conversation's g1, g2 up to a row, in this range."""
    last, held = None, {"x1": 0, "x2": 0}
    for b in batches:
        if not len(b):
            continue
        conv = b["conv"].to_numpy(np.int64)
        begin = runs(conv)
        many = np.diff(np.append(begin, len(b)))
        for x, g in (("x1", "g1"), ("x2", "g2")):
            upto = np.bitwise_xor.accumulate(b[g].to_numpy(np.int64))
            before = np.where(begin > 0, upto[begin - 1], 0)
            if conv[0] == last:
                before[0] ^= held[x]
            b[x] = upto ^ np.repeat(before, many)
            held[x] = b[x].iloc[-1]
        last = conv[-1]
        yield b


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """position, leaves, saved: sums of rows, of leaf and of own up to a row, in this range."""
    at = {"position": 0, "leaves": 0, "saved": 0}
    for b in batches:
        if len(b):
            for name, part in (("position", np.ones(len(b), np.int64)), ("leaves", b["leaf"].to_numpy(np.int64)), ("saved", b["own"].to_numpy(np.int64))):
                b[name] = at[name] + np.cumsum(part)
                at[name] = int(b[name].iloc[-1])
            yield b


def carried(placed: DataFrame, **sums: Column) -> DataFrame:
    """placed with what the earlier ranges hold of a row's conversation. Only a range's first and last conversation can
    lie in others too: what is broadcast has two rows a range."""
    edges = placed.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    both = edges.select(F.explode(F.array("low", "high")).alias("conv")).groupBy("conv").count().where("count > 1").select("conv")
    own = placed.join(F.broadcast(both), "conv", "left_semi").groupBy("part", "conv").agg(*[c.alias(f"own_{k}") for k, c in sums.items()])
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = {k: F.sum(f"own_{k}") if k == "n0" else F.bit_xor(f"own_{k}") for k in sums}
    own = own.select("part", "conv", *[F.coalesce(c.over(before), F.lit(0)).alias(k) for k, c in over.items()])
    joined = placed.join(F.broadcast(own), ["part", "conv"], "left")
    return joined.withColumns({k: F.coalesce(k, F.lit(0)) for k in sums})


def offset(placed: DataFrame, **sums: Column) -> DataFrame:
    """placed with the totals of the ranges before a row's own: a row a range is broadcast."""
    totals = placed.groupBy("part").agg(*[c.alias(f"own_{k}") for k, c in sums.items()])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(F.broadcast(totals.select("part", *[F.coalesce(F.sum(f"own_{k}").over(before), F.lit(0)).alias(k) for k in sums])), "part")


def numbered(turns: DataFrame) -> DataFrame:
    """conv, turn number (ordinal, from 1), the digest of role and text (c1, c2) and the text's code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c1, c2 = halves(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    slim = only(turns, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), F.md5(text).alias("tie"), c1.alias("c1"), c2.alias("c2"),
        F.length(text).cast("long").alias("chars"), F.spark_partition_id().alias("from"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "tie", "from"]  # the last deals equal rows apart
    placed = laid(slim, ranges_of(turns), *order).select("conv", "c1", "c2", "chars", "part")
    placed = written(placed.mapInPandas(counted, "conv long, c1 long, c2 long, chars long, part int, n long"), "turns")
    return carried(placed, n0=F.count("*")).select("conv", (F.col("n") + F.col("n0")).alias("ordinal"), "c1", "c2", "chars")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, total) and their turns (conv, depth, total, c1, c2, chars) after the first turns of each were
    exchanged for those of conversation conv - conv % BASES."""
    base = F.col("conv") - F.col("conv") % BASES
    first = own.where((F.col("conv") == base) & (F.col("ordinal") < HEADS)).groupBy(F.col("conv").alias("base")).agg(F.array_sort(F.collect_list(F.struct("ordinal", "c1", "c2", "chars"))).alias("first"))
    h = F.crc32(F.col("conv").cast("string")) % HEADS
    convs = own.groupBy("conv").agg(F.count("*").alias("n")).withColumn("base", base).join(first, "base", "left")
    convs = convs.select("conv", "n", h.alias("h"), F.when(F.col("first").isNotNull(), F.slice("first", F.lit(1), h.cast("int"))).otherwise(F.expr("slice(array(named_struct('ordinal', 0L, 'c1', 0L, 'c2', 0L, 'chars', 0L)), 1, 0)")).alias("first"))
    kept = F.size("first").cast("long")
    convs = written(convs.select("conv", "h", "first", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    heads = convs.select("conv", "total", F.explode("first").alias("t")).select("conv", F.col("t.ordinal").alias("depth"), "total", "t.c1", "t.c2", "t.chars")
    tails = own.join(convs.select("conv", "h", "kept", "total"), "conv").where("ordinal > h").select("conv", (F.col("ordinal") - F.col("h") + F.col("kept")).alias("depth"), "total", "c1", "c2", "chars")
    return convs, heads.unionByName(tails)


def paths_of(turns: DataFrame, ranges: int) -> tuple[DataFrame, DataFrame]:
    """The written ranges, and turns with the digest of the prefix that each ends (x1, x2) and its own part in that (g1, g2)."""
    g1, g2 = halves(F.concat_ws(":", F.col("depth").cast("string"), F.col("c1").cast("string"), F.col("c2").cast("string")))
    placed = laid(turns.select("conv", "depth", "total", "chars", g1.alias("g1"), g2.alias("g2")), ranges, "conv", "depth")
    placed = written(placed.mapInPandas(chained, "conv long, depth long, total long, chars long, g1 long, g2 long, part int, x1 long, x2 long"), "paths")
    return placed, carried(placed, y1=F.bit_xor("g1"), y2=F.bit_xor("g2")).select("conv", "depth", "total", "chars", "g1", "g2", F.col("x1").bitwiseXOR(F.col("y1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("x2"))


def up(*, alias: bool = True) -> list[Column]:
    """A node's parent, as a node."""
    out = [F.col("depth") - 1, F.col("x1").bitwiseXOR(F.col("g1")), F.col("x2").bitwiseXOR(F.col("g2"))]
    return [c.alias(f"up_{k}") for c, k in zip(out, NODE, strict=True)] if alias else out


def ending(enders: DataFrame, ranges: int) -> DataFrame:
    """For each node at which conversations (conv) end: SHA-256 of their ids in order. Ids are joined to pieces by ranges,
    so that of a node where very many end one task reads pieces of PIECE ids, one after the other, and keeps none."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            keys = b[NODE].to_numpy(np.int64)
            begin = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            ids, out = b["conv"].tolist(), []
            for a, z in zip(begin, np.append(begin[1:], len(b)), strict=True):
                out += [(*keys[a].tolist(), ids[k], ",".join(map(str, ids[k : min(k + PIECE, z)]))) for k in range(a, z, PIECE)]
            yield pd.DataFrame(out, columns=[*NODE, "least", "ids"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for *key, ids in b[[*NODE, "ids"]].itertuples(index=False):
                if key == now:
                    state.update(b"," + ids.encode())
                else:
                    if state:
                        out.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if state:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*NODE, "ends_sha256"])

    key = "depth long, x1 long, x2 long"
    cut = enders.select(*NODE, "conv").repartitionByRange(ranges, *NODE, "conv").sortWithinPartitions(*NODE, "conv").mapInPandas(pieces, f"{key}, least long, ids string")
    return cut.repartition(ranges, *NODE).sortWithinPartitions(*NODE, "least").mapInPandas(hashes, f"{key}, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    its preorder position (from 1) with that of the last node of its subtree."""
    ranges = ranges_of(turns)
    own = numbered(turns)
    convs, new = rebuilt(own)
    placed, paths = paths_of(new, ranges)
    zero = F.lit(0).cast("long")
    enders = paths.where("depth = total").select("conv", *NODE).union(convs.where("total = 0").select("conv", zero, zero, zero))
    ends = written(enders.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("weight")), "ends")
    root = ends.agg(F.min("conv").alias("conv"), F.sum("weight").alias("weight")).first()

    # one conversation for each end, and which of its turns come after a branch
    steps = paths.join(ends.select("conv", "weight"), "conv")
    children = written(steps.select(*NODE, "g1", "g2").distinct().groupBy(*up()).agg(F.count("*").alias("n_children")), "children")
    turned = F.struct("depth", F.struct("g1", "g2").alias("g")).alias("turn")
    branching = children.where("n_children > 1 and up_depth > 0").select(*[f"up_{k}" for k in NODE])
    forks = steps.where("depth > 1").select("conv", turned, *up()).join(branching, [f"up_{k}" for k in NODE]).select("conv", "turn")
    forks = forks.union(steps.where("depth = 1").select("conv", turned))
    keys = forks.groupBy("conv").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda t: t["g"]).alias("key"))
    # conversations without turns have no key, and nulls are first
    sorted_ = ends.join(keys, "conv", "left").repartitionByRange(ranges, F.col("key").asc_nulls_first(), "depth").sortWithinPartitions(F.col("key").asc_nulls_first(), "depth")
    place = F.monotonically_increasing_id()  # the range's number and, below 2^33, the row's within it
    ranked = written(sorted_.select("conv", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("row")), "ranks")
    ranked = offset(ranked, n0=F.count("*")).select("conv", (F.col("row") + F.col("n0")).alias("rank"))

    # nodes in preorder
    first, last = F.min("rank").alias("first"), F.max("rank").alias("last")
    nodes = steps.join(ranked, "conv").groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.sum("weight").alias("n_convs"), F.first("chars").alias("chars"), F.first("g1").alias("g1"), F.first("g2").alias("g2"), first, last)
    top = ranked.groupBy().agg(first, last).where("first is not null").select(*[zero.alias(k) for k in NODE], F.lit(root["conv"]).cast("long").alias("conv_id"), F.lit(root["weight"]).cast("long").alias("n_convs"), zero.alias("chars"), zero.alias("g1"), zero.alias("g2"), "first", "last")
    many = children.select(*[F.col(f"up_{k}").alias(k) for k in NODE], "n_children")
    nodes = nodes.unionByName(top).join(many, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("own", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")
    types = "depth long, x1 long, x2 long, conv_id long, n_convs long, g1 long, g2 long, first long, last long, n_children long, leaf long, own long, part int"
    names = [t.split()[0] for t in types.split(", ")]
    ordered = laid(nodes, ranges, "first", "depth").select(*names).mapInPandas(summed, f"{types}, position long, leaves long, saved long")
    ordered = written(ordered, "nodes")
    upto = {"position": F.count("*"), "leaves": F.sum("leaf"), "saved": F.sum("own")}
    whole = offset(ordered.withColumnsRenamed({k: f"in_{k}" for k in upto}), **upto).withColumns({k: F.col(k) + F.col(f"in_{k}") for k in upto})
    # the last node of least rank r is the end of conversation r: sums grow along the order
    closing = whole.groupBy(F.col("first").alias("last")).agg(*[F.max(k).alias(f"end_{k}") for k in upto])
    parents = ordered.select(*[F.col(k).alias(f"up_{k}") for k in NODE], F.col("conv_id").alias("of_parent")).where("up_depth > 0")
    out = whole.withColumns(dict(zip([f"up_{k}" for k in NODE], up(alias=False), strict=True))).join(closing, "last").join(parents, [f"up_{k}" for k in NODE], "left").join(ending(enders, ranges), NODE, "left")
    of_parent = F.when(F.col("depth") > 1, F.col("of_parent")).when(F.col("depth") == 1, F.lit(root["conv"]).cast("long"))
    out = out.select(
        "conv_id", "depth", of_parent.alias("parent_conv_id"), "n_convs", "n_children", (F.col("end_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("end_saved") - F.col("saved") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"), "position", F.col("end_position").alias("subtree_end"),
    )
    out = written(out, "trie")
    for x in (convs, placed, ends, children, ordered):
        drop_table(x)
    return out


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("position", "subtree_end")
