"""Resharding by minimum-cost flow (law `bytes`: the new shards' sizes are near equal).

Rows fall in blocks by the hash of their text, so that equal texts lie together; a block belongs to an old shard. Block
sizes are summed (BUCKETS * PARTS rows at most, whatever the input) and the driver solves the flow: old shards supply
their bytes, new shards take up to their capacities, staying costs nothing and moving costs a byte a byte. Blocks then
fill the flows, the largest first, so that a shard differs from its capacity by less than one block for each old shard;
a block over half of a new shard (one text on very many rows) is first dealt into PARTS by the rows' places. Shards that
gain or lose a block are written anew, each task writing its rows to every shard's folder, so
that no text is shuffled; untouched shards stay as they are. Sizes, checksums and slots are read back from those files.

Defined results: a row's size is its text's UTF-8 bytes (null: none) plus 1; its checksum is that of the text (null: 0).
Slots order a shard by block, then doc_id (null first), checksum and size; repeated rows get a slot each. An empty table
gives no rows. write() keeps all columns, under a prefix where a name clashes with its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table, table_path

SHARDS = 8
OLD_SHARDS = 5
BUCKETS = 2048
PARTS = 64
SPLIT = 2  # a block over this share of a new shard is split


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """Flow from each supply to each capacity, of least total cost, by successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # edge: to, room, cost, place of its reverse

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * len(graph)
    while True:
        far: list[float] = [float("inf")] * len(graph)
        came: list[tuple[int, list[int]] | None] = [None] * len(graph)
        far[source] = 0
        heap: list[tuple[float, int]] = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if e[1] and (new := d + e[2] + potential[a] - potential[e[0]]) < far[e[0]]:
                    far[e[0]], came[e[0]] = new, (a, e)
                    heapq.heappush(heap, (new, e[0]))
        if came[sink] is None:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far, strict=True)]
        path, at = [], sink
        while at != source:
            a, e = came[at]
            path.append(e)
            at = a
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    return [[next(graph[n + j][e[3]][1] for e in graph[i] if e[0] == n + j) for j in range(m)] for i in range(n)]


@dataclass
class Plan:
    shard: dict[tuple[int, int], int]  # (bucket, part): new shard
    flow: list[list[int]]
    moved: int  # bytes that change shard
    touched: set[int]


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


def plan(cells: Sequence[tuple[int, int, int, int]], shards: int, capacity: Sequence[int] | None = None) -> Plan:
    """cells: (old shard, bucket, part, bytes). Without capacities the new shards are even."""
    total = sum(c[3] for c in cells)
    capacity = list(capacity or even(total, shards))
    if sum(capacity) < total:
        raise ValueError("the capacities hold less than there is")
    n_old = max((c[0] for c in cells), default=-1) + 1
    supply = [0] * n_old
    blocks: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for old, bucket, part, size in cells:
        supply[old] += size
        blocks.setdefault((old, bucket), []).append((size, bucket, part))
    flow = min_cost_flow(supply, capacity, [[int(i != j) for j in range(shards)] for i in range(n_old)])
    units: list[list[tuple[int, list[tuple[int, int]]]]] = [[] for _ in range(n_old)]
    for (old, _), parts in blocks.items():
        size = sum(p[0] for p in parts)
        if size * SPLIT * shards > total:
            units[old] += [(p[0], [p[1:]]) for p in parts]
        else:
            units[old].append((size, [p[1:] for p in parts]))
    shard, moved, touched = {}, 0, set()
    room = [[c for c in row] for row in flow]
    for old in range(n_old):
        for size, members in sorted(units[old], reverse=True):
            left = room[old]
            to = old if old < shards and left[old] >= size else max(range(shards), key=lambda j: (left[j], j == old, -j))
            left[to] -= size
            for m in members:
                shard[m] = to
            if to != old:
                moved += size
                touched |= {old, to}
    return Plan(shard, flow, moved, touched)


def size_of() -> Column:
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1


def bucket() -> Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(BUCKETS)).cast("int")


def part() -> Column:
    """By a row's place in its partition, so that rows alike in every column part too. What is planned and what is written may
    see other places after a loss; then a split text's parts are of slightly other sizes, and each row still is written once."""
    at = F.monotonically_increasing_id()
    return F.pmod(at + F.shiftright(at, 6) * 37 + F.shiftright(at, 33) * 11, F.lit(PARTS)).cast("int")


def old_shard(old_shards: int) -> Column:
    """A layout that grew unevenly: a text's hash decides, and the first shards hold more."""
    h = F.pmod(F.xxhash64(bucket(), F.lit(3)), F.lit(old_shards * (old_shards + 1) // 2))
    out = F.lit(old_shards - 1)
    edge = 0
    cases = []
    for k in range(old_shards):
        edge += old_shards - k
        cases.append((edge, k))
    for e, k in reversed(cases):
        out = F.when(h < e, k).otherwise(out)
    return out.cast("int")


def keyed(docs: DataFrame, old_shards: int = OLD_SHARDS) -> DataFrame:
    return docs.withColumns({"__old": old_shard(old_shards), "__bucket": bucket(), "__part": part()})


def cells(docs: DataFrame, old_shards: int = OLD_SHARDS) -> list[tuple[int, int, int, int]]:
    """Bytes of each cell: BUCKETS * PARTS rows at most."""
    sums = keyed(only(docs, "doc_id", "text"), old_shards).groupBy("__old", "__bucket", "__part").agg(F.sum(size_of()).alias("bytes"))
    return [tuple(r) for r in sums.collect()]


def assigned(docs: DataFrame, p: Plan, old_shards: int = OLD_SHARDS) -> DataFrame:
    """docs with __old, __bucket, __part and the new __shard; the map has BUCKETS * PARTS numbers at most."""
    numbers = [p.shard.get((b, k), 0) for b in range(BUCKETS) for k in range(PARTS)]
    known = F.from_json(F.lit(str(numbers)), "array<int>")
    return keyed(docs, old_shards).withColumn("__shard", F.element_at(known, F.col("__bucket") * PARTS + F.col("__part") + 1))


def write(docs: DataFrame, p: Plan, path: str, old_shards: int = OLD_SHARDS, touched_only: bool = True) -> None:
    """Rewrite the shards that the plan changes, a folder __shard=k each."""
    rows = assigned(docs, p, old_shards)
    if touched_only:
        rows = rows.where(F.col("__shard").isin(sorted(p.touched)) if p.touched else F.lit(False))
    rows.write.option("compression", "zstd").partitionBy("__shard").parquet(path)


def slots(files: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of written rows."""
    slim = files.select("doc_id", size_of().alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32"), F.col("__shard").alias("shard"), (F.col("__bucket") * PARTS + F.col("__part")).alias("cell"))
    counts = slim.groupBy("shard", "cell").agg(F.count("*").alias("rows"))  # a row for each cell, BUCKETS * PARTS at most
    first = counts.withColumn("first", F.sum("rows").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("shard", "cell").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")) - 1
    return slim.withColumn("own", own).join(F.broadcast(first.drop("rows")), ["shard", "cell"]).withColumn("slot", (F.coalesce("first", F.lit(0)) + F.col("own")).cast("long"))


def reshard(docs: DataFrame, shards: int = SHARDS, old_shards: int = OLD_SHARDS) -> DataFrame:
    """Plan, rewrite and read back: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    given = only(docs, "doc_id", "text")
    p = plan(cells(given, old_shards), shards)
    path = table_path(spark, "shards")
    write(given, p, path, old_shards, touched_only=False)  # the table itself has no old shards' files to leave
    schema = "doc_id long, text string, __old int, __bucket int, __part int, __shard int"
    done = slots(spark.read.schema(schema).parquet(path))
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard(table(spark, sf_dir, "documents"))
