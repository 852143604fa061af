"""N-gram Jaccard join: MinHash bands find candidates, full sets of word n-grams decide.

1. Sketch: every text becomes its set of n-grams (NGRAM words, as 64-bit numbers; a text of fewer words is one n-gram).
   Texts with equal sets are one class; a class is its set's 128-bit digest. Bands and rows are chosen for the recall asked
   for at the threshold (bands_for). Only digests, sizes and band hashes are shuffled.
2. Candidates: within a bucket (a band and its hash) each class points to the bucket's least class; connected components
   of these stars hold every pair of classes that shares a bucket, at a row per class and band and without pairs.
3. Verify: one text of each class in a component of two or more is read again and its set is sent to the component,
   once per pair of blocks: a component is cut into blocks of about BLOCK classes, classes that point to the same least
   class side by side. Only pairs of blocks that share a bucket, and whose set sizes allow the threshold, are compared, so
   that chance candidates, which join components, don't make all of these meet. Each pair of blocks is a product of 0/1
   matrices, so pairs are counted, never emitted: a row per class with its number of links, and links enough to connect
   what is linked.
4. Classes linked are connected; a document's links are the documents of the classes its own is linked to, and the
   others of its own.

Defined results: a null or wordless text links to nothing and is a class of its own; repeated rows and copies link to
each other; class_id is the least doc_id of the class (null if all are null; null doc_ids are otherwise last); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, only, spread, table, trim, words, written

NGRAM = 5
THRESHOLD = 0.8
RECALL = 0.995
BLOCK = 256
SEED = 20_240_101
BLOOM = 1 << 18
CHUNK = 1 << 20  # n-grams times permutations held at once


def bands_for(threshold: float, recall: float, noise: float = 0.5, most: int = 512) -> tuple[int, int]:
    """Bands and rows with at least the recall at the threshold, and then the fewest chance candidates at `noise`."""
    best = None
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if bands * rows <= most:
            cost = 1 - (1 - noise**rows) ** bands + bands * rows / 4000
            if best is None or cost < best[0]:
                best = (cost, bands, rows)
    return best[1], best[2]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """n-gram numbers of texts; word numbers are remembered in a bounded memo."""

    def __init__(self, n: int):
        self.n, self.memo = n, {}

    def word(self, w: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct n-grams of a text."""
        found = words(text)
        if not found:
            return np.empty(0, np.uint64)
        memo = self.memo
        if len(memo) > 1 << 19:
            memo.clear()
        ids = list(map(memo.get, found))
        if None in ids:
            for k, (w, i) in enumerate(zip(found, ids, strict=True)):
                if i is None:
                    if (i := memo.get(w)) is None:
                        i = memo[w] = self.word(w)
                    ids[k] = i
        a = np.array(ids, np.uint64)
        n = min(self.n, len(a))
        h = np.full(len(a) - n + 1, n, np.uint64)
        for k in range(n):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + a[k : len(a) - n + 1 + k])
        h.sort()
        return h[np.append(True, h[1:] != h[:-1])]


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of a set under each permutation."""
    out = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    step = max(1, CHUNK // len(a))
    for k in range(0, len(grams), step):
        x = grams[k : k + step]
        np.minimum(out, ((a[:, None] * x + b[:, None]) >> np.uint64(32)).astype(np.uint32).min(1), out=out)
    return out


def sketches(docs: DataFrame, ngram: int, bands: int, rows: int) -> DataFrame:
    """doc_id, h (hash of the text), n (n-grams), set (digest) and the bands' hashes of every document."""
    a, b = permutations(bands * rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = Hasher(ngram)
        for batch in batches:
            n, digest, bucket = [], [], []
            for text in batch["text"].tolist():
                grams = grams_of(text if isinstance(text, str) else None)
                n.append(len(grams))
                digest.append(hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest() if len(grams) else None)
                if len(grams):
                    s = signature(grams, a, b).reshape(bands, rows).astype(np.uint64)
                    h = np.arange(1, bands + 1, dtype=np.uint64)
                    for k in range(rows):
                        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + s[:, k])
                    bucket.append(h.view(np.int64))
                else:
                    bucket.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], "n": n, "set": digest, "bands": bucket})
        del grams_of
        trim()

    given = spread(only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")))
    return given.mapInPandas(run, "doc_id long, h long, n int, set string, bands array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph of (a, b): the least node of each component.

    Every node points to a root, at first to its least neighbour. In each round a root learns of lesser roots across the
    edges and is hooked to the least, then every node takes its root's root; it ends when no edge joins two roots. A round
    is a few joins on nodes and ends in a checkpoint; their number grows with the logarithm of the longest path.
    """
    both = edges.where("a <> b")
    label = checkpointed(both.select(F.col("a").alias("node"), F.col("b").alias("to")).union(both.select(F.col("b"), F.col("a"))).groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("root")))
    while True:
        root = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        one = both.join(root, "a").join(label.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        lower = one.where("ra <> rb").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("less")).groupBy("root").agg(F.min("less").alias("less"))
        lower = checkpointed(lower)
        if lower.isEmpty():
            return label
        step = label.join(lower, "root", "left").select("node", F.coalesce("less", "root").alias("root"))
        up = step.select(F.col("node").alias("root"), F.col("root").alias("over"))
        label = checkpointed(step.join(up, "root", "left").select("node", F.coalesce("over", "root").alias("root")))


def compared(a: list[np.ndarray], b: list[np.ndarray], threshold: float, same: bool) -> np.ndarray:
    """Which sets of a and b are alike enough, as a matrix; `same`: a and b are one list and only pairs count."""
    every = np.concatenate(a if same else [*a, *b])
    sorted_ = np.sort(every)
    shared = sorted_[1:][sorted_[1:] == sorted_[:-1]]
    shared = shared[np.append(True, shared[1:] != shared[:-1])[: len(shared)]]
    size_a, size_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not len(shared):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        hit = shared[at] == flat
        return row[hit], at[hit]

    (ra, ca), (rb, cb) = places(a), places(b)
    both = np.zeros((len(a), len(b)), np.float32)
    step = 8192
    for k in range(0, len(shared), step):
        x, y = np.zeros((len(a), step), np.float32), np.zeros((len(b), step), np.float32)
        ia, ib = (ca >= k) & (ca < k + step), (cb >= k) & (cb < k + step)
        x[ra[ia], ca[ia] - k] = 1
        y[rb[ib], cb[ib] - k] = 1
        both += x @ y.T
    union = size_a[:, None] + size_b[None, :] - both
    alike = both >= threshold * union - 1e-6
    if same:
        alike &= ~np.eye(len(a), dtype=bool)
    return alike


def forest(rows: np.ndarray, cols: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Enough of the given links to connect what they connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(rows.tolist(), cols.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def verified(members: DataFrame, threshold: float, ngram: int, partitions: int) -> DataFrame:
    """From (root, left, right, side, set, members, text): a row per class and pair of blocks with its linked documents and classes, and
    rows (set, other) that connect what is linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams_of = Hasher(ngram)
        at, names, sizes, sets, sides = None, [], [], [], []

        def close() -> pd.DataFrame:
            same = at[1] == at[2]
            left = [k for k, s in enumerate(sides) if s == 0]
            right = left if same else [k for k, s in enumerate(sides) if s == 1]
            if not left or not right:
                return pd.DataFrame(columns=["set", "other", "links"])
            alike = compared([sets[k] for k in left], [sets[k] for k in right], threshold, same)
            size = np.array(sizes, np.int64)
            links = np.zeros(len(names), np.int64)
            links[left] += alike @ size[right]
            if not same:
                links[right] += alike.T @ size[left]
            i, j = np.nonzero(alike)
            edges = forest(np.array(left)[i], np.array(right)[j], len(names))
            out = [(names[k], None, int(links[k])) for k in range(len(names)) if links[k]] + [(names[a], names[b], 0) for a, b in edges]
            return pd.DataFrame(out, columns=["set", "other", "links"])

        done: list[pd.DataFrame] = []
        for batch in batches:
            for root, left, right, side, name, size, text in zip(batch["root"], batch["left"].tolist(), batch["right"].tolist(), batch["side"].tolist(), batch["set"], batch["members"].tolist(), batch["text"], strict=True):
                if (root, left, right) != at:
                    if at is not None:
                        done.append(close())
                    at, names, sizes, sets, sides = (root, left, right), [], [], [], []
                names.append(name)
                sizes.append(size)
                sides.append(side)
                sets.append(grams_of(text))
            if len(done) > 256:
                yield pd.concat(done)
                done = []
        if at is not None:
            done.append(close())
        if done:
            yield pd.concat(done)
        del grams_of
        trim()

    keyed = members.repartition(partitions, "root", "left", "right").sortWithinPartitions("root", "left", "right", "side", "set")
    return keyed.mapInPandas(run, "set string, other string, links long")


def joined(docs: DataFrame, ngram: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, h, class (its name), class_id, class_size and n_links of every document."""
    spark = docs.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    bands, rows = bands_for(threshold, recall)
    sketch = written(sketches(docs, ngram, bands, rows), "sketches")
    classes = sketch.where("set is not null").groupBy("set").agg(F.min_by(F.struct("doc_id", "h"), F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("rep"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # a class's node is half of its digest: should two classes share one, they are candidates of each other and no more
    classes = checkpointed(classes.withColumn("node", F.conv(F.substring("set", 2, 15), 16, 10).cast("long")))
    # stars: a bucket's least node, for buckets with more than one
    dealt = classes.select("node", F.explode("bands").alias("bucket"))
    least = dealt.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = checkpointed(dealt.join(least, "bucket"))
    stars = shared.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    near = components(checkpointed(stars))
    centre = shared.groupBy("node").agg(F.min("least").alias("centre"))
    member = near.join(centre, "node").join(classes.select("node", "set", "rep", "members", "n"), "node")
    member = checkpointed(blocked(member, block))
    # pairs of blocks that share a bucket; the blocks' size ranges, a row each, rule out what can't reach the threshold
    held = shared.select("node", "bucket").join(member.select("node", "root", "block"), "node").select("root", "bucket", "block").distinct()
    meet = held.withColumnRenamed("block", "left").join(held.withColumnRenamed("block", "right"), ["root", "bucket"]).where("left <= right").select("root", "left", "right").distinct()
    ranges = member.groupBy("root", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    left, right = (ranges.select("root", F.col("block").alias(s), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high")) for s in ("left", "right"))
    fits = (F.col("right_low") * threshold <= F.col("left_high") + 1e-6) & (F.col("left_low") * threshold <= F.col("right_high") + 1e-6)
    pairs = meet.join(left, ["root", "left"]).join(right, ["root", "right"]).where(fits)
    sides = pairs.select("root", "left", "right", F.explode(F.when(F.col("left") == F.col("right"), F.array(F.struct(F.col("left").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("left").alias("block"), F.lit(0).alias("side")), F.struct(F.col("right").alias("block"), F.lit(1).alias("side"))))).alias("s")).select("root", "left", "right", "s.block", "s.side")
    placed = member.join(sides, ["root", "block"]).select("root", "left", "right", "side", "set", "members", "rep")
    texts = perhaps(only(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")), member.select(F.xxhash64("rep.doc_id", "rep.h").alias("key")))
    wanted = member.select("set", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("k"))
    full = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).groupBy("set").agg(F.first("text").alias("text"))
    checked = verified(placed.drop("rep").join(full, "set"), threshold, ngram, partitions)
    checked = checkpointed(checked)
    links = checked.where("other is null").groupBy("set").agg(F.sum("links").alias("links"))
    linked = components(checked.where("other is not null").select(F.col("set").alias("a"), F.col("other").alias("b")))
    named = classes.select("set", "rep", "members").join(linked.withColumnRenamed("node", "set"), "set", "left").join(links, "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = named.groupBy("root").agg(F.min("rep.doc_id").alias("class_id"), F.sum("members").alias("class_size"))
    named = named.join(heads, "root").select("set", F.col("root").alias("class"), "class_id", "class_size", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    alone = sketch.where("set is null").select("doc_id", "h", F.concat(F.lit("alone "), F.col("h").cast("string")).alias("class"), F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"))
    return sketch.where("set is not null").select("doc_id", "h", "set").join(named, "set").drop("set").select("doc_id", "h", "class", "class_id", "class_size", "n_links").unionByName(alone)


def perhaps(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts (doc_id, text, h) without most rows whose key is not among keys: a Bloom filter of fixed size (BLOOM words of 64
    bits) saves their shuffle, and lets more of them pass where keys are very many; the join that follows is what decides."""
    bit = lambda k: F.pmod(F.xxhash64("key", F.lit(k)), F.lit(BLOOM * 64))
    bits = keys.select(F.explode(F.array(*[bit(k) for k in range(3)])).alias("bit"))
    filled = bits.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(bit, 64) as int))")).alias("mask"))
    table_ = np.zeros(BLOOM, np.uint64)
    for word, mask in filled.toLocalIterator():  # BLOOM rows at most
        table_[word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
    sent = texts.sparkSession.sparkContext.broadcast(table_)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = np.ones(len(b), bool)
            for k in range(3):
                at = b[f"b{k}"].to_numpy(np.int64)
                ok &= (sent.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
            yield b.loc[ok, ["doc_id", "text", "h"]]

    probed = texts.withColumn("key", F.xxhash64("doc_id", "h")).select("doc_id", "text", "h", *[bit(k).alias(f"b{k}") for k in range(3)])
    return probed.mapInPandas(run, "doc_id long, text string, h long")


def blocked(member: DataFrame, block: int) -> DataFrame:
    """member with its block's number in its component: classes of a centre lie side by side, in as many blocks as they fill."""
    from pyspark.sql import Window

    by_centre = member.groupBy("root", "centre").agg(F.count("*").alias("many"))
    upto = Window.partitionBy("root").orderBy("centre").rowsBetween(Window.unboundedPreceding, -1)
    before = by_centre.withColumn("before", F.coalesce(F.sum("many").over(upto), F.lit(0)))
    # within a centre, a hash spreads classes evenly over as many blocks as they fill
    first = F.floor(F.col("before") / block)
    span = F.floor((F.col("before") + F.col("many") - 1) / block) - first + 1
    return member.join(before, ["root", "centre"]).withColumn("block", (first + F.pmod(F.xxhash64("set"), span)).cast("long")).drop("many", "before", "centre")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("h", "class")
