"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Symbols are the bytes of a text's UTF-8, so that no character of any script is folded; an n-gram of ORDER bytes is one
number and all that backs it off are parts of that number. Trusted text: a logistic classifier on a few surface features,
fitted on at most SAMPLE labelled rows, is applied to every document; the counts come from all documents it trusts and
grow with the corpus.

1. Count: a task counts the n-grams of its trusted documents by blocks and sends each shard its keys and counts, packed;
   shards merge them, pieces of like size first. Lower orders' continuation counts, discounts, and the probabilities with
   their back-off weights follow order by order in joins on prefix and suffix (logarithms are kept in thousandths).
2. Join: each block asks every shard of the model once for its distinct n-grams. Questions of a shard are dealt over as
   many tasks as there are SALT_BYTES of text, each with a copy of the shard; the shard's model rows come first, then the
   questions one by one, so that a task holds a shard and a question.
3. Score: answers meet their block's text, which was sent once, compressed; each place gets its n-gram's logarithm, and
   sums by document give its perplexity. Blocks are cut alike in both scans; a checksum of the block's n-grams, which goes
   with questions and answers, proves it.
4. A document is rejected if its perplexity is above QUANTILE of the trusted documents of its language (null is a language
   of its own; a language without trusted documents takes the quantile over all), times MARGIN.

Defined results: null and empty texts have no perplexity and are rejected; without labels, or with labels of one class,
every text is trusted; without any trusted text everything with text is kept. Repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, only, spread, table, trim

ORDER = 5
BITS = 8
SYMBOLS = 1 << BITS
BLOCK = 4 << 20  # bytes of text
SALT_BYTES = 128 << 20
SAMPLE = 20_000
TRUST = 0.8
QUANTILE = 0.99  # with MARGIN: the largest difference of labelled good and bad documents kept, see the README
MARGIN = 1.0
SHARD_ROWS = 1 << 19  # n-grams of the model in a shard, on average
START = 0xFF  # the symbol before a text; no UTF-8 has it
UNIFORM = -np.log(SYMBOLS)
FEATURES = 6


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the texts, one after the other, and the texts' lengths in bytes."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    a = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum(lengths) - lengths
    key = a.astype(np.int64)
    for back in range(1, ORDER):
        before = np.full(len(a), START, np.uint8)
        before[back:] = a[: max(0, len(a) - back)]
        for k in range(back):  # the first bytes of each text have the start before them
            before[starts[lengths > k] + k] = START
        wide = before.astype(np.int64)
        wide <<= BITS * back
        key |= wide
    return key, lengths


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    key = np.sort(key)
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[edge], np.diff(np.append(edge, len(key)))


def part(key: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of a lower order at the end of the given ones."""
    return key & ((1 << BITS * order) - 1)


def shard_of(key: np.ndarray, order: int, shards: int) -> np.ndarray:
    h = (key.astype(np.uint64) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Sorted keys as differences, then arrays as long; compressed."""
    first = np.diff(arrays[0], prepend=0)
    planes = [np.frombuffer(a.tobytes(), np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in (first.astype("<i8"), *arrays[1:])]
    return zstandard.compress(np.array([len(first)], "<i8").tobytes() + b"".join(planes), 3)


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    n, at, out = int(np.frombuffer(raw[:8], "<i8")[0]), 8, []
    for kind in ("<i8", *kinds):
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T.tobytes(), kind))
        at += n * size
    return [np.cumsum(out[0]), *out[1:]]


def questions(key: np.ndarray) -> list[np.ndarray]:
    """Distinct n-grams by order, from ORDER down to the empty one, of sorted distinct ones of ORDER; their contexts are among them."""
    out = [key]
    for order in range(ORDER - 1, -1, -1):
        out.append(distinct(np.concatenate([part(key, order), part(key >> BITS, order)]))[0])
    return out


#: Classes of bytes whose shares are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"*#$%&!|<>{}=_~^\\", b"0123456789")


def features(text: str) -> list[float]:
    """Bounded surface features of a text: a constant, capitals, signs, digits, repetition and length."""
    raw, words = text.encode("utf-8", "replace"), text.split()
    upper, lower, signs, figures = (len(raw) - len(raw.translate(None, c)) for c in CLASSES)
    n = max(1, len(raw))
    repeat = 1 - len(set(words)) / len(words) ** 0.85 if words else 1.0
    return [1.0, upper / max(1, upper + lower), min(1.0, 10 * signs / n), min(1.0, 10 * figures / n), max(-1.0, repeat), min(1.0, len(words) / 50)]


def fit_trust(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - 0.01 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(x.shape[1])
        w = w + np.linalg.solve(bend, slope)
    return w


def trust(docs: DataFrame, labels: DataFrame | None) -> np.ndarray | None:
    """Weights of the trust classifier, or None if nothing tells trusted text from other."""
    if labels is None:
        return None
    some = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)  # the stated bound
    chosen = only(docs, "doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("text", "quality")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "x": [features(t) for t in b["text"]], "y": b["quality"].astype(float)})

    # repeated doc_ids may make more rows of the sample's; again the first by hash, so that reruns agree
    rows = chosen.withColumn("k", F.xxhash64("text")).mapInPandas(run, "k long, x array<double>, y double").orderBy("k", "y", "x").limit(SAMPLE).toPandas()
    if rows["y"].nunique() < 2:
        return None
    return fit_trust(np.array(rows["x"].tolist()), (rows["y"] > 0).to_numpy(float))


def blocks(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[tuple[int, pd.DataFrame]]:
    """Rows with text, by about BLOCK bytes, numbered by partition and turn."""
    held, size, number = [], 0, None
    for batch in batches:
        if number is None and len(batch):
            number = int(batch["place"].iloc[0]) << 24
        batch = batch[[isinstance(t, str) and len(t) > 0 for t in batch["text"]]]
        upto = np.cumsum(batch["size"].to_numpy(np.int64)) if len(batch) else np.empty(0, np.int64)
        at = 0
        while at < len(batch):
            done = int(upto[at - 1]) if at else 0
            stop = min(len(batch), int(np.searchsorted(upto, done + BLOCK - size)) + 1)
            held.append(batch.iloc[at:stop])
            size += int(upto[stop - 1]) - done
            at = stop
            if size >= BLOCK:
                yield number, pd.concat(held)[cols]
                held, size, number = [], 0, number + 1
                trim()
    if held:
        yield number, pd.concat(held)[cols]
    held = []
    trim()


def cut(docs: DataFrame) -> DataFrame:
    """What both scans that cut blocks read: the same plan, so the same rows in each partition; place is that partition's number,
    whatever the plan joins it to."""
    return spread(only(docs, "doc_id", "lang", "text")).withColumns({"h": F.xxhash64("text"), "size": F.octet_length("text"), "place": F.spark_partition_id()})


def is_trusted(texts: list[str], weights: np.ndarray | None) -> np.ndarray:
    if weights is None:
        return np.ones(len(texts), bool)
    x = np.array([features(t) for t in texts]).reshape(-1, FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) >= TRUST


def counted(docs: DataFrame, weights: np.ndarray | None, shards: int) -> DataFrame:
    """(key, c): every n-gram of trusted text with its count."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in blocks(batches, ["text"]):
            texts = rows["text"].tolist()
            ok = is_trusted(texts, weights)
            key, n = distinct(grams([t for t, k in zip(texts, ok, strict=True) if k])[0])
            home = shard_of(key, ORDER, shards)
            yield pd.DataFrame([{"shard": s, "data": pack(key[home == s], n[home == s].astype("<i4"))} for s in range(shards) if (home == s).any()], columns=["shard", "data"])

    def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        return (key[edge], np.add.reduceat(n, edge)) if len(edge) else (key, n)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, pile = None, []

        def close() -> pd.DataFrame:
            while len(pile) > 1:
                pile.append(both(pile.pop(), pile.pop()))
            key, n = pile.pop()
            return pd.DataFrame({"key": key, "c": n})

        for batch in batches:
            for shard, data in zip(batch["shard"].tolist(), batch["data"], strict=True):
                if shard != at and pile:
                    yield close()
                at = shard
                k, m = unpack(data, "<i4")
                pile.append((k, m.astype(np.int64)))
                while len(pile) > 1 and len(pile[-2][0]) < 2 * len(pile[-1][0]):  # each key is merged a logarithm of times
                    pile.append(both(pile.pop(), pile.pop()))
        if pile:
            yield close()

    sent = spread(only(docs, "text")).withColumns({"size": F.octet_length("text"), "place": F.spark_partition_id()}).mapInPandas(send, "shard int, data binary")
    return sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInPandas(merge, "key long, c long")


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from the numbers of n-grams with counts 1 to 4; 0.5, 1 and 1.5 where those say nothing."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.1), k + 0.95) for k, x in enumerate(d))


def model(top: DataFrame) -> DataFrame:
    """(order, key, p, g): log probability of each n-gram and log back-off weight of it as a context, in thousandths."""
    levels = [checkpointed(top.select("key", F.col("c").alias("a")))]
    for order in range(ORDER - 1, 0, -1):
        levels.append(checkpointed(levels[-1].groupBy(F.col("key").bitwiseAND(F.lit((1 << BITS * order) - 1)).alias("key")).agg(F.count("*").alias("a"))))
    prob, out = None, []
    for order in range(1, ORDER + 1):
        rows = levels[ORDER - order]
        n = rows.agg(*[F.coalesce(F.count_if(F.col("a") == k), F.lit(0)) for k in (1, 2, 3, 4)]).first()
        d = discounts(list(n))
        cut = F.when(F.col("a") == 1, d[0]).when(F.col("a") == 2, d[1]).otherwise(d[2])
        context = F.shiftright("key", BITS)
        stats = rows.groupBy(context.alias("context")).agg(F.sum("a").alias("total"), F.sum(cut).alias("mass")).select("context", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        seen = rows.withColumn("context", context).join(stats, "context").withColumn("own", F.greatest(F.col("a") - cut, F.lit(0.0)) / F.col("total"))
        if prob is None:
            now = seen.withColumn("prob", F.col("own") + F.col("gamma") / SYMBOLS)
        else:
            below = prob.select(F.col("key").alias("suffix"), F.col("prob").alias("lower"))
            now = seen.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))).join(below, "suffix").withColumn("prob", F.col("own") + F.col("gamma") * F.col("lower"))
        prob = checkpointed(now.select("key", "prob"))
        out.append(prob.select(F.lit(order).alias("order"), "key", F.round(1000 * F.log("prob")).cast("int").alias("p"), F.lit(None).cast("int").alias("g")))
        out.append(stats.select(F.lit(order - 1).alias("order"), F.col("context").alias("key"), F.lit(None).cast("int").alias("p"), F.round(1000 * F.log("gamma")).cast("int").alias("g")))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every.groupBy("order", "key").agg(F.max("p").alias("p"), F.max("g").alias("g"))


ABSENT = -32768


def packed_model(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, kind 0, block = order, data): a row for each shard and order."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(shard=shards_of(b["key"].to_numpy(), b["order"].to_numpy(), shards))[["shard", "order", "key", "p", "g"]]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def close() -> pd.DataFrame:
            rows = pd.concat(held)
            return pd.DataFrame([{"shard": at[0], "kind": 0, "block": int(at[1]), "data": pack(rows["key"].to_numpy(), short(rows["p"]), short(rows["g"]))}])

        for b in batches:
            for (s, o), rows in b.groupby(["shard", "order"], sort=False):
                if (s, o) != at:
                    if held:
                        yield close()
                    at, held = (s, o), []
                held.append(rows)
        if held:
            yield close()

    dealt = rows.mapInPandas(deal, "shard int, order int, key long, p int, g int")
    return dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order", "key").mapInPandas(gather, "shard int, kind int, block long, data binary")


def shards_of(key: np.ndarray, order: np.ndarray, shards: int) -> np.ndarray:
    out = np.zeros(len(key), np.int64)
    for o in range(ORDER + 1):
        out[order == o] = shard_of(key[order == o], o, shards)
    return out


def short(x: pd.Series) -> np.ndarray:
    return x.clip(ABSENT + 1, 0).fillna(ABSENT).to_numpy().astype("<i2")


def answers(docs: DataFrame, packed: DataFrame, shards: int, salts: int) -> DataFrame:
    """(block, kind 0, shard, data): for each question its n-grams' logarithms, in the question's order."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in blocks(batches, ["text"]):
            asked = questions(distinct(grams(rows["text"].tolist())[0])[0])
            homes = [shard_of(key, ORDER - k, shards) for k, key in enumerate(asked)]
            proof = checksum(asked[0])
            for s in range(shards):
                # one array: orders one after the other, told apart by their counts
                parts = [key[h == s] for key, h in zip(asked, homes, strict=True)]
                yield pd.DataFrame([{"shard": s, "kind": 1, "block": number, "data": proof + b"".join(len(d := pack(p)).to_bytes(4, "little") + d for p in parts)}])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known = None, {}
        for batch in batches:
            for shard, salt, kind, block, data in zip(batch["shard"].tolist(), batch["salt"].tolist(), batch["kind"].tolist(), batch["block"].tolist(), batch["data"], strict=True):
                if (shard, salt) != at:
                    at, known = (shard, salt), {}
                if kind == 0:
                    known[block] = unpack(data, "<i2", "<i2")
                    continue
                out, place = [], 4
                for order in range(ORDER, -1, -1):
                    size = int.from_bytes(data[place : place + 4], "little")
                    (key,) = unpack(data[place + 4 : place + 4 + size])
                    place += 4 + size
                    p, g = np.full(len(key), ABSENT, np.int16), np.full(len(key), ABSENT, np.int16)
                    if order in known and len(key):
                        have, hp, hg = known[order]
                        i = np.minimum(np.searchsorted(have, key), len(have) - 1)
                        hit = have[i] == key
                        p[hit], g[hit] = hp[i[hit]], hg[i[hit]]
                    out += [p.tobytes(), g.tobytes()]
                yield pd.DataFrame([{"block": block, "kind": 0, "shard": shard, "data": data[:4] + zstandard.compress(b"".join(out), 3)}])

    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    asked = cut(docs).mapInPandas(ask, "shard int, kind int, block long, data binary").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    both = packed.withColumn("salt", every).unionByName(asked).repartitionById(shards * salts, F.col("shard") * salts + F.col("salt"))
    return both.sortWithinPartitions("shard", "salt", "kind", "block").mapInPandas(look, "block long, kind int, shard int, data binary")


def checksum(key: np.ndarray) -> bytes:
    return zlib.crc32(key.astype("<i8").tobytes()).to_bytes(4, "little")


def logarithms(asked: list[np.ndarray], p: list[np.ndarray], g: list[np.ndarray]) -> np.ndarray:
    """Log probability of each distinct n-gram: the longest known n-gram's, plus the weights of the contexts backed off from."""
    whole = asked[0]
    total = np.zeros(len(whole))
    left = np.ones(len(whole), bool)
    for order in range(ORDER, 0, -1):
        k = ORDER - order
        i = np.searchsorted(asked[k], part(whole, order))
        own = p[k][i]
        hit = left & (own != ABSENT)
        total[hit] += own[hit] / 1000
        left &= ~hit
        weight = g[k + 1][np.searchsorted(asked[k + 1], part(whole >> BITS, order - 1))]
        total += np.where(left & (weight != ABSENT), weight / 1000, 0)
    total[left] += UNIFORM
    return total


def scored(docs: DataFrame, found: DataFrame, weights: np.ndarray | None, shards: int, partitions: int) -> DataFrame:
    """doc_id, lang, h (hash of the text), n (bytes), trusted, logp."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in blocks(batches, ["doc_id", "lang", "h", "text"]):
            sink = pa.BufferOutputStream()
            t = pa.table({"doc_id": pa.array([None if pd.isna(d) else int(d) for d in rows["doc_id"]], pa.int64()), "lang": pa.array(rows["lang"].tolist(), pa.string()), "h": pa.array(rows["h"].tolist(), pa.int64()), "text": pa.array(rows["text"].tolist(), pa.large_string())})
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            yield pd.DataFrame([{"block": number, "kind": 1, "shard": 0, "data": sink.getvalue().to_pybytes()}])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        replies: dict[int, bytes] = {}
        for batch in batches:
            for kind, shard, data in zip(batch["kind"].tolist(), batch["shard"].tolist(), batch["data"], strict=True):
                if kind == 0:
                    replies[shard] = data
                    continue
                t = pa.ipc.open_stream(data).read_all().to_pandas()
                texts = t["text"].tolist()
                key, lengths = grams(texts)
                order = np.argsort(key)
                ordered = key[order]
                edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(key)])
                asked = questions(ordered[edge])
                p, g = [np.full(len(a), ABSENT, np.int16) for a in asked], [np.full(len(a), ABSENT, np.int16) for a in asked]
                homes, proof = [shard_of(a, ORDER - k, shards) for k, a in enumerate(asked)], checksum(asked[0])
                for s in range(shards):
                    reply = replies.pop(s)
                    if reply[:4] != proof:
                        raise ValueError("a block was cut otherwise when it was asked about; make the input's order fixed (a written table) and run again")
                    raw, at = zstandard.decompress(reply[4:]), 0
                    for k, h in enumerate(homes):
                        own = h == s
                        n = int(own.sum())
                        p[k][own] = np.frombuffer(raw, np.int16, n, at)
                        g[k][own] = np.frombuffer(raw, np.int16, n, at + 2 * n)
                        at += 4 * n
                value = np.empty(len(key))
                value[order] = np.repeat(logarithms(asked, p, g), np.diff(np.append(edge, len(key))))
                sums = np.add.reduceat(value, np.cumsum(lengths) - lengths)
                yield pd.DataFrame({"doc_id": t["doc_id"].astype("Int64"), "lang": t["lang"], "h": t["h"], "n": lengths, "trusted": is_trusted(texts, weights), "logp": sums})
                del t, texts, key, order, ordered, value, asked, p, g
                trim()

    texts = cut(docs).mapInPandas(send, "block long, kind int, shard int, data binary")
    both = found.unionByName(texts).repartition(partitions, "block").sortWithinPartitions("block", "kind", "shard")
    return both.mapInPandas(score, "doc_id long, lang string, h long, n long, trusted boolean, logp double")


def perplexities(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """scored() of all documents with text, in the shared folder."""
    spark = docs.sparkSession
    size = only(docs, "text").agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-size // SALT_BYTES))
    weights = trust(docs, labels)
    rows = checkpointed(model(counted(docs, weights, partitions)))
    shards, salts = max(4, -(-rows.count() // SHARD_ROWS)), max(1, -(-size // SALT_BYTES))
    return checkpointed(scored(docs, answers(docs, packed_model(rows, shards), shards, salts), weights, shards, partitions))


def judged(scores: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """scores with ppl, threshold and keep."""
    ppl = scores.withColumn("ppl", F.exp(-F.col("logp") / F.col("n")))
    good = ppl.where("trusted")
    own = good.groupBy(F.col("lang").alias("of")).agg(F.percentile_approx("ppl", quantile, 10000).alias("own"))
    whole = good.agg(F.percentile_approx("ppl", quantile, 10000).alias("whole"))
    bound = F.coalesce("own", "whole") * margin
    return ppl.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").join(F.broadcast(whole)).withColumn("threshold", bound).withColumn("keep", F.coalesce(F.col("ppl") <= bound, F.lit(True))).drop("of", "own", "whole")


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = judged(perplexities(docs, table(spark, sf_dir, "labels"))).select("doc_id", "lang", "n", "trusted", "ppl", "threshold", "keep")
    none = only(docs, "doc_id", "lang", "text").where("text is null or text = ''").select("doc_id", "lang", F.lit(0).cast("long").alias("n"), F.lit(False).alias("trusted"), F.lit(None).cast("double").alias("ppl"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("keep"))
    return found.unionByName(none)
