"""Language identification, words first, with back-off to ever shorter character n-grams.

A known word adds its log frequency per language. An unseen word adds the mean log frequency of its longest n-grams
that training has seen (GRAMS characters at most, with marks at both ends; then one less, down to single characters).

1. Words: tasks count words by language and send them as they are; sums by word make a table of all distinct words, those
   of texts that teach nothing among them. N-grams of known words are counted by a 64-bit hash of their length and characters.
2. Unseen words of that table meet the n-grams in a join. Each word so gets its values once, whatever its occurrences: what
   a language has over its floor, in whole parts of 1/SCALE, so that sums don't depend on their order.
3. The most frequent words (HEAD values at most) go to the tasks as one broadcast. A document's other words, a small
   part of the text and none of them frequent, are sent and meet the table in a join by word.

So words are told apart exactly at every size, and the broadcast has a fixed bound.

Defined results: a text null or without letters is `und` with score 0, and so is every text if nothing was learned. Equal
totals go to the language first by code point. Documents with null lang or null text teach nothing. A null doc_id counts as an empty
id. Repeated rows count each time; other columns are ignored. score is the normalised likelihood of the choice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, spread, table, written

GRAMS = 5
HEAD = 1 << 20  # values (words times languages) of the broadcast
LANGUAGES = 4096
CHUNK = 4 << 20  # characters counted or scored at once
DISTINCT = 1 << 18  # words counted before they are sent
ALPHA = 0.5
SCALE = 1 << 20
NONE, WORD, GRAM = 0, 1, 2  # what a word's values come from
LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of all n-grams of the words with a mark at both ends, and the number of the word each is from."""
    text = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.cumsum(text == 2) - 1
    if len(text) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.full(len(text) - n + 1, n * int(_MIX) % 2**64, np.uint64)
    for k in range(n):
        h = (h ^ text[k : len(text) - n + 1 + k]) * _MIX
        h ^= h >> np.uint64(29)
    inside = word[: len(h)] == word[n - 1 :]
    if n == 1:
        inside = text > 3
    return h[inside].view(np.int64), word[: len(h)][inside]


def stored(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder; checkpoints aren't compressed."""
    return written(df, "langid")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def counted(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """(word, lang, n): every word with its count by number of language, or under -1 where the text teaches nothing."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {}
        waiting: dict[int, list[str]] = {}
        size: Counter = Counter()

        def add(k: int) -> None:
            held.setdefault(k, Counter()).update(LETTERS.findall("\n".join(waiting.pop(k)).lower()))
            size[k] = 0

        def sent() -> Iterator[pd.DataFrame]:
            for k, seen in held.items():
                yield pd.DataFrame({"word": list(seen), "lang": k, "n": list(seen.values())})
            held.clear()

        for batch in batches:
            for text, lang, teaches in zip(batch["text"].tolist(), batch["lang"].tolist(), batch["teaches"].tolist(), strict=True):
                k = number[lang] if teaches else -1
                waiting.setdefault(k, []).append(text)
                size[k] += len(text)
                if size[k] >= CHUNK:
                    add(k)
                    if sum(map(len, held.values())) >= DISTINCT:
                        yield from sent()
        for k in list(waiting):
            add(k)
        yield from sent()

    sent = spread(docs.where("text is not null").select("text", "lang", "teaches")).mapInPandas(count, "word string, lang int, n long")
    return sent.groupBy("word", "lang").agg(F.sum("n").alias("n"))


def grams_of(words: DataFrame) -> DataFrame:
    """(gram, lang, n) of rows (word, lang, n)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, rows in b.groupby("lang"):
                names, times = rows["word"].tolist(), rows["n"].to_numpy(np.int64)
                for n in range(1, GRAMS + 1):
                    key, word = gram_keys(names, n)
                    key, at = np.unique(key, return_inverse=True)
                    total = np.zeros(len(key), np.int64)
                    np.add.at(total, at, times[word])
                    yield pd.DataFrame({"gram": key, "lang": int(k), "n": total})

    return words.mapInPandas(run, "gram long, lang int, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def asked(words: DataFrame, n: int) -> DataFrame:
    """(word, gram) of each word's n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            key, word = gram_keys(b["word"].tolist(), n)
            yield pd.DataFrame({"word": b["word"].to_numpy(object)[word], "gram": key})

    return words.select("word").mapInPandas(run, "word string, gram long")


@dataclass
class Model:
    """languages; floors by kind and language; words: (word, total, kind, langs, lifts)."""

    languages: list[str]
    floors: np.ndarray
    words: DataFrame


def floors_and_lifts(counts: DataFrame, key: str, languages: int) -> tuple[np.ndarray, DataFrame]:
    """Log frequency per language of what it never has, and rows with `lift`, what log frequency a count adds to that."""
    totals = np.zeros(languages)
    for k, n in counts.groupBy("lang").agg(F.sum("n")).collect():  # a row for each language
        totals[k] = n
    size = counts.select(key).distinct().count()
    floor = np.log(ALPHA / (totals + ALPHA * max(1, size)))
    return np.round(floor * SCALE), counts.select(key, "lang", F.round(SCALE * F.log((F.col("n") + ALPHA) / ALPHA)).cast("long").alias("lift"))


def train(docs: DataFrame) -> Model:
    """Model of all words of rows (text, lang, teaches), learned from those that teach."""
    names = [r[0] for r in docs.where("teaches").select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    languages = sorted(names)
    counts = stored(counted(docs, {name: k for k, name in enumerate(languages)}))
    known = counts.where("lang >= 0")
    word_floor, word_lift = floors_and_lifts(known, "word", len(languages))
    grams = stored(grams_of(known))
    gram_floor, gram_lift = floors_and_lifts(grams, "gram", len(languages))
    own = word_lift.groupBy("word").agg(F.collect_list(F.struct("lang", "lift")).alias("values")).select("word", F.lit(WORD).alias("kind"), "values")
    # an unseen word's n-grams; language -1 has the number of those seen
    unseen = counts.where("lang < 0").join(known.select("word").distinct(), "word", "left_anti")
    per_gram = stored(gram_lift.groupBy("gram").agg(F.collect_list(F.struct("lang", "lift")).alias("lifts")))
    one = F.array(F.struct(F.lit(-1).alias("lang"), F.lit(1).cast("long").alias("lift")))
    seen = F.filter("all", lambda v: v["lang"] < 0)[0]["lift"]
    mean = F.transform(F.filter("all", lambda v: v["lang"] >= 0), lambda v: F.struct(v["lang"].alias("lang"), F.round(v["lift"] / seen).cast("long").alias("lift")))
    left, backed = stored(unseen.select("word")), []
    for n in range(GRAMS, 0, -1):  # only words without known n-grams ask for shorter ones
        met = asked(left, n).join(per_gram, "gram").select("word", F.explode(F.concat("lifts", one)).alias("v"))
        sums = met.groupBy("word", "v.lang").agg(F.sum("v.lift").alias("lift"))
        got = stored(sums.groupBy("word").agg(F.collect_list(F.struct("lang", "lift")).alias("all")).select("word", F.lit(GRAM).alias("kind"), mean.alias("values")))
        backed.append(got)
        left = stored(left.join(got.select("word"), "word", "left_anti"))
        if left.isEmpty():
            break
    for got in backed:
        own = own.unionByName(got)
    total = counts.groupBy("word").agg(F.sum("n").alias("total"))
    every = total.join(own, "word", "left")
    words = stored(every.select("word", "total", F.coalesce("kind", F.lit(NONE)).alias("kind"), F.col("values.lang").alias("langs"), F.col("values.lift").alias("lifts")))
    return Model(languages, np.stack([np.zeros(len(languages)), word_floor, gram_floor]), words)


def head_of(model: Model, values: int) -> tuple[dict[str, int], np.ndarray]:
    """The most frequent words, as many as the bound on values allows, and their values per language."""
    most, n, least = max(1, values // max(4, len(model.languages))), 0, None
    for total, words in model.words.groupBy("total").count().orderBy(F.desc("total")).toLocalIterator():
        n += words
        if n > most:
            break
        least = total
    if least is None:
        return {}, np.zeros((0, len(model.languages)))
    rows = model.words.where(F.col("total") >= least).select("word", "kind", "langs", "lifts").toArrow()
    out = model.floors[rows["kind"].to_numpy()]
    sizes = np.array([len(x) if x is not None else 0 for x in rows["langs"].to_pylist()], np.int64)
    if sizes.sum():
        at = np.repeat(np.arange(len(sizes)), sizes)
        out[at, rows["langs"].combine_chunks().flatten().to_numpy()] += rows["lifts"].combine_chunks().flatten().to_numpy()
    return {w: i for i, w in enumerate(rows["word"].to_pylist())}, out


def predict(docs: DataFrame, model: Model, *keep: str, values: int = HEAD) -> DataFrame:
    """The kept columns with lang_pred and score, of documents whose words are all in the model's table."""
    spread_docs = spread(docs.select(*keep, "text"))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    kept = ", ".join(f"`{k}` {fields[k]}" for k in keep)
    languages, floors = model.languages, model.floors
    sent = docs.sparkSession.sparkContext.broadcast(head_of(model, values))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        index, value = sent.value
        for batch in batches:
            texts, at = [t if isinstance(t, str) else "" for t in batch["text"].tolist()], 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHUNK):
                    size += len(texts[end])
                    end += 1
                found = [LETTERS.findall(t.lower()) for t in texts[at:end]]
                flat = np.fromiter((index.get(w, -1) for f in found for w in f), np.int64)
                doc = np.repeat(np.arange(len(found)), [len(f) for f in found])
                here = flat >= 0
                sums = np.stack([np.bincount(doc[here], value[flat[here], k], len(found)) for k in range(len(languages))], 1) if languages else np.zeros((len(found), 0))
                ends = np.cumsum([len(f) for f in found]).tolist()
                away = np.flatnonzero(~here)
                cuts = np.searchsorted(away, [0, *ends])
                begin = [0, *ends]
                tails = [[found[i][p - begin[i]] for p in away[cuts[i] : cuts[i + 1]].tolist()] for i in range(len(found))]
                lettered = [any(c.isalpha() for w in f for c in w) for f in found]
                yield batch[list(keep)].iloc[at:end].assign(row=np.arange(row, row + len(found)), lettered=lettered, sums=list(sums), tail=tails)
                row, at = row + len(found), end

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = np.array(b["sums"].tolist(), np.float64).reshape(len(b), len(languages))
            for i, rest in enumerate(b["rest"]):
                for r in rest if rest is not None else ():
                    if r["lang"] >= 0:
                        total[i, r["lang"]] += r["n"]
                    else:
                        total[i] += floors[-1 - r["lang"]] * r["n"]
            named = b["lettered"].to_numpy(bool) & bool(languages)
            names, sure = ["und"] * len(b), np.zeros(len(b))
            if languages:
                best, total = total.argmax(1), total / SCALE
                sure = np.where(named, 1 / np.exp(total - total.max(1, keepdims=True)).sum(1), 0.0)
                names = [languages[k] if ok else "und" for k, ok in zip(best.tolist(), named.tolist(), strict=True)]
            yield b[list(keep)].assign(lang_pred=names, score=sure)

    first = stored(spread_docs.mapInPandas(start, f"{kept}, row long, lettered boolean, sums array<double>, tail array<string>"))
    # a word's values under its languages, and its kind as a language below 0
    named = F.transform(F.coalesce(F.arrays_zip("langs", "lifts"), F.array()), lambda v: F.struct(v["langs"].alias("lang"), v["lifts"].alias("n")))
    values_of = model.words.select("word", F.concat(named, F.array(F.struct((-1 - F.col("kind")).alias("lang"), F.lit(1).cast("long").alias("n")))).alias("v"))
    tail = first.select("row", F.explode("tail").alias("word")).join(values_of, "word").select("row", F.explode("v").alias("v"))
    rest = tail.groupBy("row", "v.lang").agg(F.sum("v.n").alias("n")).groupBy("row").agg(F.collect_list(F.struct("lang", "n")).alias("rest"))
    return first.drop("tail").join(rest, "row", "left").drop("row").mapInPandas(finish, f"{kept}, lang_pred string, score double")


def identify(docs: DataFrame, values: int = HEAD) -> DataFrame:
    """Learn from documents not held out, and predict all: doc_id, held_out, lang_pred, score."""
    docs = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out()).withColumn("teaches", ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return predict(docs, train(docs), "doc_id", "held_out", values=values)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
