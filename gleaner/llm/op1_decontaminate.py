"""Benchmark decontamination with an FM-index per training shard.

Each partition deals its documents into shards of about SHARD_WORDS words. A shard's words become symbols, their
suffixes are sorted, and the Burrows-Wheeler transform is kept as a wavelet matrix. Every test window is searched
backwards through the ranks; rows in the final intervals are walked to a sampled suffix position; and the windows found
are merged to removal spans. No row is shuffled. Test items go as word numbers and a list of words, in blocks of
BLOCK_BYTES of text: one block is one pass over the documents and the only broadcast alive. Where there are more blocks,
a pass's rows are written in the shared folder, with what was found so far, and read by the next.

Defined results: a null or wordless text has no words and no hits; a test item with no words is never found; one with
fewer than `width` words is one window; a test item with a null id marks words as others do, and has no id to be listed
or counted by; repeated documents each get a row; columns beyond those named are ignored. Empty tables give no rows, or
rows without hits.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, spread, table, trim, words, written

WIDTH = 10
SHARD_WORDS = 1 << 19
SAMPLE = 8
BLOCK_BYTES = 16 << 20

SCHEMA = "doc_id long, h long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; the last symbol must be unique and every tie end at a unique symbol."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(2, np.int64)])
    bits = max(1, int(symbols.max()).bit_length())
    if 3 * bits <= 63:
        key, depth = (padded[:n] << 2 * bits) | (padded[1 : n + 1] << bits) | padded[2 : n + 2], 3
    else:
        key, depth = padded[:n], 1
    order = np.argsort(key)
    open_ = np.arange(n)
    rank = np.empty(n, np.int64)
    members, sorted_key = order, key[order]
    while True:
        first = np.empty(len(members), bool)
        first[:1] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=first[1:])
        rank[members] = np.maximum.accumulate(np.where(first, open_, 0))
        single = first & np.append(first[1:], True)
        open_ = open_[~single]
        if not len(open_):
            return order
        members = order[open_]
        key = (rank[members] << 32) | rank[np.minimum(members + depth, n - 1)]
        by = np.argsort(key)
        members, sorted_key = members[by], key[by]
        order[open_] = members
        depth *= 2


class Shard:
    """FM-index over the words of some documents; symbol 0 ends each document."""

    def __init__(self, docs: list[list[bytes]]):
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.n = n = int(self.starts[-1])
        flat = [w for d in docs for w in d]
        self.symbol = {w: i for i, w in enumerate(dict.fromkeys(flat), 1)}
        text = np.zeros(n, np.int32)
        inside = np.ones(n, bool)
        inside[self.starts[1:] - 1] = False
        text[inside] = np.fromiter(map(self.symbol.__getitem__, flat), np.int32, len(flat))
        ordered = text.astype(np.int64) + len(docs)
        ordered[~inside] = np.arange(len(docs))
        order = suffix_order(ordered)
        last = text[order - 1]  # row 0 or any first suffix is preceded by a document's end
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.symbol) + 1))])
        self.levels = max(1, len(self.symbol).bit_length())
        self.ranks, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ranks.append(ones)
            self.zeros.append(n - int(ones[-1]))
            at = bit.astype(bool)
            last = np.concatenate([last[~at], last[at]])
        offset = order - np.repeat(self.starts[:-1], lengths + 1)[order]
        self.sampled = offset % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each row of the transform."""
        at, start = row.copy(), np.zeros_like(row)
        for k, (ones, zeros) in enumerate(zip(self.ranks, self.zeros, strict=True)):
            up = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, s = ones[at], ones[start]
            at = np.where(up, zeros + a, at - a)
            start = np.where(up, zeros + s, start - s)
        return at - start

    def step_back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix one word longer."""
        at, start, symbol = row.copy(), np.zeros_like(row), np.zeros_like(row)
        for ones, zeros in zip(self.ranks, self.zeros, strict=True):
            a, s = ones[at], ones[start]
            up = ones[at + 1] > a
            symbol = symbol * 2 + up
            at = np.where(up, zeros + a, at - a)
            start = np.where(up, zeros + s, start - s)
        return self.below[symbol] + at - start

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows (a row of symbols each, at its end; all of them in the shard): for each occurrence its window's number
        and the position of its first word."""
        most = symbols.shape[1]
        lo, hi = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        for back in range(most):
            live = np.flatnonzero((hi > lo) & (length > back))
            if not len(live):
                break
            c = symbols[live, most - 1 - back]
            lo[live] = self.below[c] + self.rank(c, lo[live])
            hi[live] = self.below[c] + self.rank(c, hi[live])
        count = np.maximum(hi - lo, 0)
        total = int(count.sum())
        row = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        walked = np.zeros(total, np.int64)
        while len(far := np.flatnonzero(~self.sampled[row])):
            row[far] = self.step_back(row[far])
            walked[far] += 1
        return np.repeat(np.arange(len(symbols)), count), self.samples[self.sample_rank[row]] + walked


@dataclass
class Items:
    """Test items: their ids, and their words as numbers of `words`, one item after the other."""

    ids: list[str | None]
    words: list[bytes]
    flat: np.ndarray
    lengths: np.ndarray

    def windows(self, known: dict[bytes, int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows all of whose words are known: symbols (at the row's end), lengths and item numbers."""
        symbol = np.fromiter((known.get(w, 0) for w in self.words), np.int64, len(self.words))[self.flat]
        starts = np.cumsum(self.lengths) - self.lengths
        many = np.where(self.lengths > 0, np.maximum(self.lengths - width + 1, 1), 0)
        item = np.repeat(np.arange(len(many)), many)
        first = np.repeat(starts - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        length = np.minimum(self.lengths[item], width)
        unknown = np.concatenate([[0], np.cumsum(symbol == 0)])
        whole = np.flatnonzero(unknown[first + length] == unknown[first])
        item, first, length = item[whole], first[whole], length[whole]
        place = np.arange(width) - width + length[:, None]
        return np.where(place >= 0, symbol[first[:, None] + np.maximum(place, 0)], 0), length, item


def searched(texts: list[str | None], block: Items, width: int, before: list[tuple[list, list]] | None = None) -> Iterator[tuple[int, int, list[str], list[tuple[int, int]]]]:
    """For each text of a shard: words, words hit, items found and removal spans in words; with those found before."""
    docs = [words(t) for t in texts]
    items: list[set[str]] = [set() for _ in docs]
    if not any(docs):
        yield from ((0, 0, [], []) for _ in docs)
        return
    shard = Shard(docs)
    edge = np.zeros(shard.n + 1, np.int32)
    for d, (found, spans) in enumerate(before or ()):
        items[d].update(found)
        for a, b in spans:
            edge[shard.starts[d] + a] += 1
            edge[shard.starts[d] + b] -= 1
    symbols, length, owner = block.windows(shard.symbol, width)
    if len(symbols):
        number, position = shard.search(symbols, length)
        np.add.at(edge, position, 1)
        np.add.at(edge, position + length[number], -1)
        doc = np.searchsorted(shard.starts, position, "right") - 1
        pairs = np.sort(doc * len(block.ids) + owner[number])
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)]]
        for d, k in zip((pairs // len(block.ids)).tolist(), (pairs % len(block.ids)).tolist(), strict=True):
            if block.ids[k] is not None:
                items[d].add(block.ids[k])
    hit = np.cumsum(edge)[:-1] > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    for d, b, e in zip((np.searchsorted(shard.starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[d].append((b - int(shard.starts[d]), e - int(shard.starts[d])))
    for d, s, i in zip(docs, spans, items, strict=True):
        yield len(d), sum(e - b for b, e in s), sorted(i), s


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """All items in blocks of bounded size, one without items if there are none; the driver holds one at a time."""
    ids, flat, lengths, known, size, made = [], array("i"), [], {}, 0, 0
    for item, text in only(benchmark, "item_id", "text").where("text is not null").toLocalIterator():
        found = words(text)
        ids.append(None if item is None else str(item))
        lengths.append(len(found))
        flat.extend([known.setdefault(w, len(known)) for w in found])
        size += len(text)
        if size >= block_bytes:
            yield Items(ids, list(known), np.array(flat, np.int32), np.array(lengths, np.int64))
            ids, flat, lengths, known, size, made = [], array("i"), [], {}, 0, made + 1
    if ids or not made:
        yield Items(ids, list(known), np.array(flat, np.int32), np.array(lengths, np.int64))


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, h (hash of the text), n_words, n_hit, items found (sorted) and the merged removal spans in words."""
    context = docs.sparkSession.sparkContext
    rows, blocks = spread(only(docs, "doc_id", "text")).withColumn("h", F.xxhash64("text")), item_blocks(benchmark, block_bytes)
    block, first = next(blocks), True
    while True:
        after = next(blocks, None)
        sent = context.broadcast(block)
        rows = rows.mapInPandas(one_pass(sent, width, shard_words, first, after is None), SCHEMA if after is None else f"text string, {SCHEMA}")
        if after is None:
            return rows
        rows = written(rows, "scanned").select("doc_id", "h", "text", "items", "spans")
        sent.destroy()
        block, first = after, False


def one_pass(sent: Broadcast, width: int, shard_words: int, first: bool, last: bool):
    """A pass over the documents with one block of items; the last drops the texts."""

    def flush(ids: list, hashes: list, texts: list, before: list) -> pd.DataFrame:
        found = list(searched(texts, sent.value, width, before))
        out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "h": hashes, "n_words": [f[0] for f in found], "n_hit": [f[1] for f in found], "items": [f[2] for f in found], "spans": [[{"start": a, "end": b} for a, b in f[3]] for f in found]})
        if not last:
            out.insert(0, "text", texts)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, hashes, texts, before, size = [], [], [], [], 0
        for batch in batches:
            found = [] if first else [(list(i), [(s["start"], s["end"]) for s in x]) for i, x in zip(batch["items"], batch["spans"], strict=True)]
            for k, (doc, h, text) in enumerate(zip(batch["doc_id"].tolist(), batch["h"].tolist(), batch["text"].tolist(), strict=True)):
                ids.append(None if pd.isna(doc) else int(doc))
                hashes.append(h)
                texts.append(text if isinstance(text, str) else None)
                if not first:
                    before.append(found[k])
                size += len(text) // 6 + 1 if isinstance(text, str) else 1
                if size >= shard_words:
                    yield flush(ids, hashes, texts, before)
                    ids, hashes, texts, before, size = [], [], [], [], 0
                    trim()
        if ids:
            yield flush(ids, hashes, texts, before)
        trim()

    return run


def items_digest(items: list[str] | None) -> str:
    return hashlib.sha256(",".join(items or []).encode()).hexdigest()


def clean_text(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the given spans (word numbers, end exclusive); what stands between other words stays."""
    import re

    from .common import WORD

    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    at = [m.span() for m in re.finditer(WORD, folded)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
