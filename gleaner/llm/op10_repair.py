"""Token files under Re-Pair grammar compression.

Documents are range-partitioned by doc_id and sorted, so that the files hold them in ascending order. A task gathers
documents and closes a shard at about SHARD_BYTES of text. Within a shard Re-Pair replaces the most frequent pairs by new
symbols until no pair occurs LEAST times; a pair never spans the end of a document. A round takes all pairs with at least
1/SHARE of the greatest count, chosen from one count, so that a shard needs some twenty counts rather than one a rule.
A shard's row holds the rules in the order made, each rule's expansion length, the symbol stream, where each document
starts in it, and the documents' ids and lengths. From these any document, or any range of its ids, is decoded alone.

File format `repair-1`: Parquet written by Spark, thus committed whole or not at all when executors are lost, a row for
each shard with the columns of SCHEMA; integers in the binary columns are little-endian.

Encoding goes by pieces between spaces, each encoded once in TEXT_BYTES of text by the tokenizers library. The tokenizer
drops white space and none of its tokens spans any, so that a text's ids are those of its pieces; a vocabulary for which
that fails is encoded whole (`by_piece=False`). Only ASCII letters are lowered before the library does it, and not where a
special token may stand. Only pieces of nothing but letters to U+00FF and ASCII signs are split further, into the runs that
the tokenizer makes of them; such runs go to the library's model without its expressions, which would leave them as they are.

Defined results: a null text is an empty one (just the end id); a null doc_id comes first and stays null; repeated
documents are all kept, next to each other; further columns are ignored; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import only, table, trim, written

VOCABULARY = "word_bpe_49k.json"
END = 1
SHARD_BYTES = 5 << 20
LEAST = 2  # Re-Pair goes on until no pair occurs this often
SHARE = 4096
TEXT_BYTES = 16 << 20  # text encoded at once
ENTIRE_BYTES = 2 << 20  # where texts go to the library entire
TOGETHER = 256  # texts given to the library at once
RUNS = 64  # in such a text
SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"  # without < | > of special tokens and the apostrophe
SPACE, LETTER, SIGN, OTHER = range(4)
KIND = bytes(SPACE if c == 32 else LETTER if 97 <= c <= 122 or c >= 128 else SIGN if c in SIGNS else OTHER for c in range(256))
LOWER = bytes(32 if c == 10 else c + 32 if 65 <= c <= 90 else c for c in range(256))

SCHEMA = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("part", T.IntegerType()), ("block", T.IntegerType()), ("n_docs", T.LongType()), ("n_ids", T.LongType()), ("n_symbols", T.LongType()), ("inside", T.LongType()),
        ("base", T.LongType()), ("doc_ids", T.BinaryType()), ("doc_nulls", T.BinaryType()), ("doc_lengths", T.BinaryType()),
        ("doc_symbols", T.BinaryType()), ("rounds", T.BinaryType()), ("rules", T.BinaryType()), ("expansions", T.BinaryType()), ("symbols", T.BinaryType()),
    )]
)


def frequent_pairs(seq: np.ndarray, head: np.ndarray, least: int, share: int, since: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The pairs to replace (left * 2**32 + right) of those with a symbol of at least since, every place where one stands
    in ascending order, its number, and the count from which pairs are replaced."""
    inside = ~head[1:]
    if since:
        fresh = seq >= since
        inside &= fresh[:-1] | fresh[1:]
    where = np.flatnonzero(inside)
    half, low = (int(seq.max()).bit_length(), len(seq).bit_length())
    if 2 * half + low <= 64:  # pair and place in one number
        ordered = seq[where].astype(np.uint64)
        for more, bits in ((seq[where + 1], half), (where.view(np.uint64), low)):
            ordered <<= np.uint64(bits)
            ordered |= more
        ordered.sort()
        place = (ordered & np.uint64((1 << low) - 1)).view(np.int64)
        ordered >>= np.uint64(low)
    else:
        ordered = (seq[where].astype(np.uint64) << np.uint64(32)) | seq[where + 1]
        order = np.argsort(ordered)
        ordered, place, half = ordered[order], where[order], 32
    edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    count = np.diff(edge, append=len(ordered))
    floor = max(least, int(count.max(initial=0)) // share)
    pick = np.flatnonzero(count >= floor)
    number = np.full(len(edge), -1, np.int32)
    number[pick] = np.arange(len(pick), dtype=np.int32)
    each = np.full(len(seq), -1, np.int32)
    each[place] = np.repeat(number, count)
    chosen = np.flatnonzero(each >= 0)
    pairs = ordered[edge[pick]]
    pairs = ((pairs >> np.uint64(half)) << np.uint64(32)) | (pairs & np.uint64((1 << half) - 1))
    return pairs.astype(np.int64), chosen, each[chosen], floor


def replace_pairs(seq: np.ndarray, head: np.ndarray, where: np.ndarray, number: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """seq with the pair at each place replaced by first + its number, from the left, none overlapping."""
    runs = np.flatnonzero(np.append(True, where[1:] - where[:-1] > 1))  # of a run of overlapping pairs, every second one is taken
    within = np.arange(len(where)) - np.repeat(runs, np.diff(runs, append=len(where)))
    take = np.flatnonzero(within & 1 == 0)
    where, number = where[take], number[take]
    out = seq.copy()
    out[where] = np.uint32(first) + number.astype(np.uint32)
    keep = np.ones(len(seq), bool)
    keep[where + 1] = False
    left = np.flatnonzero(keep)
    return out[left], head[left]


def compress(ids: np.ndarray, lengths: np.ndarray, base: int, least: int = LEAST, share: int = SHARE) -> dict:
    """Grammar of a shard: rules per round, symbols, expansion lengths, and each document's first symbol."""
    seq = ids.astype(np.uint32)
    head = np.zeros(len(seq), bool)
    head[(np.cumsum(lengths) - lengths)] = True
    made, per_round = [], []
    first, since = base, 0
    while len(seq) > 1:
        new, where, number, floor = frequent_pairs(seq, head, least, share, since)
        if not len(new):
            break
        seq, head = replace_pairs(seq, head, where, number, first)
        made.append(new)
        per_round.append(len(new))
        # once all pairs seen least times have been replaced or broken up, only those with a new symbol can be frequent
        since = first if floor == least else 0
        first += len(new)
    rules = np.concatenate(made) if made else np.empty(0, np.int64)
    left, right = rules >> 32, rules & 0xFFFFFFFF
    size = np.ones(first, np.int64)
    at = 0
    for n in per_round:
        size[base + at : base + at + n] = size[left[at : at + n]] + size[right[at : at + n]]
        at += n
    return {
        "n_symbols": len(seq), "base": base, "rounds": np.array(per_round, "<u4").tobytes(), "rules": np.stack([left, right], 1).astype("<u4").tobytes(),
        "expansions": size[base:].astype("<u4").tobytes(), "symbols": seq.astype("<u4").tobytes(), "doc_symbols": np.flatnonzero(head).astype("<u8").tobytes(),
    }


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; a round's rules are undone together, the last round's first."""
    seq, end = symbols.astype(np.uint32), int(base) + len(rules)
    for n in rounds[::-1].tolist():
        start = end - n
        made = np.flatnonzero(seq >= start)
        at = made + np.arange(len(made))
        kept = np.ones(len(seq) + len(made), bool)
        kept[at + 1] = False
        out = np.empty(len(kept), np.uint32)
        out[kept] = seq
        rule = rules[seq[made] - np.uint32(base)]
        out[at], out[at + 1] = rule[:, 0], rule[:, 1]
        seq, end = out, start
    return seq


def parts_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, rules, rounds, first symbol of each document, length of each document."""
    return np.frombuffer(row["symbols"], "<u4"), np.frombuffer(row["rules"], "<u4").reshape(-1, 2), np.frombuffer(row["rounds"], "<u4"), np.frombuffer(row["doc_symbols"], "<u8").astype(np.int64), np.frombuffer(row["doc_lengths"], "<u8").astype(np.int64)


def decode_document(row, number: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of one document of a block, expanding only the symbols that cover them."""
    symbols, rules, rounds, firsts, lengths = parts_of(row)
    stop = int(lengths[number]) if stop is None else min(stop, int(lengths[number]))
    own = symbols[firsts[number] : firsts[number + 1] if number + 1 < len(firsts) else len(symbols)]
    long = np.frombuffer(row["expansions"], "<u4")
    size = np.ones(len(own), np.int64)
    size[own >= row["base"]] = long[own[own >= row["base"]].astype(np.int64) - row["base"]]
    ends = np.cumsum(size)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    skip = start - (int(ends[a - 1]) if a else 0)
    return expand(own[a:b], rules, rounds, row["base"])[skip : skip + max(0, stop - start)]


class Encoder:
    """Ids of texts by the tokenizers library. memo_bytes: of text in which a piece is encoded but once."""

    libraries: dict[str, tuple] = {}

    def __init__(self, path: str, by_piece: bool = True, memo_bytes: int = TEXT_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if path not in self.libraries:  # a worker reads a vocabulary once
            library = Tokenizer.from_file(path)
            ends = np.zeros(library.get_vocab_size(with_added_tokens=True), bool)
            ends[[i for token, i in library.get_vocab().items() if token.endswith("</w>")]] = True
            # the same model without the steps that leave runs as they are: those of ASCII, and those with other letters
            plain, latin = Tokenizer(library.model), Tokenizer(library.model)
            plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            latin.normalizer = normalizers.Lowercase()
            latin.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.libraries[path] = library, plain, latin, ends
        self.library, self.plain, self.latin, self.word_end = self.libraries[path]
        self.by_piece, self.memo_bytes, self.size = by_piece, memo_bytes, len(self.word_end)

    def alone(self, pieces: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of pieces by the whole library, and how many each has."""
        for i in range(0, len(pieces), TOGETHER):
            got = [e.ids for e in self.library.encode_batch_fast(pieces[i : i + TOGETHER], add_special_tokens=False)]
            yield np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def together(self, library, runs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs, and how many each has: each ends with its one word end."""
        _, offsets, raw = pc.binary_join_element_wise(runs, *[pa.scalar(x, pa.large_string()) for x in ("", " ")]).buffers()
        cuts = np.append(np.frombuffer(offsets, np.int64, len(runs) + 1)[:-1:RUNS], raw.size if raw else 0).tolist()
        texts = [raw[i:j].to_pybytes().decode() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        for k in range(0, len(texts), TOGETHER):
            part = texts[k : k + TOGETHER]
            got = [e.ids for e in library.encode_batch_fast(part, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), np.uint32)
            ends = np.flatnonzero(self.word_end[ids]) + 1
            last = np.cumsum([t.count(" ") for t in part])
            if len(ends) == last[-1] and np.array_equal(ends[last - 1], np.cumsum([len(i) for i in got])):
                yield ids, np.diff(ends, prepend=0)
            else:
                yield from self.alone(" ".join(part).split())

    def learn(self, pieces: pa.Array, whole: np.ndarray) -> pa.Array:
        """The bytes of the ids of pieces that all differ."""
        runs = pc.ascii_rtrim(pieces.filter(pa.array(~whole)), " ").dictionary_encode()
        ascii_only = pc.string_is_ascii(runs.dictionary)
        first = ascii_only.to_numpy(zero_copy_only=False)
        got = [
            *self.together(self.plain, runs.dictionary.filter(ascii_only)), *self.together(self.latin, runs.dictionary.filter(pc.invert(ascii_only))),
            *self.alone(pieces.filter(pa.array(whole)).to_pylist()),
        ]
        place = np.empty(len(pieces), np.int64)  # of a piece in got
        place[whole] = np.arange(int(whole.sum())) + len(first)
        place[~whole] = np.where(first, np.cumsum(first) - 1, np.cumsum(~first) - 1 + first.sum())[runs.indices.to_numpy()]
        ends = np.cumsum(np.concatenate([[0], *[sizes for _, sizes in got]])) * 4
        flat = np.concatenate([np.empty(0, np.uint32), *[ids for ids, _ in got]])
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).take(pa.array(place))

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        ids_of, most = (self.by_pieces, self.memo_bytes) if self.by_piece else (self.entire, ENTIRE_BYTES)
        out, some, held = [], [], 0
        for text in texts.cast(pa.large_binary()).to_pylist():
            some.append(text or b"")
            held += len(some[-1])
            if held >= most:
                out += ids_of(some)
                some, held = [], 0
        return out + ids_of(some) if some else out

    def entire(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(got.ids, np.uint32) for got in self.library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def by_pieces(self, texts: list[bytes]) -> list[np.ndarray]:
        texts = [lowered(t) for t in texts]
        raw = b" ".join([b"", *texts, b""])
        starts, whole = cut(raw)
        coded = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        odd = np.zeros(len(coded.dictionary), bool)
        odd[codes[whole]] = True
        every = self.learn(coded.dictionary, odd).take(coded.indices)
        _, offsets, got = every.buffers()
        ends = np.frombuffer(offsets, np.int64, len(every) + 1) >> 2
        flat = np.frombuffer(got, np.uint32) if got and got.size else np.empty(0, np.uint32)
        bounds = ends[np.searchsorted(starts, np.cumsum([1, *[len(t) + 1 for t in texts]]))]
        return [flat[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def lowered(text: bytes) -> bytes:
    """A text with spaces for line ends and ASCII letters lowered, but for one in which a special token may stand."""
    return text.replace(b"\n", b" ") if b"<|" in text else text.translate(LOWER)


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of raw start, each with the spaces after it, and which must go to the library as they are. What
    stands between spaces is cut into runs of letters and of signs if it holds nothing else; raw begins with a space."""
    data, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(KIND), np.uint8)
    at = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != SPACE)) + 1
    begins = kind[at - 1] == SPACE
    firsts = at[begins]
    high = np.flatnonzero(data >= 0x80)
    own, before = data[high], data[high - 1]
    latin = (own == 0xC3) | ((before == 0xC3) & (own < 0xC0) & (own != 0x97) & (own != 0xB7))  # U+00C0 to U+00FF but for two signs
    odd = np.zeros(len(firsts), bool)
    for where in (np.flatnonzero(kind == OTHER), high[~latin]):
        odd[np.searchsorted(firsts, where, "right") - 1] = True
    whole = odd[np.cumsum(begins) - 1]
    keep = begins | ~whole
    return at[keep], whole[keep]


def encoded(docs: DataFrame, path: str, by_piece: bool = True, shard_bytes: int = SHARD_BYTES, partitions: int | None = None) -> DataFrame:
    """Shards of compressed ids in ascending doc_id order (SCHEMA); part and block number them in that order."""
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)

    layout = to_arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, inside = TaskContext.get().partitionId(), 0, 0
        encode = Encoder(path, by_piece)
        end = np.array([END], np.uint32)
        ids: list[np.ndarray] = []
        doc_ids: list[pa.Array] = []
        size = 0

        def close() -> pa.RecordBatch:
            """The shard's row; its texts are gone already, its ids go as they are joined."""
            lengths = np.fromiter(map(len, ids), np.int64, len(ids)) + 1
            flat = np.concatenate([x for got in ids for x in (got, end)])
            ids.clear()
            own = pa.concat_arrays(doc_ids)
            row = {"part": part, "block": block, "n_docs": len(lengths), "n_ids": len(flat), "inside": inside, "doc_ids": pc.fill_null(own, 0).to_numpy().astype("<i8").tobytes(), "doc_nulls": pc.is_null(own).to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), "doc_lengths": lengths.astype("<u8").tobytes()}
            return pa.RecordBatch.from_pylist([row | compress(flat, lengths, encode.size)], layout)

        for batch in batches:
            upto = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1))
            reach = lambda at, size, upto=upto: min(len(upto) - 1, int(np.searchsorted(upto, upto[at] + size)))
            stop = 0
            while stop < len(batch):
                start, at, stop = stop, stop, reach(stop, TEXT_BYTES)
                got = encode.batch(batch["text"].slice(start, stop - start))
                own = pa.array(batch["doc_id"].slice(start, stop - start).to_pylist(), pa.int64())  # a slice would hold the whole batch
                while at < stop:
                    upon = min(stop, reach(at, shard_bytes - size))
                    ids += got[at - start : upon - start]
                    doc_ids.append(own.slice(at - start, upon - at))
                    size += int(upto[upon] - upto[at])
                    at = upon
                    if size >= shard_bytes:
                        yield (out := close())
                        inside += out["n_ids"][0].as_py()
                        doc_ids, size, block = [], 0, block + 1
                        del out
                        trim()
        if doc_ids:
            yield close()
        del encode
        trim()

    ids = F.col("doc_id").asc_nulls_first()
    keyed = only(docs, "doc_id", "text").withColumn("from", F.spark_partition_id())  # one doc_id may be on very many rows
    ordered = keyed.repartitionByRange(partitions, ids, "from").sortWithinPartitions(ids, "from").drop("from")
    return ordered.mapInArrow(run, SCHEMA)


def decoded(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 and where it lies, from the files alone."""
    # a row for each range partition: their number is that of the writer's partitions, whatever the number of documents
    per_part = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).orderBy("part").collect()
    before, starts = 0, {}
    for p, n in per_part:
        starts[p] = before
        before += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, part int, block int, number int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                symbols, rules, rounds, _, lengths = parts_of(row)
                ids = expand(symbols, rules, rounds, row["base"]).astype("<u4")
                ends = np.cumsum(lengths)
                begin = ends - lengths
                view = memoryview(ids.tobytes())
                docs = pd.array(np.frombuffer(row["doc_ids"], "<i8"), "Int64")
                docs[np.frombuffer(row["doc_nulls"], np.uint8) > 0] = pd.NA
                yield pd.DataFrame({"doc_id": docs, "start": begin + row["inside"] + starts[row["part"]], "n_tokens": lengths, "ids_crc32": [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], "part": row["part"], "block": row["block"], "number": np.arange(len(lengths))})

    return blocks.select("part", "block", "base", "inside", "doc_ids", "doc_nulls", "doc_lengths", "doc_symbols", "rounds", "rules", "symbols").mapInPandas(run, schema)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write docs' token files in the shared folder and read them back."""
    files = written(encoded(docs, path or vocabulary_path()), "tokens")
    return decoded(files).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
