"""Exact top-k inner products by vector-approximation files.

Vectors are written once, a row for each file of at most FILE_BYTES: the exact integer vectors and, beside them, one cell
number per component on a grid of 2**BITS cells. A query first scans a file's cells alone: with the bounds of a cell, a
component adds at most q*high (q > 0) or q*low, so the scan is two matrix products. Exact vectors are then read in order
of falling bounds, in growing steps, until the k-th exact score is no less than every bound that is left; what earlier
files of the task gave is a floor from the start, and equal scores are kept until ties are settled by id. A window joins
the best of each task. Queries come in blocks of QUERY_BYTES, one broadcast alive at a time; a block is a pass over the
files whose answers are written in the shared folder, so that no plan grows with the number of queries.

Defined results: components become floor(1024 * x), x as double, and scores are exact integers; a score that doesn't fit
in a long, or a component whose 1024-fold isn't finite, ends the run with an error. Vectors null or with null or non-finite
components take no part. A row with a null vec_id is no query but a candidate, after equal scores with an id. A query meets
vectors of its own length only; empty ones score 0 with each other. Its own row, a row of its id and vector, is no candidate; should that row be there several times, all but one are. Each query row
gets its answers, repeated ones too; fewer than k candidates give fewer rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, spread, table, table_path, trim, written

K = 10
BITS = 6
FILE_BYTES = 16 << 20
SCAN_ROWS = 256
QUERY_BYTES = 32 << 20

ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.place, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.place <> q.place AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def whole(vector) -> np.ndarray | None:
    """A vector as integers, or None where it takes no part."""
    if vector is None:
        return None
    x = np.asarray(vector, dtype=object) if any(c is None for c in vector) else np.asarray(vector, np.float64)
    if x.dtype == object or not np.isfinite(x).all():
        return None
    with np.errstate(over="ignore"):
        x = np.floor(1024 * x)
    if not np.isfinite(x).all():
        raise ArithmeticError("1024 times a component isn't finite")
    return x


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products."""
    size = float(np.abs(query).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * len(query)
    if size < 2**52:
        return (vectors @ query).astype(np.int64)
    if size < 2**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    q = [int(c) for c in query]
    out = [sum(a * int(b) for a, b in zip(q, v, strict=True)) for v in vectors]
    if any(abs(x) >= 2**63 for x in out):
        raise ArithmeticError("a score doesn't fit in a long")
    return np.array(out, np.int64)


class VectorFile:
    """Cells and exact vectors of rows of one length."""

    def __init__(self, ids: np.ndarray, none: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray):
        self.ids, self.none, self.exact, self.cells, self.low, self.step = ids, none, exact, cells, low, step
        self.size = float(np.abs(exact).max(initial=0)) * exact.shape[1]

    @classmethod
    def of(cls, ids: np.ndarray, exact: np.ndarray, bits: int = BITS, none: np.ndarray | None = None) -> VectorFile:
        """none: which rows have no id."""
        low, high = exact.min(0), exact.max(0)
        step = np.maximum(1, np.ceil((high - low + 1) / (1 << bits)))
        none = np.zeros(len(ids), np.uint8) if none is None else none
        return cls(ids, none, exact, np.minimum((exact - low) // step, (1 << bits) - 1).astype(np.uint8), low, step)

    def row(self) -> dict:
        return {"dims": self.exact.shape[1], "ids": self.ids.astype("<i8").tobytes(), "none": self.none.tobytes(), "low": self.low.astype("<f8").tobytes(), "step": self.step.astype("<f8").tobytes(), "cells": self.cells.tobytes(), "exact": self.exact.astype("<f8").tobytes()}

    @classmethod
    def read(cls, row: dict) -> VectorFile:
        n, ids = row["dims"], np.frombuffer(row["ids"], "<i8")
        return cls(ids, np.frombuffer(row["none"], np.uint8), np.frombuffer(row["exact"], "<f8").reshape(len(ids), n), np.frombuffer(row["cells"], np.uint8).reshape(len(ids), n), np.frombuffer(row["low"], "<f8"), np.frombuffer(row["step"], "<f8"))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all scores from the cells alone."""
        low = self.low + self.cells * self.step
        high = low + self.step - 1
        out = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        if float(np.abs(queries).max(initial=0)) * self.size * 4 >= 2**52:  # sums then round, by their terms' size
            out += 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
        return out

    def top(self, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per query: its number, its k best rows here that may be among its k best of all, and their scores; floor has
        the k-th score known so far."""
        for a in range(0, len(queries), SCAN_ROWS):
            bound = self.bounds(queries[a : a + SCAN_ROWS])
            for number, b in enumerate(bound, a):
                able = np.flatnonzero(b >= floor[number])
                if not len(able):
                    continue
                b = b[able]
                step = min(len(b), 16 * k)
                while True:
                    rows = able[np.argpartition(-b, step - 1)[:step]] if step < len(b) else able
                    score = products(self.exact[rows], queries[number])
                    if step == len(b):
                        break
                    rest = -np.partition(-b, step)[step]
                    if len(score) >= k and np.partition(score, len(score) - k)[len(score) - k] > rest:
                        break
                    step = min(len(b), 4 * step)
                best = np.lexsort((self.ids[rows], self.none[rows], -score))[:k]
                yield number, rows[best], score[best]


FILES = "dims int, ids binary, none binary, low binary, step binary, cells binary, exact binary"


def vector_files(vectors: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The vectors (vec_id, embedding) as approximation files, written in the shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, none = defaultdict(list), defaultdict(list), defaultdict(list)

        def close(n: int) -> pd.DataFrame:
            return pd.DataFrame([VectorFile.of(np.array(ids.pop(n), np.int64), np.array(rows.pop(n)), none=np.array(none.pop(n), np.uint8)).row()])

        for batch in batches:
            for vec_id, lacks, vector in zip(batch["vec_id"].tolist(), batch["none"].tolist(), batch["embedding"], strict=True):
                if (x := whole(vector)) is not None:
                    n = len(x)
                    ids[n].append(vec_id)
                    none[n].append(lacks)
                    rows[n].append(x)
                    if len(ids[n]) * 8 * (n + 1) >= file_bytes:
                        yield close(n)
        for n in list(ids):
            yield close(n)

    given = only(vectors, "vec_id", "embedding").where("embedding is not null").select(F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNull().alias("none"), "embedding")
    return written(spread(given).mapInPandas(run, FILES), "vectors")


def query_blocks(queries: DataFrame, block_bytes: int) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Queries by length of vector (their numbers, ids and vectors), about block_bytes at a time on the driver."""
    held, size = defaultdict(lambda: ([], [], [])), 0

    def block():
        return {n: (np.array(number, np.int64), np.array(ids, np.int64), np.array(rows)) for n, (number, ids, rows) in held.items()}

    for number, (vec_id, vector) in enumerate(queries.toLocalIterator()):
        if (x := whole(vector)) is not None:
            for part, value in zip(held[len(x)], (number, vec_id, x), strict=True):
                part.append(value)
            size += 8 * len(x)
        if size >= block_bytes:
            yield block()
            held, size = defaultdict(lambda: ([], [], [])), 0
    if held:
        yield block()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, file_bytes: int = FILE_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score of each query row's k best vectors (both tables: vec_id, embedding)."""
    spark = vectors.sparkSession
    files = vector_files(vectors, file_bytes)
    asked = only(queries, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    schema = "query long, query_id long, vec_id long, score long, own boolean"
    path = table_path(spark, "answers")
    spark.createDataFrame([], schema).write.parquet(path)
    for block in query_blocks(asked, query_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            # the k best so far of each query and its own row: score, whether it lacks an id, id, whether it is the query's own
            best = {n: [[] for _ in numbers] for n, (numbers, _, _) in sent.value.items()}
            floor = {n: np.full(len(numbers), -np.inf) for n, (numbers, _, _) in sent.value.items()}
            for batch in batches:
                for row in batch.to_dict("records"):
                    if (n := row["dims"]) not in best:
                        continue
                    file = VectorFile.read(row)
                    _, ids, vectors = sent.value[n]
                    for q, rows, score in file.top(vectors, k + 1, floor[n]):
                        own = (file.none[rows] == 0) & (file.ids[rows] == ids[q]) & (file.exact[rows] == vectors[q]).all(1)
                        found = best[n][q] + list(zip((-score).tolist(), file.none[rows].tolist(), file.ids[rows].tolist(), own.tolist(), strict=True))
                        best[n][q] = found = sorted(found)[: k + 1]
                        if len(found) > k:
                            floor[n][q] = -found[k][0]
                trim()
            for n, answers in best.items():
                numbers, ids, _ = sent.value[n]
                for a in range(0, len(answers), 1000):
                    flat = [(int(numbers[q]), int(ids[q]), None if lacks else vec_id, -score, own) for q in range(a, min(a + 1000, len(answers))) for score, lacks, vec_id, own in answers[q]]
                    yield pd.DataFrame(flat, columns=["query", "query_id", "vec_id", "score", "own"]).astype({"vec_id": "Int64"})

        files.mapInPandas(run, schema).write.mode("append").parquet(path)
        sent.destroy()
    found = spark.read.schema(schema).parquet(path)
    # of rows alike to the query one is its own; it is among the k + 1 best of its kind, or not among the k best at all
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), F.desc("own"))
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    alike = F.sum(F.col("own").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    left = first.withColumn("alike", alike).where("not (own and alike = 1)").withColumn("rank", F.row_number().over(order))
    return left.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))
