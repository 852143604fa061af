"""Five stages from raw documents to token files; each takes (spark, docs, sf_dir) and returns a DataFrame.

A stage works on all its predecessor kept. All but the last return the columns of docs. Each stage's rows are written in
the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import op1_decontaminate, op4_jaccard, op6_kneser_ney, op9_mixing, op10_repair
from gleaner.llm.common import checkpointed, drop_table, table, written

ORACLE_SQL = None


def keep(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id and text hash are among keys (doc_id, h)."""
    chosen = keys.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"))
    return docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's bound."""
    scores = op6_kneser_ney.perplexities(docs, table(spark, sf_dir, "labels"))
    return keep(docs, op6_kneser_ney.judged(scores).where("keep"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least doc_id of each class of near copies; of repeated rows one; where all ids of a class are
    null, the text of the least hash."""
    found = op4_jaccard.joined(docs)
    first = found.where("doc_id <=> class_id").groupBy("class", "doc_id").agg(F.min("h").alias("h"))
    names = docs.columns
    return keep(docs, checkpointed(first.select("doc_id", "h"))).withColumn("__h", F.xxhash64("text")).dropDuplicates(["doc_id", "__h"]).select(*[F.col(f"`{c}`") for c in names])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; one that holds any goes whole."""
    found = op1_decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0")
    bad = checkpointed(hit.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__d")) & F.xxhash64("text").eqNullSafe(F.col("__h")), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op9_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back."""
    return op10_repair.tokenized(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        if before is not None:  # nothing reads it any more
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
