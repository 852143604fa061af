"""The pipeline's stages, one after the other on the small table, against brute force."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gleaner.llm import op9_mixing, op10_repair
from gleaner.llm.common import WORD

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows(df):
    return collections.Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages[0]
    kept = {r["doc_id"] for r in after.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    good, bad = set(labels.doc_id[labels.quality == 1]), set(labels.doc_id[labels.quality == 0])
    assert len(good & kept) >= 0.98 * len(good) and len(bad & kept) <= 0.5 * len(bad)
    assert not rows(after) - rows(before)


def test_near_duplicates_leave_one(stages):
    before, after = stages[1]
    docs = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = [frozenset(tuple(w[k : k + min(5, len(w))]) for k in range(len(w) - min(5, len(w)) + 1)) if (w := words(t)) else None for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in after.collect()) == [docs[k][0] for k in range(len(docs)) if root(k) == k]


def test_decontaminated(spark, stages):
    before, after = stages[2]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    dirty = lambda t: any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)) if (w := words(t)) else False
    assert rows(after) == collections.Counter({k: v for k, v in rows(before).items() if not dirty(k[1])})


def test_mixed(stages):
    before, after = stages[3]
    want = collections.Counter()
    for r in op9_mixing.chosen(op9_mixing.sized(before)).collect():
        want[r["doc_id"]] += r["copies"]
    got = collections.Counter(r["doc_id"] for r in after.collect())
    assert got == +want


def test_tokens(stages):
    from tokenizers import Tokenizer

    before, after = stages[4]
    library = Tokenizer.from_file(op10_repair.vocabulary_path())
    want = collections.Counter()
    for r in before.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after.collect()) == want


def test_odd_rows_go_through_all_stages(spark):
    """Null and repeated ids, null texts and sources, copies and columns with the names that stages use themselves."""
    from pyspark.sql import functions as F

    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    nobody = base.limit(5).withColumn("doc_id", F.lit(None).cast("long"))
    again = base.where("doc_id < 20").withColumn("text", F.concat("text", F.lit(" and some more words of its own here at the end")))
    silent = base.limit(3).withColumns({"text": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.col("doc_id") + 90_000})
    docs = base.unionByName(base.limit(10)).unionByName(nobody).unionByName(again).unionByName(silent)
    docs = docs.withColumns({"h": F.lit(1), "class": F.lit("x"), "size": F.lit(2), "copies": F.lit(3), "more": F.lit(4), "keep": F.lit(False), "start": F.lit(5)})
    many = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
        held = docs.count()
        assert 0 < held <= (many if "mixing" not in name else 3 * many), name
        many = held
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).orderBy("start").collect()
    assert len(out) == many and out[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:], strict=False))


def test_an_empty_table_goes_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
