"""Learned categories, run statistics and extraction by a schema."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gleaner.functions import categories, extraction
from gleaner.operators import learned, records
from gleaner.plans import scoring


def test_learned_categories_hold_out(spark):
    got = scoring.learned_categories(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.avg((F.col("predicted") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 150 and right > 0.9


def test_a_model_is_saved_and_boosts_what_it_names(spark, tmp_path):
    model = learned.keyword_model(spark)
    model.write().save(str(tmp_path / "m"))
    rows = spark.createDataFrame([(1, "laptop smartphone camera"), (2, None), (3, "")], "id long, said string").withColumn("words", F.lit("clash"))
    first = learned.predicted(model, rows, "said").orderBy("id").collect()
    again = learned.predicted(PipelineModel.load(str(tmp_path / "m")), rows, "said").orderBy("id").collect()
    assert first == again and first[0]["predicted"] in categories.CATEGORIES and len(first) == 3
    scores = categories.scores(F.lit("laptop"))
    out = spark.range(1).select(scores.alias("a"), learned.boosted(scores, F.lit(first[0]["predicted"]), F.lit(0.8)).alias("b"), learned.boosted(scores, F.lit(first[0]["predicted"]), F.lit(0.2)).alias("c")).first()
    assert out["a"] == out["c"]
    for x, y in zip(out["a"], out["b"], strict=True):
        assert y["score"] == pytest.approx(min(1.0, x["score"] + 0.08) if x["score"] > 0 and x["name"] == first[0]["predicted"] else x["score"])


def test_run_statistics(spark):
    rows = [(1, "a", True, 0.9), (2, "a", True, 0.9), (3, "b", False, 0.9), (4, "b", True, 0.1), (5, "b", True, 0.9), (6, None, True, 0.9), (7, None, True, None), (8, "c", None, 0.9)]
    df = spark.createDataFrame(rows, "id long, k string, ok boolean, q double")
    kept, seen = records.run_statistics(df, F.col("ok"), "k", "id", F.col("q"), 0.5)
    assert sorted(r["id"] for r in kept.collect()) == [1, 6]
    assert seen.get == {"processed": 2, "valid": 6, "invalid": 2, "duplicates": 2, "dropped": 2}
    assert kept.columns == df.columns


def test_extraction_takes_the_schema_given(spark):
    extraction.register(spark)
    pages = [
        (1, """<script type='application/ld+json'>{"@type":"Product","name":"x","price":"12.5","rating":{"value":4,"n":"7"},"review":[{"a":1}],"image":"i"}</script><meta property="og:image" content="o"><meta property="og:title" content="t">"""),
        (2, '<script type="application/ld+json">not json</script><script type="application/ld+json">[{"@type":"Event","name":"e"},{"@type":"Product","name":"p","price":null}]</script>'), (3, ""), (4, None),
        (5, '<script type="application/ld+json">{"@type":"Unknown","name":"u"}</script><meta property="og:url" content="http://u">'),
    ]
    spark.createDataFrame(pages, "id int, html string").createOrReplaceTempView("learned_pages")
    ask = lambda schema: {r["id"]: tuple(r)[1:] for r in spark.sql(f"SELECT id, e.* FROM learned_pages, LATERAL extract_fields(html, '{schema}') e").collect()}
    got = ask('{"properties": {"name": {}, "price": {"type": "number"}, "rating": {"type": "object", "properties": {"value": {"type": "integer"}, "n": {"type": "integer"}}}, "review": {}, "image": {"type": "array", "items": {}}}}')
    assert got[1] == ("x", 12.5, (4, 7), '[{"a": 1}]', ["i"]) and got[2] == ("e", None, None, None, None)
    assert got[3] == got[4] == (None,) * 5 and got[5][0] is None
    assert ask('{"properties": {"url": {}, "price": {"type": "boolean"}}}')[5] == ("http://u", None)
    with pytest.raises(Exception, match="no column has the type"):
        ask('{"properties": {"a": {"type": "date"}}}')
