"""Categories learned from labelled texts: n-grams, hashed term frequencies, inverse document frequencies and a multinomial
logistic regression, as one pyspark.ml pipeline that is saved and loaded."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import categories

FEATURES = 1 << 13
#: Rows a model is fitted on at most: those of the least hash, so that reruns agree.
SAMPLE = 5_000
#: A prediction counts from this probability, and adds this share of it to a rule's score.
AMBIGUOUS, BOOST = 0.3, 0.1


def trained(rows: DataFrame, text: str, label: str, sample: int = SAMPLE) -> PipelineModel:
    """A model of rows' labels by single words and pairs; rows without text or label teach nothing. Its columns begin with two
    underscores."""
    taught = rows.select(F.col(text).alias("__text"), F.col(label).alias("__label")).where("__text is not null and __label is not null")
    taught = taught.orderBy(F.xxhash64("__text", "__label")).limit(sample)
    many = taught.groupBy("__label").agg(F.count("*").alias("__n"))
    # classes weigh alike
    taught = taught.join(F.broadcast(many), "__label").withColumn("__weight", 1 / F.col("__n").cast("double"))
    stages = [RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}]+"), NGram(n=2, inputCol="__words", outputCol="__pairs")]
    for name in ("__words", "__pairs"):
        stages += [HashingTF(inputCol=name, outputCol=f"{name}_tf", numFeatures=FEATURES), IDF(inputCol=f"{name}_tf", outputCol=f"{name}_idf")]
    index = StringIndexer(inputCol="__label", outputCol="__index", stringOrderType="alphabetAsc").fit(taught)
    stages += [
        VectorAssembler(inputCols=["__words_idf", "__pairs_idf"], outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="__index", weightCol="__weight", maxIter=30, regParam=0.01, family="multinomial", probabilityCol="__chances", rawPredictionCol="__raw", predictionCol="__class"),
        IndexToString(inputCol="__class", outputCol="__predicted", labels=index.labels),
    ]
    return Pipeline(stages=stages).fit(index.transform(taught))


def predicted(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """rows with `predicted` and its `probability`; a null text is an empty one."""
    made = model.transform(rows.withColumn("__text", F.coalesce(F.col(text), F.lit(""))))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], F.col("__predicted").alias("predicted"), F.array_max(vector_to_array("__chances")).alias("probability"))


def keyword_model(spark, table: dict[str, tuple[str, ...]] = categories.CATEGORIES) -> PipelineModel:
    """A model taught by the keywords alone, each a text of its category."""
    return trained(spark.createDataFrame([(w, k) for k, words in table.items() for w in words], "text string, label string"), "text", "label")


def boosted(scores: Column, predicted: Column, probability: Column) -> Column:
    """Rule scores (array of struct score, order, name) with a share of the model's probability added to the category that it
    names, 1 at most; a prediction counts from AMBIGUOUS."""
    more = F.when(probability >= AMBIGUOUS, probability * BOOST).otherwise(0.0)
    return F.transform(scores, lambda s: F.struct(F.when((s["score"] > 0) & (s["name"] == predicted), F.least(F.lit(1.0), s["score"] + more)).otherwise(s["score"]).alias("score"), s["order"].alias("order"), s["name"].alias("name")))
