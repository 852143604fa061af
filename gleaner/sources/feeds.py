"""Further sources and sinks: record files, caches with a time to live, databases, queues, logs, metrics and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    """JSON lines, CSV with a header, Parquet or text; a schema spares the pass that infers one."""
    reader = spark.read.schema(schema) if schema else spark.read
    return {"jsonl": reader.json, "csv": reader.option("header", True).csv, "parquet": reader.parquet, "text": spark.read.text}[kind](path)


def live_cache(spark: SparkSession, path: str, schema: str, base: Column, ttl_seconds: int) -> DataFrame:
    """Entries of a JSON cache folder not older than the time to live at a base time."""
    return spark.read.schema(schema).json(path).where(F.unix_seconds("created_at") >= F.unix_seconds(base) - ttl_seconds)


def read_database(spark: SparkSession, url: str, name: str, key: str, low: int, high: int, parts: int) -> DataFrame:
    """A database table in ranges of a key, read side by side."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def task_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Task envelopes from files as they come, with their place by priority."""
    tasks = spark.readStream.schema(schema).json(path)
    return tasks.withColumn("queue", F.when(F.col("priority") >= 10, "high").when(F.col("priority") >= 5, "normal").otherwise("low"))


def route_failures(batch: DataFrame, failed: Column, retries: int, again: str, dead: str) -> None:
    """For foreachBatch: failed tasks go back with their count raised, and after so many tries to the dead letters."""
    rows = batch.where(failed)
    rows.where(F.col("retry_count") < retries).withColumn("retry_count", F.col("retry_count") + 1).write.mode("append").json(again)
    rows.where(F.col("retry_count") >= retries).withColumn("error", F.lit("retries used up")).write.mode("append").json(dead)


def labelled(name: str, labels: list[str], extra: Column | None = None) -> Column:
    """name{labels}; in label values backslashes, quotes and line ends are escaped."""
    escaped = lambda k: F.replace(F.replace(F.replace(F.coalesce(F.col(k).cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    told = [F.concat(F.lit(f'{k}="'), escaped(k), F.lit('"')) for k in labels] + ([extra] if extra is not None else [])
    return F.concat(F.lit(name + "{"), F.concat_ws(",", *told), F.lit("} "))


def exposition(metrics: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Lines of the text form in which metrics are scraped."""
    return metrics.select(F.concat(labelled(name, labels), F.col(value).cast("string")).alias("value"))


def exposed(metrics: DataFrame, name: str, kind: str, help_: str, labels: list[str], value: str) -> DataFrame:
    """Lines (family, place, value) of a counter or gauge with its HELP and TYPE before them; ordered by family and place they
    are what is scraped."""
    head = metrics.sparkSession.createDataFrame([(name, 0, f"# HELP {name} {help_}"), (name, 1, f"# TYPE {name} {kind}")], "family string, place int, value string")
    return head.unionByName(exposition(metrics, name, labels, value).select(F.lit(name).alias("family"), F.lit(2).alias("place"), "value"))


def exposed_histogram(rows: DataFrame, name: str, help_: str, labels: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """The same lines of a histogram: cumulative buckets, sum and count for each set of labels, by one partial aggregate."""
    shown = [f"{b:g}" for b in bounds] + ["+Inf"]
    sums = rows.groupBy(*labels).agg(*[F.count_if(F.col(value) <= b).alias(f"__b{k}") for k, b in enumerate(bounds)], F.count(value).alias(f"__b{len(bounds)}"), F.sum(F.col(value).cast("decimal(30,6)")).alias("__sum"))
    cells = [F.concat(labelled(f"{name}_bucket", labels, F.lit(f'le="{b}"')), F.col(f"__b{k}").cast("string")) for k, b in enumerate(shown)]
    ends = [F.concat(labelled(f"{name}_sum", labels), F.coalesce("__sum", F.lit(0)).cast("double").cast("string")), F.concat(labelled(f"{name}_count", labels), F.col(f"__b{len(bounds)}").cast("string"))]
    head = rows.sparkSession.createDataFrame([(name, 0, f"# HELP {name} {help_}"), (name, 1, f"# TYPE {name} histogram")], "family string, place int, value string")
    return head.unionByName(sums.select(F.lit(name).alias("family"), F.lit(2).alias("place"), F.explode(F.array(*cells, *ends)).alias("value")))


def log_records(lines: DataFrame, tag: str, cluster: str) -> DataFrame:
    """JSON log lines of a tag, with a constant field and the nested fields lifted under a prefix."""
    parsed = lines.where(F.col("tag").startswith(tag)).withColumn("r", F.from_json("value", "msg string, level string, kubernetes struct<pod:string,namespace:string>"))
    return parsed.select("tag", "r.msg", "r.level", F.col("r.kubernetes.pod").alias("k8s_pod"), F.col("r.kubernetes.namespace").alias("k8s_namespace"), F.lit(cluster).alias("cluster"))


def retained(snapshots: DataFrame, base: Column, days: int) -> DataFrame:
    """Snapshots young enough to keep."""
    return snapshots.where(F.col("made_at") >= base - F.make_dt_interval(F.lit(days)))
