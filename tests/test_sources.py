"""Options, caches, logs and queues."""

import datetime as dt

from pyspark.sql import functions as F

from gleaner.sources import config, feeds


def test_options():
    env = config.from_environment({"APP_A__B": "true", "APP_C": "1.5", "OTHER": "x"}, "APP_")
    assert config.merged({"a": {"b": False, "z": 1}, "c": 0}, env, {"d": [1]}) == {"a": {"b": True, "z": 1}, "c": 1.5, "d": [1]}
    assert [config.literal(x) for x in ("None", "x y", "[1]")] == [None, "x y", [1]]


def test_cache(spark, tmp_path):
    base = dt.datetime(2024, 1, 31)
    rows = spark.createDataFrame([("a", base - dt.timedelta(hours=1)), ("b", base - dt.timedelta(days=3))], "key string, created_at timestamp")
    rows.write.json(str(tmp_path / "c"))
    kept = feeds.live_cache(spark, str(tmp_path / "c"), "key string, created_at timestamp", F.lit(base), 86400)
    assert [r["key"] for r in kept.collect()] == ["a"]


def test_logs_and_metrics(spark):
    lines = spark.createDataFrame([("kube.a", '{"msg": "m", "level": "info", "kubernetes": {"pod": "p"}}'), ("other", "{}")], "tag string, value string")
    assert [tuple(r) for r in feeds.log_records(lines, "kube.", "c1").collect()] == [("kube.a", "m", "info", "p", None, "c1")]
    assert feeds.exposition(spark.createDataFrame([("x", 3)], "t string, n long"), "done", ["t"], "n").first()[0] == 'done{t="x"} 3'
    assert feeds.exposition(spark.createDataFrame([('a"b\\c\nd', 3)], "t string, n long"), "done", ["t"], "n").first()[0] == 'done{t="a\\"b\\\\c\\nd"} 3'


def test_failures_are_routed(spark, tmp_path):
    batch = spark.createDataFrame([(1, 0, True), (2, 3, True), (3, 0, False)], "id long, retry_count int, bad boolean")
    feeds.route_failures(batch, F.col("bad"), 3, str(tmp_path / "again"), str(tmp_path / "dead"))
    assert [(r["id"], r["retry_count"]) for r in spark.read.json(str(tmp_path / "again")).collect()] == [(1, 1)]
    assert [r["id"] for r in spark.read.json(str(tmp_path / "dead")).collect()] == [2]


def test_record_files_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(1, 12), (2, 1)], "id long, priority long")
    df.write.json(str(tmp_path / "t"))
    assert feeds.read_records(spark, str(tmp_path / "t"), "jsonl", "id long, priority long").count() == 2
    q = feeds.task_stream(spark, str(tmp_path / "t"), "id long, priority long").writeStream.format("memory").queryName("tasks").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["id"], r["queue"]) for r in spark.table("tasks").collect()) == [(1, "high"), (2, "low")]
    kept = feeds.retained(df.withColumn("made_at", F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id as int)*5)")), F.lit(dt.datetime(2024, 1, 12)), 3)
    assert [r["id"] for r in kept.collect()] == [2]


def test_search_pages_take_conditions_over(spark, tmp_path):
    import datetime as dt

    from gleaner.sources import search

    rows = [(k, f"u{k}", None if k % 7 == 0 else f"s{k % 4}", None if k == 5 else f"t{k}", "en" if k % 3 else None, dt.datetime(2024, 1, 1) + dt.timedelta(days=k) if k % 5 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, url string, site string, title string, language string, published timestamp")
    path = str(tmp_path / "p")
    search.write_pages(df, "k", path, 7)
    pages = search.read_pages(spark, path)
    ranked = df.select((F.col("k") + 1).alias("rank"), "url", "site", "title", "language", "published", F.ceil((F.col("k") + 1) / 7).cast("int").alias("page"))
    since = F.lit("2024-01-20").cast("timestamp")
    for condition, pushed in (
        (F.col("site") == "s1", "site"), (F.col("site").isin("s1", "s2") & ~F.col("site").isin("s2", "s0"), "site"), (F.col("site") != "s3", "site"), (F.col("published") >= since, "published"),
        ((F.col("page") > 2) & (F.col("page") <= 5), "page"), (F.col("page") == 9, "page"), (F.col("language") == "en", "language"), (F.col("title").isNull(), None), ((F.col("page") < 3) & (F.col("page") == 4), "page"),
    ):
        assert sorted(pages.where(condition).collect(), key=lambda r: r["rank"]) == sorted(ranked.where(condition).collect(), key=lambda r: r["rank"])
        plan = pages.where(condition)._jdf.queryExecution().executedPlan().toString()
        kept = plan.split("Filter")[1].split("BatchScan")[0] if "Filter" in plan else ""
        assert pushed is None or f"({pushed}#" not in kept.replace(f"isnotnull({pushed}#", "")
    assert pages.where("page = 3").rdd.getNumPartitions() == 1
    assert search.read_pages(spark, path).rdd.getNumPartitions() == 9
    assert pages.count() == 60
