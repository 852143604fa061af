"""Operators on small tables made here."""

import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from gleaner.functions import pages, text, urls
from gleaner.operators import dedup, graph, metrics, ordering, records
from gleaner.sources import tables
from gleaner.streaming import folds, windows


def test_urls(spark):
    row = spark.createDataFrame([("HTTPS://Example.com/A?utm_source=x&b=1#f",)], "u string").select(urls.canonical(F.col("u")), urls.strict_key(F.lit("https://www.Example.com/a/?utm_source=x")), urls.semantic_key(F.lit("http://www.example.com/a/#top"))).first()
    assert list(row) == ["https://example.com/a?b=1", "example.com/a/", "https://example.com/a"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], ("x", "y"))], "a long, b array<int>, c struct<d:string,e:string>")
    tables.fan_out(df, str(tmp_path), "all")
    assert sorted(spark.read.parquet(f"{tmp_path}/parquet").columns) == ["a", "b", "c_d", "c_e"]
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["c_d"] == "x"
    assert tables.write_legacy(df, f"{tmp_path}/old") == ["jsonl"]
    good, bad = tables.split_bad(df.select("a"), F.array_compact(F.array(F.when(F.col("a") > 0, "positive"))))
    assert (good.count(), bad.first()["_errors"]) == (0, ["positive"])


def test_sitemap_and_robots(spark):
    xml = '<urlset xmlns="http://x/y"><url><loc>http://a/1</loc><priority>0.5</priority></url><url><loc> http://a/2 </loc></url></urlset>'
    robots = "User-agent: *\nDisallow: /p\nAllow: /p/ok\nUser-agent: b\nDisallow: /\nSitemap: http://a/s.xml"
    row = spark.range(1).select(tables.sitemap_entries(F.lit(xml)).alias("s"), tables.robots_sitemaps(F.lit(robots)).alias("r"), *[tables.robots_allow(F.lit(robots), F.lit(p)).alias(p) for p in ("/p/x", "/p/ok/1", "/q")]).first()
    assert [e["loc"] for e in row["s"]] == ["http://a/1", "http://a/2"] and row["s"][0]["priority"] == 0.5
    assert row["r"] == ["http://a/s.xml"] and [row[p] for p in ("/p/x", "/p/ok/1", "/q")] == [False, True, True]


def test_hamming_pairs_against_brute_force(spark):
    r = random.Random(1)
    signs = []
    for k in range(60):  # a bit string and copies with up to five bits flipped
        base = [r.choice("01") for _ in range(64)]
        for j in range(4):
            other = list(base)
            for p in r.sample(range(64), r.randint(0, 5)):
                other[p] = "1" if other[p] == "0" else "0"
            signs.append((10 * k + j, "".join(other)))
    heads = {}
    for i, b in signs:
        heads[b] = min(i, heads.get(b, i))
    far = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True))
    want = {(i, j, far(a, b)) for a, i in heads.items() for b, j in heads.items() if i < j and far(a, b) <= 3}
    got = [tuple(x) for x in dedup.hamming_pairs(spark.createDataFrame(signs, "id long, bits string"), "id").collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


def test_simhash_finds_planted_copies(spark):
    text = " ".join(f"word{k}" for k in range(600))
    docs = spark.createDataFrame([(1, text), (2, text.replace("word300", "edited")), (3, " ".join(f"other{k}" for k in range(600)))], "doc_id long, text string")
    got = dedup.hamming_pairs(dedup.simhash_counts(docs, "doc_id", "text"), "doc_id").collect()
    assert [(x["left"], x["right"]) for x in got] == [(1, 2)]


def test_ranks_and_rates_do_not_depend_on_ranges(spark):
    r = random.Random(2)
    rows = [(k, r.choice("aab"), float(r.randint(0, 50)), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 4000))) for k in range(800)]
    df = spark.createDataFrame(rows, "id long, key string, value double, ts timestamp")
    for x in metrics.ranks(df, "key", "value", 5).collect():
        own = [v for _, k, v, _ in rows if k == x["key"]]
        assert (x["upto"], x["all"]) == (sum(v <= x["value"] for v in own), len(own))
    got = {x["id"]: x["rate"] for x in metrics.rate(df, "key", "ts", 60).collect()}
    assert got == {i: sum(0 <= (t - u).total_seconds() < 60 for _, q, _, u in rows if q == k) / 60 for i, k, _, t in rows}


def test_within_a_hot_key_that_fills_several_ranges(spark):
    r = random.Random(6)
    keys = ["hot" if r.random() < 0.5 else None if r.random() < 0.2 else f"k{r.randint(0, 60)}" for _ in range(2000)]
    got = {x["id"]: (x["ordinal"], x["repeat"]) for x in dedup.within(spark.createDataFrame(list(enumerate(keys)), "id long, k string").repartition(5), "k", "id", 6).collect()}
    last: dict = {}
    for i, k in enumerate(keys):
        assert got[i] == (i + 1, k in last and i - last[k] <= 6)
        last[k] = i


def test_ordinals_of_several_keys(spark):
    rows = [(k % 7, k) for k in range(500)]
    got = [tuple(x) for x in ordering.ordinals(spark.createDataFrame(rows, "a long, b long"), F.desc("a"), "b", parts=5).orderBy("ordinal").collect()]
    assert got == [(a, b, n) for n, (a, b) in enumerate(sorted(rows, key=lambda x: (-x[0], x[1])), 1)]
    assert ordering.ordinals(spark.createDataFrame([], "a long"), "a").count() == 0


def test_similar_leaves_out_what_is_no_direction(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((x["query_id"], x["vec_id"]) for x in dedup.similar(df, df, 0.9).collect()) == [(1, 2), (2, 1)]


def test_hamming_pairs(spark):
    a = "01" * 32
    b = a[:5] + ("1" if a[5] == "0" else "0") + a[6:]
    signs = spark.createDataFrame([(1, a), (2, b), (3, a), (4, "1" * 64)], "id long, bits string")
    assert [tuple(r) for r in dedup.hamming_pairs(signs, "id").collect()] == [(1, 2, 1)]


def test_fuzzy_titles_miss_no_pair(spark):
    r = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", text.title_key(F.substring("text", 1, 90)).alias("t")).where("t <> ''").orderBy("doc_id").limit(1000)
    titles = [(x["doc_id"], x["t"]) for x in docs.collect()]
    words = ["photography", "cat", "a", "ab", "solid walnut desk", "quick brown fox jumps", "internationalisation"]
    for k, base in enumerate(words + [t for _, t in titles[:60]]):  # a typo in each word, letters dropped, doubled or exchanged
        def typo(w):
            at, how = r.randrange(len(w)), r.randrange(3)
            return w[:at] + (w[at + 1 :] if how == 0 else w[at] + w[at:] if how == 1 else r.choice("xyzé") + w[at + 1 :])

        titles += [(10_000 + 10 * k, base), (10_001 + 10 * k, " ".join(map(typo, base.split()))), (10_002 + 10 * k, typo(base)), (10_003 + 10 * k, base + base[-1]), (10_004 + 10 * k, base)]
    titles += [(-1, None), (-2, "")]
    for threshold, some in ((0.9, titles), (0.75, titles[::3])):
        least = {}
        for k, t in some:
            if t:
                least[t] = min(k, least.get(t, k))
        rows = sorted((k, t) for t, k in least.items())
        want, m = {}, difflib.SequenceMatcher(None)
        for a, (old_id, old) in enumerate(rows):
            m.set_seq2(old)
            for new_id, new in rows[a + 1 :]:
                if 2 * min(len(old), len(new)) >= threshold * (len(old) + len(new)):
                    m.set_seq1(new)
                    if m.quick_ratio() >= threshold and m.ratio() >= threshold:
                        want[old_id, new_id] = m.ratio()
        got = {(x["left"], x["right"]): x["ratio"] for x in dedup.fuzzy_titles(spark.createDataFrame(some, "id long, t string"), "id", "t", threshold).collect()}
        assert got == want
        assert len(want) > 40
    assert dedup.fuzzy_titles(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_eviction_and_upsert(spark):
    d = spark.createDataFrame([(k, 10) for k in range(10)], "id long, size int")
    assert [r["id"] for r in records.evicted(d, "id", "size", 50).where("gone").orderBy("id").collect()] == list(range(6))
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, None), (3, "c")], "k long, v string")
    assert sorted(map(tuple, records.upserted(old, new, "k").collect())) == [(1, "a"), (2, "b"), (3, "c")]


def test_health_and_types(spark):
    row = spark.range(1).select(metrics.worst(F.array(F.lit("healthy"), F.lit("degraded"))), metrics.worst(F.array().cast("array<string>")), records.item_type(F.array(F.lit("name"), F.lit("price")))).first()
    assert list(row) == ["degraded", "unknown", "product"]


def test_expand_stops_at_seen(spark):
    edges = spark.createDataFrame([(1, 2, 0), (2, 1, 0), (2, 3, 1), (3, 4, 0)], "source long, target long, position int")
    got = graph.expand(spark.createDataFrame([(1,)], "node long"), edges, 2).collect()
    assert sorted(map(tuple, got)) == [(1, 0), (2, 1), (3, 2)]


def test_page_text(spark):
    assert spark.range(1).select(pages.visible_text(F.lit("<p>a <b>b</b></p><script>x()</script>"))).first()[0] == "a b"


def test_stream_agrees_with_replay(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(k, base + dt.timedelta(minutes=37 * k), k % 3, "error" if k % 4 == 0 else "view", float(k * 31 % 97)) for k in range(90)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    for part in range(3):
        events.where(f"event_id div 30 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for kind in folds.MACHINES:
        want = sorted(map(tuple, folds.replay(events, kind).collect()))
        assert sorted(map(tuple, windows.replayed(events, folds.stream(source, kind), f"s_{kind}").collect())) == want
    assert windows.replayed(events, windows.distinct(source, "user_id"), "s_distinct").count() == 3
    batch, live = windows.rates(events), windows.replayed(events, windows.rates(source), "s_rates", "complete")
    assert sorted(map(str, live.collect())) == sorted(map(str, batch.collect()))


def test_plugins(spark):
    import pytest

    from gleaner.operators.plugins import Registry

    r = Registry()
    r.add("transformer", "double", lambda d: d.withColumn("x", F.col("x") * 2))
    r.add("transformer", "next", lambda d: d.withColumn("x", F.col("x") + 1), needs=("double",))
    r.add("validator", "positive", lambda: F.col("x") <= 0)
    with pytest.raises(ValueError):
        r.add("hook", "late", print, needs=("absent",))
    df = r.transform(spark.createDataFrame([(1,), (-3,)], "x long"))
    assert [x["valid"] for x in records.validated(df, r.rules(), {}).orderBy("x").collect()] == [False, True]
