"""Plugins, scraped metrics, alerts by time, addresses and dates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import dates, text, urls
from gleaner.operators import metrics
from gleaner.operators.plugins import Registry
from gleaner.sources import feeds


def test_plugins_run_in_order_and_fail_alone(spark):
    r = Registry()
    r.add("transformer", "one", lambda d: d.withColumn("a", F.lit(1)), version="1.2.0")
    r.add("transformer", "bad", lambda d: d.select("no such column"))
    r.add("transformer", "two", lambda d: d.withColumn("b", F.col("a") + 1), needs=("one>=1.1",))
    with pytest.raises(ValueError):
        r.add("transformer", "three", lambda d: d, needs=("one>=2.0",))
    with pytest.raises(ValueError):
        r.add("sink", "x", lambda d: d)
    got = r.transform(spark.range(1))
    assert got.columns == ["id", "a", "b"] and [f[0] for f in r.failures] == ["bad"]
    r.disabled.add("two")
    assert r.transform(spark.range(1)).columns == ["id", "a"]
    r.add("hook", "first", lambda c: {**c, "n": c["n"] + 1})
    r.add("hook", "breaks", lambda c: c["missing"])
    r.add("hook", "last", lambda c: {**c, "n": c["n"] * 10})
    assert r.run_hooks({"n": 1}) == {"n": 20} and r.failures[-1][0] == "breaks"
    r.add("validator", "any", lambda: F.lit(True))
    r.add("validator", "typed", lambda kind: F.lit(kind == "article"))
    assert spark.range(1).select(*[c.alias(n) for n, c in r.rules("article").items()]).first().asDict() == {"any": True, "typed": True}


def test_histogram_lines(spark):
    df = spark.createDataFrame([("a\n", 1.0), ("a\n", 20.0), (None, None)], "k string, v double")
    got = [r["value"] for r in feeds.exposed_histogram(df, "h", "what", ["k"], "v", (5.0, 10.0)).orderBy("place").collect()]
    assert got[:2] == ["# HELP h what", "# TYPE h histogram"]
    assert set(got[2:]) == {'h_bucket{k="a\\n",le="5"} 1', 'h_bucket{k="a\\n",le="10"} 1', 'h_bucket{k="a\\n",le="+Inf"} 2', 'h_sum{k="a\\n"} 21.0', 'h_count{k="a\\n"} 2', 'h_bucket{k="",le="5"} 0', 'h_bucket{k="",le="10"} 0', 'h_bucket{k="",le="+Inf"} 0', 'h_sum{k=""} 0.0', 'h_count{k=""} 0'}


def test_alerts_by_time_over_several_ranges(spark):
    r = random.Random(7)
    rows = [(k, r.choice(["hot"] * 6 + ["x", None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 90_000)), r.random() < 0.97 if r.random() < 0.98 else None) for k in range(3000)]
    got = {x["id"]: x["alert"] for x in metrics.holds_since(spark.createDataFrame(rows, "id long, k string, ts timestamp, ok boolean").repartition(3), "k", "ts", F.col("ok"), 300, "id").collect()}
    since: dict = {}
    for i, k, t, ok in sorted(rows, key=lambda x: (x[2], x[0])):
        since[k] = (since.get(k) or t) if ok else None
        assert got[i] == bool(ok and (t - since[k]).total_seconds() >= 300), (i, k)
    assert sum(got.values()) > 50


def test_addresses_dates_and_zeros(spark):
    for value, want in (("a.b/c", "https://a.b/c"), (" //a.b ", "https://a.b"), ("http://x", "http://x"), ("ftp://f/g", "ftp://f/g"), ("mailto:a@b", None), ("", None), ("  ", None), (None, None), ("https://", None), ("HTTP://x", "https://HTTP://x")):
        assert spark.range(1).select(urls.with_scheme(F.lit(value).cast("string"))).first()[0] == want, value
    base = F.lit("2024-01-31 12:00:00").cast("timestamp")
    for value, want in (("1/2/2024", "2024-01-02"), ("13-02-2024", "2024-02-13"), ("3.4.2024", "2024-04-03"), ("5 Jun 2024", "2024-06-05"), ("Jun 5, 2024", "2024-06-05"), ("2024-05-06T07:08:09Z", "2024-05-06"), ("1700000000", "2023-11-14"), ("1700000000000", "2023-11-14"), ("2 days ago", "2024-01-29"), ("a moment ago", "2024-01-31"), ("soon", None), (None, None)):
        got = spark.range(1).select(F.date_format(dates.month_first(F.lit(value).cast("string"), base), "yyyy-MM-dd")).first()[0]
        assert got == want, value
    zeros = spark.createDataFrame([("0",), ("-0.00",), ("0E-10",), (" .0 ",), ("00",), ("1",), ("0x",), ("",), (None,)], "v string").select("v", text.is_zero(F.col("v")).alias("z"), text.is_blank(F.col("v")).alias("b")).collect()
    assert [(r["z"], r["b"]) for r in zeros] == [(True, False)] * 5 + [(False, False)] * 2 + [(False, True)] * 2
