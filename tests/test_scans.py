"""Windows over slices against windows over whole keys, and how their work is spread."""

import random
import time
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.operators import loading as L
from candela.operators import scans as S
from candela.operators import timeseries as TS
from candela.plans.metrics import metrics
from candela.sources.market import assets

D0 = date(1996, 1, 1)


def series(spark, seed=1, keys=3, n=400):
    """Days with gaps, some longer than a slice of the tests, values with nulls and ties."""
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        day = 0
        for _ in range(n):
            day += r.choice([1, 1, 1, 2, 5, 90 if r.random() < 0.05 else 1])
            rows.append((k, D0 + timedelta(days=day), None if r.random() < 0.1 else r.randint(-5, 9), float(r.randint(1, 60))))
    return spark.createDataFrame(rows, "k int, d date, x int, p double").repartition(3)


def same(a, b):
    order = sorted(a.columns)
    assert sorted(b.columns) == order
    assert sorted(map(str, a.select(*order).collect())) == sorted(map(str, b.select(*order).collect()))


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_running(spark, days):
    df = series(spark)
    w = W.partitionBy("k").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    want = df.select("*", F.sum("x").over(w).alias("s"), F.count("x").over(w).alias("c"), F.max("p").over(w).alias("m"), F.min("x").over(w).alias("least"))
    values = {"s": ("sum", F.col("x")), "c": ("count", F.col("x")), "m": ("max", F.col("p")), "least": ("min", F.col("x"))}
    same(S.running(df, ["k"], "d", S.day_slice("d", days), values), want)
    back = W.partitionBy("k").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, 0)
    same(S.running(df, ["k"], "d", S.day_slice("d", days), {"s": ("sum", F.col("x"))}, descending=True), df.select("*", F.sum("x").over(back).alias("s")))


@pytest.mark.parametrize("days", [1, 7, 1000])
def test_previous_and_numbers(spark, days):
    df, w = series(spark), W.partitionBy("k").orderBy("d")
    same(S.previous(df, ["k"], "d", S.day_slice("d", days), {"b": F.col("x")}), df.select("*", F.lag("x").over(w).alias("b")))
    same(S.numbered(df, ["k"], "d", S.day_slice("d", days)), df.select("*", (F.row_number().over(w) - 1).cast("long").alias("rn")))


def test_sliding(spark):
    df = S.numbered(series(spark), ["k"], "d", S.day_slice("d", 30))
    w = lambda n: W.partitionBy("k").orderBy("d").rowsBetween(1 - n, 0)
    frames = {"a": ("max", "p", 7), "b": ("min", "p", 30), "c": ("max", "x", 365), "e": ("min", "x", 1)}
    aggs = {"max": F.max, "min": F.min}
    same(S.sliding(df, ["k"], "rn", frames), df.select("*", *(aggs[k](x).over(w(n)).alias(c) for c, (k, x, n) in frames.items())))


def test_sliding_takes_no_longer_for_long_frames(spark):
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("rn"), F.xxhash64("id").alias("x")).persist()
    df.count()

    def took(n):
        start = time.perf_counter()
        S.sliding(df, ["k"], "rn", {"m": ("max", "x", n)}).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took(10)
    assert took(8000) < 4 * took(80) + 2
    df.unpersist()


def test_halo_frames(spark):
    df, w = series(spark), W.partitionBy("k").orderBy("d")
    for size in (5, 40):
        same(TS.forward_sums(df, ["k"], "d", "x", {"f1": 1, "f5": 5}, size=size), df.select("*", F.sum("x").over(w.rowsBetween(1, 1)).alias("f1"), F.sum("x").over(w.rowsBetween(1, 5)).alias("f5")))
    got = TS.rolling_corr(df, ["k"], "d", "x", "p", 30, 5, size=31)
    whole = TS.rolling_corr(df, ["k"], "d", "x", "p", 30, 5, size=100_000)
    rounded = lambda f: f.withColumn("corr", F.round("corr", 9))
    same(rounded(got), rounded(whole))
    peaks = TS.rolling_drawdown(df, ["k"], "d", "p", {"m": 9})
    peak = F.max("p").over(w.rowsBetween(-8, 0))
    same(peaks, df.select("*", ((F.col("p") - peak) / peak * 100).alias("m")))


def test_metrics_over_slices(spark):
    """Slices of 40 rows, a gap of years at a border of the calendar's slices, and the metrics of one slice."""
    rows = [(1, D0 + timedelta(days=i + (2000 if i > 100 else 0)), *[100.0 + (i * 7) % 31] * 4, 5.0 + i % 9) for i in range(250)]
    bars = spark.createDataFrame(rows, "asset_id int, date date, open double, high double, low double, close double, volume_usd double")
    same(metrics(bars, assets(spark), size=40), metrics(bars, assets(spark), size=100_000))


def test_one_hot_key_is_many_tasks(spark):
    """Of 200,000 rows of one key no task gets a third, and results are those of the whole key."""
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.pmod(F.xxhash64("id"), F.lit(7)).alias("x"))
    part = F.floor(F.col("t") / 1024)
    found = S.running(df, ["k"], "t", part, {"s": ("sum", F.col("x")), "top": ("max", F.col("t"))})
    local = found.select("t", "s", "top", F.spark_partition_id().alias("pid")).persist()
    sizes = [r["count"] for r in local.groupBy("pid").count().collect()]
    assert sum(sizes) == n and len(sizes) >= 3 and max(sizes) < n / 2
    assert local.filter("top <> t").isEmpty() and local.orderBy(F.desc("t")).first().s == df.agg(F.sum("x")).first()[0]
    local.unpersist()


def test_ranks_and_tiles(spark):
    r = random.Random(4)
    rows = [(g, f"s{i:04d}", None if r.random() < 0.05 else round(r.gauss(0, 3), r.choice([0, 2]))) for g in range(3) for i in range(r.choice([1, 3, 700]))]
    df = spark.createDataFrame([*rows, (7, "a", 1.0), (7, "b", 1.0), (7, "c", None)], "g int, s string, v double")
    w = W.partitionBy("g").orderBy(F.col("v").desc_nulls_last())
    tied = W.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "s")
    long = lambda x: x.cast("long")
    want = df.select("*", long(F.rank().over(w)).alias("rank"), long(F.dense_rank().over(w)).alias("dense_rank"), long(F.row_number().over(tied)).alias("row_number"), *(long(F.ntile(k).over(tied)).alias(f"t{k}") for k in (1, 4, 9)))
    got = S.ranked(df, ["g"], "v", ["s"])
    same(got.select("*", *(S.tile(k).alias(f"t{k}") for k in (1, 4, 9))).drop("n"), want)
    assert {x.n for x in got.filter("g = 7").collect()} == {3}


def test_a_group_of_many_ranks_is_many_tasks(spark):
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.col("id").cast("string").alias("s"), F.round(F.randn(1), 3).alias("v")).persist()
    found = S.ranked(df, ["g"], "v", ["s"], width=0.1).select("rank", F.spark_partition_id().alias("pid")).persist()
    sizes = [r["count"] for r in found.groupBy("pid").count().collect()]
    assert max(sizes) < 70_000 and found.filter("rank = 1").count() == df.filter(F.col("v") == df.agg(F.max("v")).first()[0]).count()
    found.unpersist()
    df.unpersist()


def test_event_windows_by_bins(spark):
    """Rows follow bins: an event of a year's window is two rows, not 365."""
    r = random.Random(2)
    events = spark.createDataFrame([(i, D0 + timedelta(days=r.randrange(4000))) for i in range(60)], "event_id int, event_date date")
    facts = series(spark, keys=2, n=300).withColumnRenamed("d", "date")
    for lo, hi in ((-180, 184), (-2, 2), (0, 0), (5, 9)):
        got = TS.event_window(events, facts, lo, hi)
        off = F.datediff("date", "event_date")
        same(got, facts.crossJoin(events).withColumn("offset", off).filter(off.between(lo, hi)).select(*got.columns))
    assert TS._bins(events, -180, 184, "event_date").count() <= 120
    left = TS.event_window(events, facts, 0, 3, how="left")
    assert left.select("k", "date").distinct().count() == facts.count()


def test_gaps_follow_gaps(spark):
    far = spark.createDataFrame([(1, D0), (1, D0 + timedelta(days=900_000)), (2, D0), (2, D0 + timedelta(days=3))], "asset_id int, date date")
    assert L.gaps(far, start=D0 + timedelta(days=10), end=D0 + timedelta(days=12)).count() == 3
    assert sorted(x.date for x in L.gaps(far.filter("asset_id = 2")).collect()) == [D0 + timedelta(days=i) for i in (1, 2)]
