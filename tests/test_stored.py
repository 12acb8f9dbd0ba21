"""Tables on disk: plans over their layout, upserts by month, metrics of changed tails, and correlation by blocks."""

import random
import uuid
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from candela.operators import blocks as B
from candela.operators import loading as L
from candela.operators import timeseries as TS
from candela.plans import quality as Q
from candela.plans.metrics import metrics, refreshed
from candela.sinks import months as M
from candela.sinks import tables as S
from candela.sources.market import LAYOUT, assets, market_events, stored

D0 = date(1996, 1, 1)
BARS = "asset_id int, date date, open double, high double, low double, close double, volume_usd double"


def bars(spark, days, n_assets=3, seed=1):
    r = random.Random(seed)
    rows = [(a, D0 + timedelta(days=i), *[float(r.randint(50, 150))] * 4, float(r.randint(1, 9))) for a in range(1, n_assets + 1) for i in range(days) if r.random() > 0.1]
    return spark.createDataFrame(rows, BARS)


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    schema, folder = f"t_{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("tables"))
    S.create(spark, folder, schema)
    S.load(assets(spark), "assets", folder, schema)
    S.load(L.calendar(spark.createDataFrame([(D0, date(1999, 12, 31))], "start date, end date")), "date_dim", folder, schema)
    S.load(market_events(spark), "market_events", folder, schema)
    S.load(bars(spark, 500), "daily_prices", folder, schema)
    S.load(metrics(spark.table(f"{schema}.daily_prices"), spark.table(f"{schema}.assets")), "daily_metrics", folder, schema)
    yield schema
    S.drop(spark, schema)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """Shuffles by a key; those that sort a result for its reader are left out."""
    return [x for x in executed(df).split("\n") if "Exchange hashpartitioning" in x or "Exchange SinglePartition" in x]


def test_plans_over_buckets_have_no_shuffle(spark, database):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", **LAYOUT}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        m = stored(spark, database)
        missing = m.daily_prices.join(m.daily_metrics.select("asset_id", "date"), ["asset_id", "date"], "left_anti")
        assert exchanges(missing) == [] and missing.count() == 0
        assert not any("date" in x and "asset_id" in x for x in exchanges(Q.unmatched(m, "daily_prices", "daily_metrics")))
        found = metrics(m.daily_prices, m.assets)
        assert exchanges(found) == [] and found.count() == m.daily_metrics.count()
        bounds = exchanges(Q.averages_out_of_bounds(m))
        assert not any("hashpartitioning(asset_id" in x and "_rn" in x for x in bounds), bounds
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_days_are_pruned(spark, database):
    m = stored(spark, database)
    plan = executed(m.daily_prices.filter((F.col("date") >= F.lit(date(1997, 3, 1))) & (F.col("asset_id") == 2)).select("close"))
    assert "GreaterThanOrEqual(date,1997-03-01)" in plan and "EqualTo(asset_id,2)" in plan


def test_stored_market_gives_the_same_checks(spark, database):
    m = stored(spark, database)
    assert Q.averages_out_of_bounds(m).count() == 0 and Q.unmatched(m, "daily_metrics", "daily_prices").count() == 0


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_upserts_rewrite_only_their_months(spark, tmp_path):
    path = f"{tmp_path}/bars"
    df = bars(spark, 200).select("asset_id", "date", "close")
    M.store(df, path)
    before = files(path)
    some = df.filter(F.col("date").between("1996-02-20", "1996-03-02"))
    new = some.select("asset_id", "date", F.lit(1.0).alias("close"), F.lit(1).alias("seq")).union(some.select("asset_id", "date", F.lit(2.0), F.lit(2)))
    assert M.upsert_into(path, new, ["asset_id", "date"], "seq") == ["1996-02", "1996-03"]
    after = files(path)
    same = {p for p in before if "month=1996-02" not in p and "month=1996-03" not in p}
    assert all(after[p] == before[p] for p in same) and not (before.keys() - same) & after.keys() and len(same) >= 4
    want = L.upsert(df, new, ["asset_id", "date"], "seq")
    assert sorted(map(tuple, M.read(spark, path).collect())) == sorted(map(tuple, want.collect()))
    again = df.filter("asset_id = 1").withColumn("close", F.lit(9.0)).union(spark.createDataFrame([(7, date(1996, 5, 5), 3.0)], df.schema))
    M.upsert_into(path, again.filter("month(date) >= 5"), ["asset_id", "date"])
    assert sorted(map(tuple, M.read(spark, path).collect())) == sorted(map(tuple, want.union(again.filter("asset_id = 7")).collect()))
    assert M.upsert_into(path, again.limit(0), ["asset_id", "date"]) == []


def test_metrics_of_changed_tails(spark):
    """Random rows added, replaced and removed, and a new asset: as if all were computed anew."""
    old = bars(spark, 220)
    known, a = metrics(old, assets(spark)).persist(), assets(spark)
    for seed in range(3):
        r = random.Random(seed)
        rows = {(x.asset_id, x.date): x for x in old.collect()}
        hit = []
        for _ in range(r.choice([1, 4])):
            asset, day = r.choice([1, 2, 3]), D0 + timedelta(days=r.choice([0, r.randrange(220), 219, 225]))
            hit.append((asset, day))
            if r.random() < 0.3:
                rows.pop((asset, day), None)
            else:
                rows[asset, day] = (asset, day, *[float(r.randint(50, 150))] * 4, 5.0)
        if seed == 2:
            rows |= {(4, D0 + timedelta(days=i)): (4, D0 + timedelta(days=i), *[100.0 + i] * 4, 5.0) for i in range(40)}
            hit += [(4, D0 + timedelta(days=i)) for i in range(40)]
        prices, days = spark.createDataFrame([tuple(x) for x in rows.values()], BARS), spark.createDataFrame(hit, "asset_id int, date date")
        got = refreshed(prices, a, known, days, size=50)
        assert sorted(map(str, got.collect())) == sorted(map(str, metrics(prices, a).select(*got.columns).collect()))
    known.unpersist()


def test_correlation_by_blocks(spark):
    r = random.Random(3)
    rows = [(f"k{k:03d}", D0 + timedelta(days=i), 5.0 if k == 7 else None if r.random() < 0.1 else r.gauss(k, 2)) for k in range(60) for i in range(80) if r.random() > 0.1]
    df = spark.createDataFrame(rows, "k string, d date, x double").persist()
    got = {(x.k_1, x.k_2): (x.n, x.corr and round(x.corr, 9)) for x in B.pair_correlations(df, "k", "d", "x", size=16, days=30).collect()}
    want = TS.pair_corr(TS.pairs(df, ["d"], "k", ["k", "x"]), ["k1", "k2"], "x1", "x2")
    assert got == {(x.k1, x.k2): (x.days, x["corr"] and round(x["corr"], 9)) for x in want.collect()}
    assert got["k007", "k008"][1] is None and len(got) == 60 * 59 // 2
    df.unpersist()


def test_a_thousand_keys_by_blocks(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.explode(F.sequence(F.lit(D0), F.lit(D0 + timedelta(days=39)))).alias("d")).withColumn("x", F.pmod(F.xxhash64("k", "d"), F.lit(1000)) / 1000.0)
    assert B.pair_correlations(df, "k", "d", "x").count() == 1000 * 999 // 2
