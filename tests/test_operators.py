"""Operators on small frames with gaps, nulls, ties and constant series; checks on corrupted tables."""

import random
import uuid
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from candela.functions.core import classify, rounded, safe_corr, small
from candela.operators import constraints as C
from candela.operators import loading as L
from candela.operators import timeseries as TS
from candela.plans.metrics import WATERFALL, metrics
from candela.plans.quality import CHECKS
from candela.sinks import tables as S
from candela.sources import market as M
from candela.sources.market import EVENT_TYPES, Market, assets, forget, market, market_events

D0 = date(1996, 1, 1)
BARS = "asset_id int, date date, open decimal(20,8), high decimal(20,8), low decimal(20,8), close decimal(20,8), volume_usd decimal(30,2), market_cap_usd decimal(30,2)"


def bars(spark, closes, asset=1, skip=(), volume=100.0, high=None, low=None):
    out = []
    for i, c in enumerate(closes):
        if i not in skip:
            d = Decimal(str(c))
            out.append((asset, D0 + timedelta(days=i), d, Decimal(str(high)) if high else d, Decimal(str(low)) if low is not None else d, d, None if volume is None else Decimal(str(volume)), None))
    return spark.createDataFrame(out, BARS)


@pytest.mark.parametrize(("n", "full"), [(1, []), (7, ["sma_7"]), (8, ["sma_7", "vol_7d"]), (30, ["sma_7", "sma_30", "vol_7d"]), (31, ["sma_7", "sma_30", "vol_7d", "vol_30d", "volume_ratio_30d"])])
def test_windows_are_full_or_null(spark, n, full):
    last = metrics(bars(spark, [100 + i for i in range(n)]), assets(spark)).orderBy(F.desc("date")).first()
    assert [c for c in ("sma_7", "sma_30", "vol_7d", "vol_30d", "volume_ratio_30d") if last[c] is not None] == full


def test_metrics_count_rows_over_gaps_and_keep_nulls(spark):
    df = metrics(bars(spark, [100 + i for i in range(45)], skip=(5, 6, 20)), assets(spark))
    assert df.filter("sma_7 IS NOT NULL").count() == 42 - 6
    assert metrics(bars(spark, range(1, 50), volume=None), assets(spark)).filter("volume_ratio_30d IS NOT NULL").count() == 0
    zero = metrics(bars(spark, range(1, 50), volume=0), assets(spark))
    assert zero.filter("volume_ratio_30d IS NOT NULL").count() == 0
    assert metrics(bars(spark, range(1, 9), low=0), assets(spark)).filter("daily_range_pct IS NOT NULL").count() == 0
    flat = metrics(bars(spark, [5] * 40), assets(spark)).orderBy(F.desc("date")).first()
    assert flat.daily_return_pct == 0 and flat.vol_30d == 0 and flat.volume_ratio_30d == 1


def test_inactive_assets_get_no_metrics(spark):
    idle = assets(spark).withColumn("is_active", F.col("asset_id") != 1)
    assert metrics(bars(spark, range(1, 40)), idle).count() == 0


def test_islands_drawdown_forward_sum(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1.0, 2.0, -1.0, 3.0, 4.0, 0.0])], "k string, i int, x double")
    runs = TS.islands(df, ["k"], "i", ~(F.col("x") > 0)).filter("x > 0").groupBy("island").count()
    assert sorted(r["count"] for r in runs.collect()) == [2, 2]
    peak, down = TS.drawdown(df, ["k"], "i", "x")
    got = df.select("i", peak.alias("p"), down.alias("d")).orderBy("i").collect()
    assert [r.p for r in got] == [1, 2, 2, 3, 4, 4] and all(r.d <= 0 for r in got)
    assert [r.f for r in df.select("i", TS.forward_sum(["k"], "i", "x", 2).alias("f")).orderBy("i").collect()] == [1.0, 2.0, 7.0, 4.0, 0.0, None]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "x double, y double")
    assert df.agg(safe_corr(F.col("x"), F.col("y")).alias("c")).first().c is None
    assert df.limit(1).agg(safe_corr(F.col("x"), F.col("y")).alias("c")).first().c is None
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "x double, y double")
    assert abs(line.agg(safe_corr(F.col("x"), F.col("y")).alias("c")).first().c - 1) < 1e-12


def test_rolling_correlation_is_by_calendar(spark):
    days = [D0 + timedelta(days=i) for i in (0, 1, 2, 40, 41)]
    df = spark.createDataFrame([(d, float(i), float(i * i)) for i, d in enumerate(days)], "d date, x double, y double")
    assert {r.d: r.pairs for r in TS.rolling_corr(df.withColumn("k", F.lit("a")), ["k"], "d", "x", "y", 30, 1).collect()}[days[3]] == 1


def test_event_window_and_matching(spark):
    events = spark.createDataFrame([(1, D0, "ALL"), (2, D0, "ETHX")], "event_id int, event_date date, affected_assets string")
    facts = spark.createDataFrame([("ETH", D0 + timedelta(days=i)) for i in range(-3, 4)], "symbol string, date date")
    near = TS.event_window(events, facts, -2, 2)
    assert near.count() == 10 and near.filter(TS.affects()).count() == 10 and near.filter(TS.affects(exact=True)).count() == 5


def test_rounding_and_classes(spark):
    got = spark.range(1).select(rounded(F.lit(0.125), 2).alias("a"), rounded(F.lit(-0.125), 2).alias("b"), rounded(F.lit(-0.001), 2).cast("string").alias("c"), classify(F.lit(2.0), [(2.0, "LOW"), (4.0, "MEDIUM")], "X").alias("d")).first()
    assert (got.a, got.b, got.c, got.d) == (0.13, -0.13, "0.0", "MEDIUM")


def test_cleaning_and_quarantine(spark):
    texts = ["1.5", "nan", "NaN", "inf", "-inf", "None", None, "x", "", " 2 ", "-3", "1e400"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", L.to_decimal(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[0] == Decimal("1.5") and got[9] == 2 and got[10] == -3 and [got[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 11)] == [None] * 9
    good, bad = L.quarantine(spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (None,)], "close double"))
    assert (good.count(), bad.count()) == (1, 3)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    once = L.upsert(old, new, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, L.upsert(once, new, ["k"], "seq").collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, L.insert_absent(old, new.drop("seq"), ["k"]).filter("k < 3").collect())) == [(1, "a"), (2, "b")]


def test_calendar(spark):
    span = spark.createDataFrame([(date(2021, 12, 30), date(2022, 1, 4))], "start date, end date")
    got = {r.date_id: r for r in L.calendar(span).collect()}
    sunday = got[date(2022, 1, 2)]
    assert (sunday.year, sunday.week, sunday.day_of_week, sunday.is_weekend) == (2022, 52, 6, True) and len(got) == 6


def test_gaps_and_constraints(spark):
    b = bars(spark, range(1, 11), skip=(3, 4))
    assert L.gaps(b).count() == 2
    assert C.duplicates(b.union(b.limit(1)), ["asset_id", "date"]).count() == 1
    assert C.failing(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), F.col("x") >= 0).count() == 1
    assert C.too_long(spark.createDataFrame([("abc",), ("abcd",)], "s string"), {"s": 3}).count() == 1
    assert C.orphans(spark.createDataFrame([(1,), (9,), (None,)], "asset_id int"), assets(spark), {"asset_id": "asset_id"}).count() == 1
    assert C.with_defaults(spark.createDataFrame([(None,)], "x int"), x=F.lit(7)).first().x == 7


def corrupted(spark, change, more=None):
    m = Market(assets(spark), market_events(spark), bars(spark, [100 + i % 7 + i * 0.1 for i in range(60)]))
    good = m.daily_metrics
    bad = good.withColumns({c: F.when(F.dayofmonth("date") == 20, F.lit(v)).otherwise(F.col(c)).cast(good.schema[c].dataType) for c, v in change.items()})
    m.__dict__["daily_metrics"] = more(bad) if more else bad
    return m


FAULTS = {
    "c1_3": dict(change={}, more=lambda d: d.filter(F.dayofmonth("date") != 9)),
    "c1_4": dict(change={}, more=lambda d: d.union(d.limit(1).withColumn("date", F.lit(date(2030, 1, 1))))),
    "c2_2": dict(change={"vol_7d": None}), "c2_3": dict(change={"sma_7": None}),
    "c3_1": dict(change={"daily_return_pct": 501.0}), "c3_2": dict(change={"daily_range_pct": -1.0}), "c3_3": dict(change={"vol_7d": -1.0}),
    "c3_4": dict(change={"sma_7": 0.0}), "c3_5": dict(change={"volume_ratio_30d": -1.0}), "c4_5": dict(change={"sma_7": 1.0}),
    "c5_5": dict(change={"daily_return_pct": 0.0}), "c5_6": dict(change={"daily_return_pct": 99.0}),
}


@pytest.mark.parametrize("name", sorted(FAULTS))
def test_checks_fire_on_faults_only(spark, name):
    assert CHECKS[name].kind == "zero"
    assert CHECKS[name].build(corrupted(spark, **FAULTS[name])).count() > 0
    if name != "c2_2":  # one asset of 60 days follows the waterfall as well
        assert CHECKS[name].build(corrupted(spark, {})).count() == 0


def test_null_report(spark):
    m = corrupted(spark, {})
    assert L.null_report(m.daily_metrics, WATERFALL).first().status == "PASS"


def test_gaps_in_a_range(spark):
    b = bars(spark, range(1, 21), skip=(3, 4, 10))
    day = lambda i: D0 + timedelta(days=i)
    assert {r.date for r in L.gaps(b, start=day(4), end=day(9)).collect()} == {day(4)}
    assert L.gaps(b, start=day(-5), end=day(50)).count() == 3 and L.gaps(b, start=day(30)).count() == 0


def test_rolling_correlation_of_many_pairs(spark):
    rows = [(k, D0 + timedelta(days=i), float(i % 5), float((i % 5) * s)) for k, s in (("a", 1), ("b", -1)) for i in range(30)]
    got = TS.rolling_corr(spark.createDataFrame(rows, "k string, d date, x double, y double"), ["k"], "d", "x", "y", 10, 10).collect()
    assert len(got) == 42 and all(abs(r["corr"] - (1 if r.k == "a" else -1)) < 1e-9 for r in got)


def test_large_tables_are_not_broadcast(spark):
    events = spark.range(20).select(F.col("id").alias("event_id"), F.lit(D0).alias("event_date"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small(events)) + plan(events.join(small(events), "event_id"))
    assert "strategy=broadcast" not in plan(events.join(small(events, 19), "event_id"))


def test_constraints_of_columns(spark):
    df = spark.createDataFrame([("crash", 1.0), ("rally", 1e9), (None, None)], "kind string, x double")
    assert [r.kind for r in C.outside(df, "kind", EVENT_TYPES).collect()] == ["rally"]
    assert [r.kind for r in C.unfit(df, {"x": "decimal(10,6)"}).collect()] == ["rally"]
    assert C.with_defaults(df, x=F.lit(2.0), y=F.lit(3)).filter("kind IS NULL AND x = 2 AND y = 3").count() == 1


def test_tables_are_swapped_whole(spark, tmp_path):
    schema, folder = f"t_{uuid.uuid4().hex}", str(tmp_path)
    S.create(spark, folder, schema)
    S.create(spark, folder, schema)
    assert all(spark.table(f"{schema}.{t}").count() == 0 for t in S.TABLES)
    first = S.save(bars(spark, range(1, 41)), "daily_prices", folder, schema)
    assert first.count() == 40 and first.select("price_id").distinct().count() == 40 and first.columns[0] == "price_id"
    # computed from itself, and one row fails: the old rows stay
    S.save(spark.table(f"{schema}.daily_prices").filter("close > 10"), "daily_prices", folder, schema)
    assert spark.table(f"{schema}.daily_prices").count() == 30
    with pytest.raises(Exception, match="stop"):
        S.save(bars(spark, range(1, 5)).withColumn("close", F.raise_error(F.lit("stop"))), "daily_prices", folder, schema)
    assert spark.table(f"{schema}.daily_prices").count() == 30
    assert S.drop_old(spark, "daily_prices", schema) >= 2 and spark.table(f"{schema}.daily_prices").count() == 30
    plan = spark.table(f"{schema}.daily_prices").groupBy("asset_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # rows of an asset lie in one bucket


def test_market_is_built_anew_when_its_file_changes(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    path = str(tmp_path / "lineitem.parquet")
    src.write.parquet(path)
    one = market(spark, str(tmp_path))
    assert market(spark, str(tmp_path)) is one and one.daily_prices.count() > 0
    src.limit(10).write.mode("overwrite").parquet(path)
    spark._jvm.java.lang.Thread.sleep(5)
    two = market(spark, str(tmp_path))
    assert two is not one and two.daily_prices.count() <= 10
    forget(spark, str(tmp_path))
    assert "daily_prices" not in two.__dict__


def loaded(spark, tmp_path):
    """A database with assets, a calendar of 1996 and forty bars."""
    schema, folder = f"t_{uuid.uuid4().hex}", str(tmp_path)
    S.create(spark, folder, schema)
    S.load(assets(spark), "assets", folder, schema)
    S.load(L.calendar(spark.createDataFrame([(D0, date(1996, 12, 31))], "start date, end date")), "date_dim", folder, schema)
    S.load(market_events(spark), "market_events", folder, schema)
    S.load(bars(spark, range(1, 41)), "daily_prices", folder, schema)
    return schema, folder


def test_loads_are_refused_or_diverted(spark, tmp_path):
    schema, folder = loaded(spark, tmp_path)
    good = bars(spark, range(1, 41))
    faults = {
        "not null (close)": good.withColumn("close", F.lit(None)),
        "not null (date)": good.withColumn("date", F.lit(None)),
        "check (close)": good.withColumn("close", F.lit(0)),
        "check (volume)": good.withColumn("volume_usd", F.lit(-1)),
        "domain (open)": good.withColumn("open", F.lit(1e15)),
        "key (asset_id, date)": good.union(good.limit(1)),
        "reference (asset_id)": good.withColumn("asset_id", F.lit(99)),
        "reference (date)": good.withColumn("date", F.date_add("date", 4000)),
    }
    before = spark.table(f"{schema}.daily_prices").collect()
    for name, rows in faults.items():
        with pytest.raises(S.Refused) as e:
            S.load(rows, "daily_prices", folder, schema)
        assert list(e.value.counts) == [name], (name, e.value.counts)
    events = market_events(spark)
    others = {
        ("market_events", "enumeration (event_type)"): events.withColumn("event_type", F.lit("rally")), ("market_events", "length (title)"): events.withColumn("title", F.repeat(F.lit("x"), 201)),
        ("assets", "key (symbol)"): assets(spark).withColumn("symbol", F.lit("BTC")), ("date_dim", "check (month)"): spark.table(f"{schema}.date_dim").withColumn("month", F.lit(13)),
    }
    for (table, name), rows in others.items():
        with pytest.raises(S.Refused, match="left as it was") as e:
            S.load(rows, table, folder, schema)
        assert list(e.value.counts) == [name]
    assert spark.table(f"{schema}.daily_prices").collect() == before
    # one row of each fault among good ones: they are diverted with all that they violate, the rest is loaded and numbered
    mixed = good.filter("close > 2").union(faults["check (close)"].limit(1).withColumn("volume_usd", F.lit(-1).cast("decimal(30,2)")))
    S.load(mixed, "daily_prices", folder, schema, rejected=f"{folder}/bad")
    assert sorted(r.price_id for r in spark.table(f"{schema}.daily_prices").collect()) == list(range(1, 39))
    assert [sorted(r.violations) for r in spark.read.parquet(f"{folder}/bad").collect()] == [["check (close)", "check (volume)"]]
    S.drop(spark, schema)


def test_a_writer_that_comes_late_is_refused(spark, tmp_path):
    schema, folder = loaded(spark, tmp_path)
    seen = S.shown(spark, "daily_prices", schema)
    S.load(bars(spark, range(1, 11)), "daily_prices", folder, schema)
    with pytest.raises(S.Conflict):
        S.load(bars(spark, range(1, 31)), "daily_prices", folder, schema, seen=seen)
    assert spark.table(f"{schema}.daily_prices").count() == 10
    with S._locked(spark, f"{folder}/daily_prices.lock"), pytest.raises(S.Conflict):
        S.load(bars(spark, range(1, 31)), "daily_prices", folder, schema)
    S.load(bars(spark, range(1, 31)), "daily_prices", folder, schema)
    assert spark.table(f"{schema}.daily_prices").count() == 30
    S.drop(spark, schema)


def test_dense_ids(spark):
    df = spark.createDataFrame([(f"{'abc'[i % 3]}{i % 10}", i) for i in range(300)], "s string, i int").repartition(4)
    got = L.reload(df, ["s", "i"], "id").orderBy("id").collect()
    assert [r.id for r in got] == list(range(1, 301)) and [(r.s, r.i) for r in got] == sorted((r.s, r.i) for r in got)
    assert "SinglePartition" not in L.reload(df, ["i"], "id")._jdf.queryExecution().executedPlan().toString().split("HashAggregate")[0]


def test_bars_sort_only_the_rows_of_first_and_last_orders(spark):
    """Bars equal those of one aggregation by the full key, with ties and nulls; no task sorts all its rows."""
    r = random.Random(6)
    some = lambda *x: r.choice(x)
    t = [(some(None, 1, 2, 2, 3, 7), some(None, 1, 2), some(None, 3, 4, 12), some(5, 6), some(None, 10.5, 20.25), some(1.0, 2.0), some(None, date(1995, 1, 2), date(1996, 5, 6))) for _ in range(600)]
    lines = spark.createDataFrame(t, "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_extendedprice double, l_quantity double, l_shipdate date")
    got = M.daily_prices(lines)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Join" in plan and "SortAggregate" not in plan.split("Join", 1)[1]
    asset, key = F.pmod("l_suppkey", F.lit(8)) + 1, F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity")
    volume = (F.col("l_quantity") * F.col("l_extendedprice")).cast("decimal(30,2)")
    want = lines.groupBy(asset.cast("int").alias("asset_id"), F.col("l_shipdate").alias("date")).agg(F.max_by(volume, key).alias("volume_usd"), F.max_by("l_extendedprice", key).isNull().alias("none"))
    found = got.select("asset_id", "date", "volume_usd", F.col("close").isNull().alias("none"))
    # without an asset there is no price
    want = want.withColumn("none", F.col("none") | F.col("asset_id").isNull() | F.col("date").isNull())
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 9
