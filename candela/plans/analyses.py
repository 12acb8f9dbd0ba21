"""The named analyses. Each takes a Market and its thresholds, and returns a DataFrame ordered as its name promises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.core import classify, nulls_first, nulls_last, rounded, safe_corr
from candela.operators.blocks import pair_correlations
from candela.operators.scans import day_slice, previous, ranked, tile
from candela.operators.timeseries import affects, event_window, forward_sums, islands, pair_corr, rolling_corr, rolling_drawdown, share, with_drawdown

REGIMES = [(2.0, "LOW"), (4.0, "MEDIUM"), (6.0, "HIGH")]
YEAR = 365.0


def long(x: Column) -> Column:
    return x.cast("long")


def when(p: Column, x: str) -> Column:
    return F.when(p, F.col(x))


# ---- momentum streaks


def streaks(m) -> DataFrame:
    """Runs of days with a positive return; other days end a run. Returns are added, not compounded."""
    up = islands(m.dm.filter("daily_return_pct IS NOT NULL"), ["asset_id"], "date", ~(F.col("daily_return_pct") > 0)).filter("daily_return_pct > 0")
    return up.groupBy("asset_id", "symbol", "island").agg(
        F.count("*").alias("streak_length"), F.min("date").alias("streak_start"), F.max("date").alias("streak_end"),
        rounded(F.sum("daily_return_pct"), 2).alias("cumulative_return_pct"), rounded(F.min("daily_return_pct"), 2).alias("min_daily_return"), rounded(F.max("daily_return_pct"), 2).alias("max_daily_return"),
    )


def top_streaks(m, k: int = 20) -> DataFrame:
    found = streaks(m)
    best = [F.desc("streak_length"), F.desc("cumulative_return_pct")]
    # the k best and their ties are all the ranks that are wanted: rank after the limit, not over all streaks
    top = found.orderBy(*best, "symbol", "streak_start").limit(k)
    return top.select(
        long(F.rank().over(W.orderBy(*best))).alias("rank"), "symbol", "streak_length", "streak_start", "streak_end", "cumulative_return_pct", "min_daily_return", "max_daily_return",
    ).orderBy("rank", "symbol", "streak_start")


def top_streaks_per_asset(m, k: int = 5) -> DataFrame:
    w = W.partitionBy("symbol").orderBy(F.desc("streak_length"), F.desc("cumulative_return_pct"), "streak_start")
    ranked = streaks(m).withColumn("asset_rank", long(F.row_number().over(w))).filter(F.col("asset_rank") <= k)
    return ranked.select("symbol", "asset_rank", "streak_length", "streak_start", "streak_end", "cumulative_return_pct").orderBy("symbol", "asset_rank")


def streaks_by_month(m, least: int = 3) -> DataFrame:
    found = streaks(m).filter(F.col("streak_length") >= least).join(m.calendar.select(F.col("date_id").alias("streak_start"), "month"), "streak_start")
    return found.groupBy(long(F.col("month")).alias("month")).agg(
        F.count("*").alias("streak_count"), rounded(F.avg("streak_length"), 1).alias("avg_streak_length"), F.max("streak_length").alias("max_streak_length"),
    ).orderBy(F.desc("streak_count"), "month")


# ---- volatility regimes


def with_regime(m) -> DataFrame:
    return m.dm.filter("vol_30d IS NOT NULL").withColumn("vol_regime", classify(F.col("vol_30d"), REGIMES, "EXTREME"))


def regime_rank(name: str = "vol_regime") -> Column:
    return F.when(F.col(name) == "LOW", 1).when(F.col(name) == "MEDIUM", 2).when(F.col(name) == "HIGH", 3).otherwise(4)


def daily_regimes(m) -> DataFrame:
    return with_regime(m).select("asset_id", "symbol", "date", rounded(F.col("vol_30d"), 4).alias("vol_30d"), rounded(F.col("vol_30d") * F.sqrt(F.lit(YEAR)), 2).alias("vol_30d_annualized"), "vol_regime").orderBy("asset_id", "date")


def regime_periods(m) -> DataFrame:
    days = previous(with_regime(m), ["asset_id"], "date", day_slice("date"), {"before": F.col("vol_regime")})
    runs = islands(days, ["asset_id"], "date", ~F.col("vol_regime").eqNullSafe(F.col("before")))
    return runs.groupBy("asset_id", "symbol", "island", "vol_regime").agg(
        F.min("date").alias("regime_start"), F.max("date").alias("regime_end"), long(F.datediff(F.max("date"), F.min("date")) + 1).alias("duration_days"),
        rounded(F.avg("vol_30d"), 4).alias("avg_vol_30d"), rounded(F.avg("vol_30d") * F.sqrt(F.lit(YEAR)), 2).alias("avg_vol_annualized"),
        rounded(F.min("vol_30d"), 4).alias("min_vol_30d"), rounded(F.max("vol_30d"), 4).alias("max_vol_30d"),
    ).drop("asset_id", "island").orderBy("symbol", "regime_start")


def regime_shares(m) -> DataFrame:
    days = with_regime(m).groupBy("symbol", "vol_regime").agg(F.count("*").alias("days_in_regime"))
    return days.withColumn("pct_of_total", rounded(share(F.col("days_in_regime"), ["symbol"]) * 100, 1)).orderBy("symbol", regime_rank())


def regimes_around_events(m, symbol: str = "BTC", days: int = 7) -> DataFrame:
    near = event_window(m.market_events, with_regime(m).filter(F.col("symbol") == symbol), -days, days, few=m.few_events)
    return near.select("event_date", "title", "event_type", F.col("date").alias("observation_date"), long(F.col("offset")).alias("days_from_event"), rounded(F.col("vol_30d"), 4).alias("vol_30d"), "vol_regime", "event_id").orderBy("event_date", "observation_date", "event_id").drop("event_id")


# ---- correlation


def correlation_matrix(m) -> DataFrame:
    """Of all pairs of assets, the one with the smaller id first."""
    found = pair_correlations(m.dm, "asset_id", "date", "daily_return_pct")
    names = lambda n: m.assets.select(F.col("asset_id").alias(f"asset_id_{n}"), F.col("symbol").alias(f"asset_{n}"))
    found = found.join(names(1), "asset_id_1").join(names(2), "asset_id_2")
    return found.select("asset_1", "asset_2", F.col("n").alias("overlapping_days"), rounded(F.col("corr"), 4).alias("correlation")).orderBy(nulls_first("correlation"), "asset_1", "asset_2")


def beside_benchmark(m, symbol: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Other assets' returns beside the benchmark's of the day."""
    own = m.dm.filter(F.col("symbol") == symbol).select("date", F.col("daily_return_pct").alias("base"), *(F.col(c).alias(f"base_{c}") for c in more))
    return m.dm.filter(F.col("symbol") != symbol).join(own, "date")


def rolling_correlations(m, a: str = "BTC", others: tuple[str, ...] = ("ETH",), days: int = 30, least: int = 20) -> DataFrame:
    """symbol, date and the correlation with a's returns over the calendar days up to each day of a."""
    r = m.dm.select("symbol", "date", "daily_return_pct")
    left = r.filter((F.col("symbol") == a) & F.col("daily_return_pct").isNotNull()).select(F.explode(F.array(*map(F.lit, others))).alias("symbol"), "date", F.col("daily_return_pct").alias("x"))
    right = r.filter(F.col("symbol").isin(*others)).select("symbol", "date", F.col("daily_return_pct").alias("y"))
    found = rolling_corr(left.join(right, ["symbol", "date"], "left"), ["symbol"], "date", "x", "y", days, least)
    return found.select("symbol", "date", rounded(F.col("corr"), 8).alias("rolling_corr_30d"))


def rolling_correlation(m, a: str = "BTC", b: str = "ETH", days: int = 30, least: int = 20) -> DataFrame:
    return rolling_correlations(m, a, (b,), days, least).select("date", "rolling_corr_30d").orderBy("date")


def quarterly_correlation(m, symbol: str = "BTC", least: int = 30) -> DataFrame:
    d = beside_benchmark(m, symbol).join(m.calendar.select(F.col("date_id").alias("date"), "year", "quarter"), "date")
    found = pair_corr(d, ["year", "quarter", "symbol"], "daily_return_pct", "base", least)
    return found.select(long(F.col("year")).alias("year"), long(F.col("quarter")).alias("quarter"), F.col("symbol").alias("asset"), "days", rounded(F.col("corr"), 4).alias("corr_with_btc")).orderBy("year", "quarter", "asset")


def stress_correlation(m, symbol: str = "BTC", stress: float = 4.0, least: int = 20) -> DataFrame:
    d = beside_benchmark(m, symbol, ("vol_30d",)).filter("base_vol_30d IS NOT NULL").withColumn("market_regime", F.when(F.col("base_vol_30d") >= stress, "STRESS").otherwise("CALM"))
    found = pair_corr(d, ["market_regime", "symbol"], "daily_return_pct", "base", least)
    return found.select("market_regime", F.col("symbol").alias("asset"), "days", rounded(F.col("corr"), 4).alias("corr_with_btc")).orderBy("asset", "market_regime")


# ---- drawdowns


def drawdowns(m) -> DataFrame:
    return with_drawdown(m.dp.select("asset_id", "symbol", "date", "close"), ["asset_id"], "date", "close").withColumnRenamed("peak", "peak_close")


def drawdown_series(m) -> DataFrame:
    return drawdowns(m).orderBy("asset_id", "date").select("symbol", "date", "close", "peak_close", rounded(F.col("down"), 2).alias("drawdown_pct"))


def max_drawdowns(m) -> DataFrame:
    d = drawdowns(m).withColumn("max_drawdown_pct", rounded(F.col("down"), 2))
    first = d.groupBy("symbol").agg(F.min(F.struct("max_drawdown_pct", "date", "peak_close", "close")).alias("t"))
    return first.select("symbol", "t.max_drawdown_pct", F.col("t.peak_close").alias("peak_price"), F.col("t.close").alias("trough_price"), F.col("t.date").alias("trough_date")).orderBy("max_drawdown_pct", "symbol")


def rolling_drawdowns(m, rows: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    names = ("max_dd_30d", "max_dd_90d", "max_dd_1y")
    d = rolling_drawdown(m.dp.select("asset_id", "symbol", "date", "close"), ["asset_id"], "date", "close", dict(zip(names, rows, strict=True)))
    return d.groupBy("symbol").agg(*(rounded(F.min(c), 2).alias(c) for c in names)).orderBy("max_dd_30d", "symbol")


def underwater_periods(m, least: int = 7) -> DataFrame:
    d = islands(drawdowns(m), ["asset_id"], "date", F.col("close") >= F.col("peak_close"), "ath_group").filter("close < peak_close")
    found = d.groupBy("symbol", "ath_group").agg(F.min("date").alias("period_start"), F.max("date").alias("period_end"), rounded(F.min("down"), 2).alias("max_dd_in_period"))
    found = found.withColumn("days_underwater", long(F.datediff("period_end", "period_start"))).filter(F.col("days_underwater") >= least)
    return found.select("symbol", long(F.col("ath_group")).alias("ath_group"), "period_start", "period_end", "days_underwater", "max_dd_in_period").orderBy("symbol", "period_start")


# ---- volume anomalies


def volume_spikes(m, above: float = 2.0, days: int = 2, exact: bool = False) -> DataFrame:
    spikes = m.dm.filter(F.col("volume_ratio_30d") > above).join(m.daily_prices.select("asset_id", "date", F.col("volume_usd").cast("double").alias("volume_usd")), ["asset_id", "date"])
    hit = event_window(m.market_events, spikes, -days, days, few=m.few_events, how="left", also=affects("e.affected_assets", "f.symbol", exact))
    return hit.orderBy(nulls_first("volume_ratio_30d"), "symbol", "date", "event_id").select(
        "symbol", "date", rounded(F.col("volume_ratio_30d"), 2).alias("vol_ratio"), "volume_usd", rounded(F.col("daily_return_pct"), 2).alias("return_pct"), rounded(F.col("daily_range_pct"), 2).alias("range_pct"),
        F.col("title").alias("nearby_event"), "event_type", long(F.col("offset")).alias("days_from_event"),
    )


def spike_frequency(m) -> DataFrame:
    over = lambda x: F.count_if(F.col("volume_ratio_30d") > x)
    found = m.dm.filter("volume_ratio_30d IS NOT NULL").groupBy("symbol").agg(over(3.0).alias("extreme_spikes_3x"), over(2.0).alias("strong_spikes_2x"), over(1.5).alias("moderate_spikes_1_5x"), F.count("*").alias("total_days"))
    return found.withColumn("pct_days_above_2x", rounded(F.col("strong_spikes_2x") / F.col("total_days") * 100, 1)).orderBy(nulls_first("pct_days_above_2x"), "symbol")


def spike_directions(m, above: float = 2.0) -> DataFrame:
    r = F.col("daily_return_pct")
    kind = F.when(r > 2.0, "STRONG_BREAKOUT").when(r > 0, "MILD_BREAKOUT").when(r < -2.0, "STRONG_BREAKDOWN").when(r < 0, "MILD_BREAKDOWN").otherwise("NEUTRAL")
    found = m.dm.filter((F.col("volume_ratio_30d") > above) & r.isNotNull()).groupBy("symbol", kind.alias("spike_type"))
    return found.agg(F.count("*").alias("occurrences"), rounded(F.avg("volume_ratio_30d"), 2).alias("avg_vol_ratio"), rounded(F.avg(r), 2).alias("avg_return_pct")).orderBy("symbol", F.desc("occurrences"), "spike_type")


def spike_months(m) -> DataFrame:
    d = m.dm.filter("volume_ratio_30d IS NOT NULL").join(m.calendar.select(F.col("date_id").alias("date"), "year", "month"), "date")
    v = F.col("volume_ratio_30d")
    found = d.groupBy(long(F.col("year")).alias("year"), long(F.col("month")).alias("month")).agg(F.count_if(v > 2.0).alias("spikes_2x"), F.count_if(v > 3.0).alias("spikes_3x"), rounded(F.avg(F.when(v > 2.0, v)), 2).alias("avg_spike_ratio"))
    return found.filter("spikes_2x > 0").orderBy("year", "month")


def forward_returns(m, above: float = 2.0, ahead: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """What followed spikes. The windows run over all days with a return; spikes are picked after them."""
    d = m.dm.filter("daily_return_pct IS NOT NULL")
    d = forward_sums(d.select("asset_id", "date", "daily_return_pct", "volume_ratio_30d"), ["asset_id"], "date", "daily_return_pct", {f"f{k}": k for k in ahead}).filter(F.col("volume_ratio_30d") > above)
    side = F.when(F.col("daily_return_pct") > 0, "UP_SPIKE").otherwise("DOWN_SPIKE").alias("spike_direction")
    return d.groupBy(side).agg(F.count("*").alias("events"), *(rounded(F.avg(f"f{k}"), 2).alias(f"avg_{k}d_fwd") for k in ahead)).orderBy("spike_direction")


# ---- cross-asset ranking


def weekly(m, by: tuple[str, ...] = (), least: int = 3, iso_year: bool = False) -> DataFrame:
    """Returns added per asset and week (ISO week with the calendar year, or with the ISO year)."""
    dim = m.calendar.select(F.col("date_id").alias("date"), "month", F.col("week").alias("iso_week"), (F.extract(F.lit("YEAROFWEEK"), "date_id") if iso_year else F.col("year")).alias("year"))
    d = m.dm.filter("daily_return_pct IS NOT NULL").join(dim, "date")
    sums = d.groupBy("asset_id", "symbol", long(F.col("year")).alias("year"), long(F.col("iso_week")).alias("iso_week"), *(long(F.col(c)).alias(c) for c in by))
    return sums.agg(F.count("*").alias("days"), F.min("date").alias("week_start"), F.max("date").alias("week_end"), rounded(F.sum("daily_return_pct"), 6).alias("weekly_return")).filter(F.col("days") >= least)


def weekly_ranking(m, iso_year: bool = False) -> DataFrame:
    d = weekly(m, iso_year=iso_year).withColumn("weekly_return_pct", rounded(F.col("weekly_return"), 2))
    found = ranked(d, ["year", "iso_week"], "weekly_return_pct", ["symbol"])
    return found.select(
        "year", "iso_week", "week_start", "week_end", "symbol", "weekly_return_pct", F.col("rank").alias("rank_by_return"), F.col("dense_rank").alias("dense_rank_by_return"),
        tile(4).alias("performance_quartile"), F.col("row_number").alias("row_num"),
    ).orderBy("year", "iso_week", "rank_by_return", "symbol")


def quartile_distribution(m) -> DataFrame:
    q = ranked(weekly(m), ["year", "iso_week"], "weekly_return", ["symbol"]).withColumn("q", tile(4))
    n = {i: F.count_if(F.col("q") == i) for i in (1, 2, 3, 4)}
    found = q.groupBy("symbol").agg(*(n[i].alias(f"weeks_in_q{i}") for i in n), F.count("*").alias("total_weeks"))
    for name, i in (("pct_top_quartile", 1), ("pct_bottom_quartile", 4)):
        found = found.withColumn(name, rounded(F.col(f"weeks_in_q{i}") / F.col("total_weeks") * 100, 1))
    return found.orderBy(F.desc("pct_top_quartile"), "symbol")


def rank_summary(m) -> DataFrame:
    d = ranked(weekly(m), ["year", "iso_week"], "weekly_return").withColumnRenamed("rank", "r")
    found = d.rollup("symbol", "year").agg(
        F.grouping("symbol").alias("g1"), F.grouping("year").alias("g2"), F.count("*").alias("weeks"), rounded(F.avg("r"), 2).alias("avg_rank"),
        rounded(F.avg("weekly_return"), 2).alias("avg_weekly_return"), long(F.min("r")).alias("best_rank"), long(F.max("r")).alias("worst_rank"),
    )
    names = found.withColumns({"symbol": F.when(F.col("g1") == 1, "ALL ASSETS").otherwise(F.col("symbol")), "year": F.when(F.col("g2") == 1, "ALL YEARS").otherwise(F.col("year").cast("string"))})
    return names.drop("g1", "g2").orderBy(nulls_last("symbol"), nulls_last("year"))


def btc_regime(m, symbol: str = "BTC", among_all: bool = False) -> DataFrame:
    """Months by a symbol's weekly rank. By default it is ranked alone, as the source query does; among_all ranks all assets."""
    d = weekly(m, ("month",))
    d = d if among_all else d.filter(F.col("symbol") == symbol)
    d = ranked(d, ["year", "iso_week", *(["month"] if among_all else [])], "weekly_return").withColumnRenamed("rank", "r").filter(F.col("symbol") == symbol)
    n = F.count("*")
    regime = F.when(F.count_if(F.col("r") <= 2) / n > 0.5, "BTC_DOMINANCE").when(F.count_if(F.col("r") >= 5) / n > 0.5, "ALT_SEASON").otherwise("MIXED")
    return d.groupBy("year", "month").agg(n.alias("total_weeks"), F.count_if(F.col("r") == 1).alias("btc_rank_1_weeks"), F.count_if(F.col("r") <= 3).alias("btc_top_3_weeks"), F.count_if(F.col("r") >= 5).alias("btc_bottom_half_weeks"), regime.alias("regime")).orderBy("year", "month")


# ---- events

MEASURES = {"return": "daily_return_pct", "vol": "vol_30d", "volratio": "volume_ratio_30d"}


def inside(lo: int, hi: int) -> Column:
    return F.col("offset").between(lo, hi)


def event_study(m, days: int = 30, exact: bool = False) -> DataFrame:
    d = event_window(m.market_events, m.dm, -days, days, few=m.few_events).filter(affects(exact=exact))
    day = {"event_day_return": ("daily_return_pct", 2), "event_day_vol": ("vol_30d", 4), "event_day_volratio": ("volume_ratio_30d", 2)}
    means = lambda side, lo, hi: [rounded(F.avg(when(inside(lo, hi), c)), 4).alias(f"avg_{k}_{side}_{days}d") for k, c in MEASURES.items()]
    found = d.groupBy("event_id", "event_date", "event_type", "title", "symbol").agg(*means("pre", -days, -1), *(rounded(F.max(when(inside(0, 0), c)), n).alias(k) for k, (c, n) in day.items()), *means("post", 1, days))
    return found.orderBy("event_date", "symbol", "event_id")


def crash_damage(m, kind: str = "crash") -> DataFrame:
    d = event_window(m.market_events.filter(F.col("event_type") == kind), m.dm, 0, 30, few=m.few_events)
    r = "daily_return_pct"
    found = d.groupBy("event_id", "event_date", F.col("title").alias("event_title"), "symbol").agg(
        *(rounded(F.sum(when(inside(0, n), r)), 2).alias(f"cum_return_{n}d") for n in (7, 14, 30)), rounded(F.min(when(inside(0, 7), r)), 2).alias("worst_day_7d"), rounded(F.max(when(inside(0, 2), "volume_ratio_30d")), 2).alias("peak_vol_ratio_3d"),
    )
    return found.orderBy("event_date", nulls_last("cum_return_7d"), "symbol").drop("event_id")


def halving(m, symbol: str = "BTC") -> DataFrame:
    first = m.market_events.filter(F.col("event_type") == "halving").orderBy("event_date", "event_id").limit(1)
    d = event_window(first, m.dm.filter(F.col("symbol") == symbol), -90, 180, few=m.few_events)
    period = F.when(inside(-90, -1), "90d_before").when(inside(1, 90), "90d_after").when(inside(91, 180), "180d_after")
    found = d.withColumn("period", period).filter("period IS NOT NULL").groupBy("period").agg(
        F.count("*").alias("trading_days"), rounded(F.sum("daily_return_pct"), 2).alias("cum_return"), rounded(F.avg("daily_return_pct"), 4).alias("avg_daily_return"),
        rounded(F.avg("vol_30d"), 4).alias("avg_vol_30d"), rounded(F.avg("volume_ratio_30d"), 2).alias("avg_vol_ratio"), F.min("offset").alias("first"),
    )
    return found.orderBy("first").drop("first")


def upgrades(m, symbol: str = "ETH", kind: str = "protocol_upgrade", days: int = 30) -> DataFrame:
    d = event_window(m.market_events.filter(F.col("event_type") == kind), m.dm.filter(F.col("symbol") == symbol), -days, days, few=m.few_events)
    means = lambda side, lo, hi: [rounded(F.avg(when(inside(lo, hi), c)), 2 if k == "volratio" else 4).alias(f"avg_{k}_{side}") for k, c in MEASURES.items()]
    found = d.groupBy("event_id", F.col("title").alias("upgrade"), "event_date").agg(*means("before", -days, -1), *means("after", 1, days), rounded(F.max(when(inside(0, 0), "daily_return_pct")), 2).alias("event_day_return"))
    return found.orderBy("event_date").drop("event_id")


def impact_by_type(m, days: int = 14) -> DataFrame:
    """The column's name says event day, but as in the source query it averages all days of the window."""
    d = event_window(m.market_events, m.dm, -days, days, few=m.few_events).filter(affects())
    change = F.avg(when(F.col("offset") > 0, "vol_30d")) - F.avg(when(F.col("offset") < 0, "vol_30d"))
    found = d.groupBy("event_type").agg(F.count_distinct("event_id").alias("num_events"), rounded(F.avg("daily_return_pct"), 2).alias("avg_event_day_return"), rounded(F.avg(when(inside(0, 2), "volume_ratio_30d")), 2).alias("avg_vol_ratio_3d"), rounded(change, 4).alias("vol_change_post_minus_pre"))
    return found.orderBy(nulls_last("avg_event_day_return"), "event_type")


def crash_correlation(m, symbol: str = "BTC", kind: str = "crash", days: int = 30) -> DataFrame:
    d = event_window(m.market_events.filter(F.col("event_type") == kind), beside_benchmark(m, symbol), -days, days, few=m.few_events)
    corr = lambda p: safe_corr(F.when(p, F.col("base")), F.when(p, F.col("daily_return_pct")))
    found = d.groupBy("event_id", "event_date", "title", F.col("symbol").alias("alt_symbol")).agg(corr(F.col("offset") < 0).alias("a"), corr(F.col("offset") >= 0).alias("b"))
    found = found.select("event_date", "title", "alt_symbol", rounded(F.col("a"), 3).alias("corr_before_crash"), rounded(F.col("b"), 3).alias("corr_during_crash"), rounded(F.col("b") - F.col("a"), 3).alias("corr_change"))
    return found.orderBy("event_date", nulls_first("corr_change"), "alt_symbol")


ANALYSES = {
    "q1a": top_streaks, "q1b": top_streaks_per_asset, "q1c": streaks_by_month,
    "q2a": daily_regimes, "q2b": regime_periods, "q2c": regime_shares, "q2d": regimes_around_events,
    "q3a": correlation_matrix, "q3b": rolling_correlation, "q3c": quarterly_correlation, "q3d": stress_correlation,
    "q4a": drawdown_series, "q4b": max_drawdowns, "q4c": rolling_drawdowns, "q4d": underwater_periods,
    "q5a": volume_spikes, "q5b": spike_frequency, "q5c": spike_directions, "q5d": spike_months, "q5e": forward_returns,
    "q6a": weekly_ranking, "q6b": quartile_distribution, "q6c": rank_summary, "q6d_btc_regime": btc_regime,
    "q6d_btc_regime_ranked": lambda m: btc_regime(m, among_all=True),
    "q7a": event_study, "q7b": crash_damage, "q7c": halving, "q7d": upgrades, "q7e": impact_by_type, "q7f": crash_correlation,
}
