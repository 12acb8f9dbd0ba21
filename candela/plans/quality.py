"""The integrity checks. A check of kind `zero` passes with no rows; the others are read against expectations."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candela.functions.core import nulls_last, ratio, rounded
from candela.operators.loading import null_report
from candela.operators.scans import day_slice, numbered, previous, sliding
from candela.plans.metrics import WATERFALL
from candela.sources.market import shifted

KEYS = ("asset_id", "symbol", "date")


def on(reference: str) -> Column:
    return F.lit(shifted(reference))


def named(m, df: DataFrame) -> DataFrame:
    return df.join(m.symbols, "asset_id")


def row_totals(m) -> DataFrame:
    tables = {"daily_prices": m.daily_prices, "daily_metrics": m.daily_metrics}
    a, b = (t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, t in tables.items())
    return a.unionByName(b)


def rows_per_asset(m) -> DataFrame:
    a, b = (named(m, t).groupBy("asset_id", "symbol").agg(F.count("*").alias(n)) for t, n in ((m.daily_prices, "price_rows"), (m.daily_metrics, "metric_rows")))
    return a.join(b, ["asset_id", "symbol"]).withColumn("row_difference", F.col("price_rows") - F.col("metric_rows")).orderBy("symbol")


def unmatched(m, left: str, right: str) -> DataFrame:
    return named(m, getattr(m, left).join(getattr(m, right).select("asset_id", "date"), ["asset_id", "date"], "left_anti")).select(*KEYS).orderBy("asset_id", "date")


def null_counts(m) -> DataFrame:
    return named(m, null_report(m.daily_metrics, WATERFALL)).drop("status").orderBy("symbol")


def off_waterfall(m) -> DataFrame:
    short = {"null_daily_return_pct": "null_return", "null_daily_range_pct": "null_range", "null_vol_7d": "null_vol7", "null_vol_30d": "null_vol30", "null_sma_7": "null_sma7", "null_sma_30": "null_sma30", "null_volume_ratio_30d": "null_volratio"}
    return named(m, null_report(m.daily_metrics, WATERFALL)).filter("status <> 'PASS'").drop("status").withColumnsRenamed(short).orderBy("symbol")


def misplaced_nulls(m) -> DataFrame:
    d = numbered(m.dm, ["asset_id"], "date", day_slice("date")).withColumn("day_num", F.col("rn") + 1)
    bad = F.lit(False)
    for c, n in WATERFALL.items():
        if n:
            bad = bad | ((F.col("day_num") > n) == F.col(c).isNull())
    status = {"return_status": "daily_return_pct", "vol7_status": "vol_7d", "vol30_status": "vol_30d", "sma7_status": "sma_7", "sma30_status": "sma_30", "volratio_status": "volume_ratio_30d"}
    return d.filter(bad).select(*KEYS, "day_num", *(F.when(F.col(c).isNull(), "NULL").otherwise("VALUE").alias(k) for k, c in status.items())).orderBy("asset_id", "day_num")


def extreme_returns(m, low: float = -100.0, high: float = 500.0) -> DataFrame:
    r = F.col("daily_return_pct")
    label = F.when(r <= low, "VIOLATION: return <= -100%").when(r > high, "VIOLATION: return > +500%").otherwise("OK")  # fixed values: the labels
    return m.dm.filter((r <= low) | (r > high)).select(*KEYS, r, label.alias("range_check")).orderBy(F.desc(F.abs(r)), "symbol", "date")


def negative_ranges(m) -> DataFrame:
    return m.dm.join(m.dp.select("asset_id", "date", "high", "low"), ["asset_id", "date"]).filter("daily_range_pct < 0").select(*KEYS, "daily_range_pct", "high", "low").orderBy("daily_range_pct", "symbol", "date")


def below(m, columns: tuple[str, str], violates: Callable[[Column], Column], sign: str) -> DataFrame:
    a, b = map(F.col, columns)
    label = F.when(violates(a), f"VIOLATION: {columns[0]} {sign} 0").when(violates(b), f"VIOLATION: {columns[1]} {sign} 0").otherwise("MULTIPLE")  # fixed values: the labels
    return m.dm.filter(violates(a) | violates(b)).select(*KEYS, a, b, label.alias("violation_type")).orderBy("asset_id", "date")


def negative_ratios(m) -> DataFrame:
    return m.dm.filter("volume_ratio_30d < 0").select(*KEYS, "volume_ratio_30d").orderBy("asset_id", "date")


STATS = {"return": "daily_return_pct", "range": "daily_range_pct", "vol7": "vol_7d", "vol30": "vol_30d", "sma7": "sma_7", "sma30": "sma_30", "volratio": "volume_ratio_30d"}


def statistics(m) -> DataFrame:
    out = []
    for k, c in STATS.items():
        out += [F.min(c).alias(f"{k}_min"), F.max(c).alias(f"{k}_max")]
        if not k.startswith("sma"):
            out.append(rounded(F.avg(c), 4).alias(f"{k}_avg"))
    return m.dm.groupBy("symbol").agg(*out).orderBy("symbol")


def both_vols(m) -> DataFrame:
    return m.dm.filter("vol_7d IS NOT NULL AND vol_30d IS NOT NULL")


def vol_variability(m) -> DataFrame:
    d = both_vols(m).groupBy("asset_id", "symbol").agg(*(F.stddev_pop(c).alias(c) for c in ("vol_7d", "vol_30d")))
    label = F.when(F.col("vol_7d") > F.col("vol_30d"), "PASS").otherwise("FAIL -- vol_7d should be noisier than vol_30d")  # fixed values: the labels
    return d.select("asset_id", "symbol", *(rounded(F.col(c), 6).alias(f"variability_of_{c}") for c in ("vol_7d", "vol_30d")), label.alias("check_result")).orderBy("symbol")


def bullish_alignment(m, symbol: str = "BTC", start: str = "2024-11-06", end: str = "2025-09-30") -> DataFrame:
    d = m.dm.filter((F.col("symbol") == symbol) & F.col("date").between(on(start), on(end)) & F.col("sma_30").isNotNull()).join(m.dp.select("asset_id", "date", "close"), ["asset_id", "date"])
    n, up = F.count("*"), F.count_if((F.col("close") > F.col("sma_7")) & (F.col("sma_7") > F.col("sma_30")))
    return d.agg(n.alias("total_days"), up.alias("bullish_aligned_days")).withColumn("bullish_pct", rounded(ratio(F.col("bullish_aligned_days"), F.col("total_days")) * 100, 1))


def spike_on(m, day: str = "2022-11-08") -> DataFrame:
    v = F.col("volume_ratio_30d")
    label = F.when(v > 2.0, "PASS -- spike detected").when(v > 1.5, "MARGINAL -- elevated but < 2x").otherwise("FAIL -- no spike detected on FTX collapse date")  # fixed values: the labels
    return m.dm.filter((F.col("date") == on(day)) & v.isNotNull()).select("symbol", v, label.alias("check_result")).orderBy(F.desc(v), "symbol")


def vol_means(m) -> DataFrame:
    d = both_vols(m).groupBy("symbol").agg(F.avg("vol_7d").alias("a"), F.avg("vol_30d").alias("b")).withColumn("q", ratio(F.col("a"), F.col("b")))
    label = F.when(F.col("q").between(0.5, 2.0), "PASS").otherwise("FAIL -- means diverge too much")  # fixed values: the labels
    return d.select("symbol", rounded(F.col("a"), 4).alias("avg_vol_7d"), rounded(F.col("b"), 4).alias("avg_vol_30d"), rounded(F.col("q"), 2).alias("ratio_of_means"), label.alias("check_result")).orderBy("symbol")


def averages_out_of_bounds(m) -> DataFrame:
    rows = numbered(m.daily_prices.select("asset_id", "date", F.col("close").cast("double").alias("close")), ["asset_id"], "date", day_slice("date"))
    bounds = sliding(rows, ["asset_id"], "rn", {f"{k}_close_{n}": (k, "close", n) for n in (7, 30) for k in ("min", "max")})
    d = m.dm.join(bounds.drop("close", "rn"), ["asset_id", "date"])
    bad = ~F.col("sma_7").between(F.col("min_close_7"), F.col("max_close_7")) | ~F.col("sma_30").between(F.col("min_close_30"), F.col("max_close_30"))
    return d.filter(bad).select(*KEYS, "sma_7", "min_close_7", "max_close_7", "sma_30", "min_close_30", "max_close_30").orderBy("asset_id", "date")


# Dates and what is expected on them.
SPOT_DAYS = {
    "2022-06-13": "Celsius/3AC panic: expected ~ -15% to -20%",
    "2022-11-08": "FTX collapse: expected ~ -10% to -14%",
    "2023-10-24": "ETF DTCC listing: expected ~ +7% to +15%",
    "2024-11-06": "U.S. election: expected ~ +6% to +10%",
}
PERIODS = {
    "Nov 2022 (FTX crash -- HIGH vol expected)": ("2022-11-01", "2022-11-30"),
    "Jun-Aug 2023 (accumulation -- LOW vol expected)": ("2023-06-01", "2023-08-31"),
}


def spot_returns(m, symbol: str = "BTC") -> DataFrame:
    context = F.lit("unknown")
    for d, label in SPOT_DAYS.items():
        context = F.when(F.col("date") == on(d), label).otherwise(context)
    d = m.dm.filter((F.col("symbol") == symbol) & F.col("date").isin(*(shifted(x) for x in SPOT_DAYS)))
    return d.join(m.dp.select("asset_id", "date", "close"), ["asset_id", "date"]).select("date", "daily_return_pct", "close", context.alias("event_context")).orderBy("date")


def period_vols(m, symbol: str = "BTC") -> DataFrame:
    label = F.lit(None).cast("string")
    for name, (a, b) in PERIODS.items():
        label = F.when(F.col("date").between(on(a), on(b)), name).otherwise(label)  # fixed values: the labels
    d = m.dm.filter((F.col("symbol") == symbol) & F.col("vol_30d").isNotNull()).withColumn("period_label", label).filter("period_label IS NOT NULL")
    return d.groupBy("period_label").agg(*(rounded(f("vol_30d"), 4).alias(f"{n}_vol_30d") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max)))).orderBy("period_label")


def crash_day(m, day: str = "2022-11-08") -> DataFrame:
    r, v = F.col("daily_return_pct"), F.col("volume_ratio_30d")
    a = F.when(r < -5, "PASS -- significant decline").when(r < 0, "MARGINAL -- small decline").otherwise("FAIL -- positive return on crash date is suspicious")
    b = F.when(v > 2.0, "PASS -- volume spike").otherwise("FAIL -- no volume spike")
    return m.dm.filter(F.col("date") == on(day)).select("symbol", r, "daily_range_pct", v, a.alias("return_check"), b.alias("volume_check")).orderBy(nulls_last("daily_return_pct"), "symbol")


def week_of(m, symbol: str = "BTC", start: str = "2022-11-06", end: str = "2022-11-14") -> DataFrame:
    return m.dm.filter((F.col("symbol") == symbol) & F.col("date").between(on(start), on(end))).select("date", "daily_range_pct", "daily_return_pct", "vol_7d").orderBy("date")


def with_previous(m) -> DataFrame:
    closes = previous(m.dp.select("asset_id", "date", "close"), ["asset_id"], "date", day_slice("date"), {"prev_close": F.col("close")})
    return m.dm.join(closes, ["asset_id", "date"])


def wrong_signs(m, k: int = 50) -> DataFrame:
    r, up, down = F.col("daily_return_pct"), F.col("close") > F.col("prev_close"), F.col("close") < F.col("prev_close")
    bad = with_previous(m).filter((up & (r <= 0)) | (down & (r >= 0)))
    return bad.select("symbol", "date", "prev_close", "close", r, F.lit("MISMATCH -- sign does not match price direction").alias("sign_check")).orderBy("symbol", "date").limit(k)


def wrong_returns(m, tolerance: float = 0.001, k: int = 20) -> DataFrame:
    expected = ratio(F.col("close") - F.col("prev_close"), F.col("prev_close")) * 100
    d = with_previous(m).withColumn("expected_return_pct", expected).withColumn("off", F.col("expected_return_pct") - F.col("daily_return_pct")).filter(F.abs("off") > tolerance)
    return d.orderBy(F.desc(F.abs("off")), "symbol", "date").limit(k).select("symbol", "date", "expected_return_pct", "daily_return_pct", rounded(F.col("off"), 6).alias("difference"))


@dataclass(frozen=True)
class Check:
    id: str
    kind: str  # zero: no rows is a pass; report: rows to read
    build: Callable[..., DataFrame]


CHECKS = {c.id: c for c in (
    Check("c1_1", "report", row_totals), Check("c1_2", "report", rows_per_asset),
    Check("c1_3", "zero", lambda m: unmatched(m, "daily_prices", "daily_metrics")), Check("c1_4", "zero", lambda m: unmatched(m, "daily_metrics", "daily_prices")),
    Check("c2_1", "report", null_counts), Check("c2_2", "zero", off_waterfall), Check("c2_3", "zero", misplaced_nulls),
    Check("c3_1", "zero", extreme_returns), Check("c3_2", "zero", negative_ranges),
    Check("c3_3", "zero", lambda m: below(m, ("vol_7d", "vol_30d"), lambda x: x < 0, "<")), Check("c3_4", "zero", lambda m: below(m, ("sma_7", "sma_30"), lambda x: x <= 0, "<=")),
    Check("c3_5", "zero", negative_ratios), Check("c3_6", "report", statistics),
    Check("c4_1", "report", vol_variability), Check("c4_2", "report", bullish_alignment), Check("c4_3", "report", spike_on), Check("c4_4", "report", vol_means), Check("c4_5", "zero", averages_out_of_bounds),
    Check("c5_1", "report", spot_returns), Check("c5_2", "report", period_vols), Check("c5_3", "report", crash_day), Check("c5_4", "report", week_of),
    Check("c5_5", "zero", wrong_signs), Check("c5_6", "zero", wrong_returns),
)}
