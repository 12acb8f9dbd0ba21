"""The derived metrics: all windows of one slice of an asset share one shuffle and one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.core import ratio, rounded, small
from candela.operators.scans import SLICE_ROWS, day_slice, numbered, with_halo

#: Nulls per asset on a series without gaps in its columns.
WATERFALL = {"daily_return_pct": 1, "daily_range_pct": 0, "vol_7d": 7, "vol_30d": 30, "sma_7": 6, "sma_30": 29, "volume_ratio_30d": 30}


def full(x: str, agg, lo: int, hi: int, n: int) -> Column:
    """agg of x over the rows lo..hi around each of a slice's, null unless n of them have x."""
    w = W.partitionBy("asset_id", "_slice").orderBy("date").rowsBetween(lo, hi)
    return F.when(F.count(x).over(w) == n, agg(F.col(x)).over(w))


def metrics(prices: DataFrame, assets: DataFrame, short: int = 7, long: int = 30, size: int = SLICE_ROWS) -> DataFrame:
    """(asset_id, date) with returns and ranges in percent, volatilities, moving averages and the volume ratio.

    Active assets only. Windows count rows, so they skip gaps; a window that is not full gives null; today's volume is not
    in its own average. Volatility comes from unrounded returns; each metric is rounded once, to its column's scale. An asset's
    rows are numbered and cut into slices of `size`, each with copies of the long + 1 rows before it: frames end within them.
    """
    active = prices.join(small(assets.filter("is_active").select("asset_id")), "asset_id")
    d = active.select("asset_id", "date", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume_usd")))
    return _of(numbered(d, ["asset_id"], "date", day_slice("date")), short, long, size)


def _of(d: DataFrame, short: int, long: int, size: int) -> DataFrame:
    """The metrics of numbered rows (rn)."""
    d = with_halo(d, F.col("rn"), size, long + 1, "_slice")
    before = F.lag("close").over(W.partitionBy("asset_id", "_slice").orderBy("date"))
    d = d.withColumn("ret", ratio(F.col("close") - before, before) * 100)
    found = d.select(
        "asset_id", "date", "own",
        rounded(F.col("ret"), 6).cast("decimal(10,6)").alias("daily_return_pct"),
        rounded(ratio(F.col("high") - F.col("low"), F.col("low")) * 100, 6).cast("decimal(10,6)").alias("daily_range_pct"),
        rounded(full("ret", F.stddev_pop, 1 - short, 0, short), 6).cast("decimal(10,6)").alias(f"vol_{short}d"),
        rounded(full("ret", F.stddev_pop, 1 - long, 0, long), 6).cast("decimal(10,6)").alias(f"vol_{long}d"),
        rounded(full("close", F.avg, 1 - short, 0, short), 8).cast("decimal(20,8)").alias(f"sma_{short}"),
        rounded(full("close", F.avg, 1 - long, 0, long), 8).cast("decimal(20,8)").alias(f"sma_{long}"),
        rounded(ratio(F.col("volume_usd"), full("volume_usd", F.avg, -long, -1, long)), 4).cast("decimal(10,4)").alias(f"volume_ratio_{long}d"),
    )
    return found.filter("own").drop("own")


def refreshed(prices: DataFrame, assets: DataFrame, old: DataFrame, changed: DataFrame, short: int = 7, long: int = 30, size: int = SLICE_ROWS) -> DataFrame:
    """The metrics of prices, given the metrics `old` from before rows of prices were added, replaced or removed on the days `changed` (asset_id, date).

    A row's metrics depend on the `long` rows before it. So those from an asset's first changed day to `long` rows after its last one are
    computed, from prices that begin long + 1 rows earlier, and all others are taken over. Equal to metrics(prices, assets).
    """
    active = small(assets.filter("is_active").select("asset_id"))
    d = prices.join(active, "asset_id").select("asset_id", "date", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume_usd")))
    span = changed.groupBy("asset_id").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    rows = numbered(d, ["asset_id"], "date", day_slice("date")).join(span, "asset_id")
    # the numbers of the first row that is computed and of the last that a change can reach
    inside = rows.groupBy("asset_id").agg(F.min(F.when(F.col("date") >= F.col("_first"), F.col("rn"))).alias("_lo"), F.max(F.when(F.col("date") <= F.col("_last"), F.col("rn"))).alias("_hi"))
    inside = inside.select("asset_id", "_lo", F.greatest(F.coalesce("_hi", F.lit(-1)), F.col("_lo") - 1).alias("_hi"))
    lead = rows.join(inside, "asset_id").filter(F.col("rn").between(F.col("_lo") - long - 1, F.col("_hi") + long)).drop("_first", "_last")
    reach = lead.filter(F.col("rn") >= F.col("_lo")).groupBy("asset_id").agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    fresh = _of(lead.drop("_lo", "_hi"), short, long, size).join(reach, "asset_id").filter(F.col("date") >= F.col("_from")).drop("_from", "_to")
    last = span.join(reach, "asset_id", "left").select("asset_id", "_first", F.greatest("_last", F.coalesce("_to", "_last")).alias("_to"))
    kept = old.join(last, "asset_id", "left").join(active, "asset_id").filter(F.col("_first").isNull() | (F.col("date") < F.col("_first")) | (F.col("date") > F.col("_to"))).select(*fresh.columns)
    return kept.unionByName(fresh)
