"""The engine's core: operators on keyed, ordered series and on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.functions.core import safe_corr
from candela.operators.scans import SLICE_DAYS, SLICE_ROWS, numbered, running, slice_of, sliding, with_halo


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island", part: Column | None = None) -> DataFrame:
    """Numbers the runs of each key's rows: a row where `breaks` holds starts a new one. part: the rows' slices, slice_of() by default."""
    return running(df, keys, order, slice_of(df, order) if part is None else part, {name: ("sum", F.when(breaks, 1).otherwise(0))})


def drawdown(df: DataFrame, keys: list[str], order: str, price: str, rows: int | None = None) -> tuple[Column, Column]:
    """Peak so far (or of the last `rows` rows) and the drawdown from it in percent, as columns over df, a task for each key."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding if rows is None else 1 - rows, 0)
    peak = F.max(price).over(w)
    return peak, (F.col(price) - peak) / peak * 100


def with_drawdown(df: DataFrame, keys: list[str], order: str, price: str, part: Column | None = None) -> DataFrame:
    """df with `peak`, the highest price so far, and `down`, the distance from it in percent; many tasks share a key."""
    found = running(df, keys, order, slice_of(df, order) if part is None else part, {"peak": ("max", F.col(price))})
    return found.withColumn("down", (F.col(price) - F.col("peak")) / F.col("peak") * 100)


def rolling_drawdown(df: DataFrame, keys: list[str], order: str, price: str, frames: dict[str, int], part: Column | None = None) -> DataFrame:
    """df with the distance in percent from the highest price of the last n rows, as {name: n}."""
    rows = numbered(df, keys, order, slice_of(df, order) if part is None else part, "_rn")
    found = sliding(rows, keys, "_rn", {f"_{n}": ("max", price, k) for n, k in frames.items()}).drop("_rn")
    return found.withColumns({n: (F.col(price) - F.col(f"_{n}")) / F.col(f"_{n}") * 100 for n in frames}).drop(*(f"_{n}" for n in frames))


def forward_sum(keys: list[str], order: str, x: str, k: int) -> Column:
    """The sum of the next k rows, fewer at the end, null after the last; a column, with a task for each key."""
    return F.sum(x).over(W.partitionBy(*keys).orderBy(order).rowsBetween(1, k))


def forward_sums(df: DataFrame, keys: list[str], order: str, x: str, frames: dict[str, int], part: Column | None = None, size: int = SLICE_ROWS) -> DataFrame:
    """df with the sums of x over the next k rows, fewer at the end, null after the last, as {name: k}."""
    rows = numbered(df, keys, order, slice_of(df, order) if part is None else part, "_rn")
    # the rows that follow are those before, counted backwards
    cut = with_halo(rows, -F.col("_rn"), size, max(frames.values()), "_slice")
    w = W.partitionBy(*keys, "_slice").orderBy(order)
    return cut.select("*", *(F.sum(x).over(w.rowsBetween(1, k)).alias(n) for n, k in frames.items())).filter("own").drop("own", "_slice", "_rn")


def rolling_corr(df: DataFrame, keys: list[str], day: str, x: str, y: str, days: int, least: int, size: int = SLICE_DAYS) -> DataFrame:
    """keys, day and the correlation over a key's calendar days up to it, where at least `least` rows have both sides."""
    numbered_days = df.withColumn("_n", F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    cut = with_halo(numbered_days, F.col("_n"), size, days - 1, "_slice")
    w = W.partitionBy(*keys, "_slice").orderBy("_n").rangeBetween(1 - days, 0)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    corr = F.covar_pop(a, b).over(w) / F.when(spread > 1e-12, spread)
    return cut.select(*keys, day, "own", corr.alias("corr"), F.count(a).over(w).alias("pairs")).filter((F.col("pairs") >= least) & F.col("own")).drop("own")


def pair_corr(pairs: DataFrame, by: list[str], x: str, y: str, least: int = 1, n: str = "days", corr: str = "corr") -> DataFrame:
    """Rows and correlation per group of a frame of pairs, for groups of at least `least` rows."""
    return pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count("*").alias(n), safe_corr(F.col(x), F.col(y)).alias(corr)).filter(F.col(n) >= least)


def event_window(events: DataFrame, facts: DataFrame, lo: int, hi: int, day: str = "date", event_day: str = "event_date", few: bool = False, how: str = "inner", also: Column | None = None) -> DataFrame:
    """facts joined to the events in whose window [event_day + lo, event_day + hi] they fall, with `offset` in days.

    Days are cut into bins as long as the window, of which an event touches two at most: the range join is an equi-join on the bin,
    and what is not in the window is filtered. few: the events are known to be few, and are broadcast. how, also: as of a join.
    """
    binned = _bins(events, lo, hi, event_day)
    near = (F.broadcast(binned) if few else binned).alias("e")
    own = facts.withColumn("_bin", F.floor(_day(day) / F.lit(hi - lo + 1))).alias("f")
    offset = F.datediff(F.col(f"f.{day}"), F.col(f"e.{event_day}"))
    on = (F.col("f._bin") == F.col("e._event_bin")) & offset.between(lo, hi)
    return own.join(near, on if also is None else on & also, how).withColumn("offset", offset).drop("_bin", "_event_bin")


def _day(day: str) -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def _bins(events: DataFrame, lo: int, hi: int, event_day: str) -> DataFrame:
    """events in each of the bins of hi - lo + 1 days that their window touches."""
    first, last = (F.floor((_day(event_day) + x) / F.lit(hi - lo + 1)) for x in (lo, hi))
    return events.withColumn("_event_bin", F.explode(F.sequence(first, last)))


def affects(affected: str = "affected_assets", symbol: str = "symbol", exact: bool = False) -> Column:
    """Whether the delimited list names the symbol or ALL: as a substring, or with exact as a whole entry."""
    if exact:
        names = F.split(F.col(affected), r"\s*,\s*")
        return F.array_contains(names, "ALL") | F.array_contains(names, F.col(symbol))
    return F.col(affected).contains("ALL") | F.contains(F.col(affected), F.col(symbol))


def share(n: Column, by: list[str]) -> Column:
    """n as a part of its sum within `by`."""
    return n.cast("double") / F.sum(n).over(W.partitionBy(*by))


def pairs(df: DataFrame, on: list[str], left: str, keep: list[str]) -> DataFrame:
    """Each row beside those of other keys with equal `on`: keep's columns with suffixes 1 and 2, left1 < left2."""
    a, b = (df.select(*on, *(F.col(c).alias(f"{c}{i}") for c in keep)) for i in (1, 2))
    return a.join(b, on).filter(F.col(f"{left}1") < F.col(f"{left}2"))
