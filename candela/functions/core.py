"""Column functions: rounding, correlation and ordering with one meaning in every engine that checks the results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A curated table of at most so many rows is broadcast.
SMALL = 100_000


def few(df: DataFrame, most: int = SMALL) -> bool:
    """Whether df has at most `most` rows; no more than that are counted."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, broadcast if it has at most `most` rows; beyond that Spark chooses the join."""
    return F.broadcast(df) if few(df, most) else df


def rounded(x: Column, n: int) -> Column:
    """x as DOUBLE, rounded half away from zero. A sum's last bits cannot decide a tie: a little is added first."""
    d = x.cast("double")
    return F.round(d + F.signum(d) * F.lit(1e-11 if n > 6 else 1e-9), n) + F.lit(0.0)  # no -0.0


def ratio(a: Column, b: Column) -> Column:
    """a / b as DOUBLE, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def safe_corr(x: Column, y: Column) -> Column:
    """Correlation over the rows where both are there; null for a constant side or a single row."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, c.cast("double")) for c in (x, y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(spread > 1e-12, spread)


def nulls_last(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def nulls_first(name: str) -> Column:
    """Descending."""
    return F.col(name).desc_nulls_first()


def classify(x: Column, bounds: list[tuple[float, str]], default: str) -> Column:
    """The label of the first bound that x is below, else default."""
    (b, label), *rest = bounds
    out = F.when(x < b, label)
    for b, label in rest:
        out = out.when(x < b, label)
    return out.otherwise(default)
