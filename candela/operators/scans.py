"""Windows over long series that many tasks share: a key's rows are cut into slices, and what a slice needs from before is carried to it.

A window partitioned by key alone is one task for a key, however long its series. Here windows are partitioned by key and slice. What a
frame without a lower bound needs is one row for each slice (segmented prefix scan); what a bounded frame needs is a copy of
the rows before the slice (halo); extremes of a bounded frame come from running extremes of blocks as long as the frame.
Keys and orders are not null, and an order is total within its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days of a slice by time, and rows of a slice by number.
SLICE_DAYS, SLICE_ROWS = 1024, 1024
AGGREGATES = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
_FIRST = W.unboundedPreceding


def day_slice(day: str, days: int = SLICE_DAYS) -> Column:
    """The slice of a date: with one row a day, none has more than `days` rows."""
    return F.floor(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")) / F.lit(days))


def slice_of(df: DataFrame, order: str) -> Column:
    """Slices for a column: of dates by day_slice(), of numbers SLICE_ROWS wide, of texts by their first two characters; anything else is one slice."""
    kind = df.schema[order].dataType
    if isinstance(kind, T.DateType):
        return day_slice(order)
    if isinstance(kind, T.StringType):
        return F.substring(order, 1, 2)
    return F.floor(F.col(order) / F.lit(SLICE_ROWS)) if isinstance(kind, T.NumericType) else F.lit(0)


def _merge(kind: str, before: Column, own: Column) -> Column:
    if kind in ("max", "min"):
        return (F.greatest if kind == "max" else F.least)(before, own)  # skip nulls
    return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)


def running(df: DataFrame, keys: list[str], order: str, part: Column, values: dict[str, tuple[str, Column]], descending: bool = False) -> DataFrame:
    """df with running aggregates of each key's rows up to and with each row, as {name: ("sum" | "count" | "max" | "min", x)}.

    part: a row's slice, which ascends with `order`. Slices are scanned for themselves; a row for each slice holds what all those
    before it come to. Nulls are skipped, so a sum or extreme is null until a value is there.
    """
    by = [*keys, "_part"]
    cut = df.withColumn("_part", part)
    o, p = (F.col(order).desc(), F.col("_part").desc()) if descending else (F.col(order), F.col("_part"))
    own, before = W.partitionBy(*by).orderBy(o).rowsBetween(_FIRST, 0), W.partitionBy(*keys).orderBy(p).rowsBetween(_FIRST, -1)
    totals = cut.groupBy(*by).agg(*(AGGREGATES[k](x).alias(f"_{n}") for n, (k, x) in values.items()))
    merged = {n: F.sum if k == "count" else AGGREGATES[k] for n, (k, _) in values.items()}
    carry = totals.select(*by, *(merged[n](f"_{n}").over(before).alias(f"_{n}") for n in values))
    local = cut.select("*", *(AGGREGATES[k](x).over(own).alias(f"_own_{n}") for n, (k, x) in values.items()))
    found = local.join(carry, by)
    return found.select(*(c for c in df.columns if c not in values), *(_merge(k, F.col(f"_{n}"), F.col(f"_own_{n}")).alias(n) for n, (k, _) in values.items()))


def previous(df: DataFrame, keys: list[str], order: str, part: Column, values: dict[str, Column]) -> DataFrame:
    """df with the values of each key's row before, null at its first; slices as in running()."""
    by = [*keys, "_part"]
    cut = df.withColumn("_part", part)
    own, before = W.partitionBy(*by).orderBy(order), W.partitionBy(*keys).orderBy("_part")
    last = cut.groupBy(*by).agg(*(F.max_by(F.struct(x.alias("x")), order).alias(f"_{n}") for n, x in values.items()))
    carry = last.select(*by, *(F.lag(f"_{n}").over(before).getField("x").alias(f"_{n}") for n in values))
    local = cut.select("*", F.row_number().over(own).alias("_rn"), *(F.lag(x).over(own).alias(f"_own_{n}") for n, x in values.items()))
    found = local.join(carry, by)
    return found.select(*(c for c in df.columns if c not in values), *(F.when(F.col("_rn") == 1, F.col(f"_{n}")).otherwise(F.col(f"_own_{n}")).alias(n) for n in values))


def numbered(df: DataFrame, keys: list[str], order: str, part: Column, name: str = "rn") -> DataFrame:
    """df with the number of each row within its key, from 0."""
    return running(df, keys, order, part, {name: ("count", F.lit(1))}).withColumn(name, F.col(name) - 1)


def dense_ids(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """df with ids after + 1, after + 2, ... in the given order, which is total; the first column is its main one.

    The rows of each value of the first column are counted, the counts scanned in slices, and rows numbered within their value:
    no task gets all rows, and the same rows get the same ids in every run.
    """
    first, *rest = order
    counts = df.groupBy(first).agg(F.count("*").alias("_n"))
    before = running(counts, [], first, slice_of(df, first), {"_to": ("sum", F.col("_n"))}).select(first, (F.col("_to") - F.col("_n")).alias("_before"))
    rows = df.withColumn("_rest", F.struct(*rest) if rest else F.lit(0))
    placed = numbered(rows, [first], "_rest", slice_of(df, rest[0]) if rest else F.lit(0), "_at").join(before, first)
    return placed.select(*(c for c in df.columns if c != name), (F.lit(after) + F.col("_before") + F.col("_at") + 1).cast("long").alias(name))


def with_halo(df: DataFrame, position: Column, size: int, before: int, name: str = "slice") -> DataFrame:
    """Each row in its slice of `size` positions, and once more in each later slice that begins at most `before` positions after it.

    `own` tells the row from its copies. Positions may be row numbers or days, and have gaps.
    """
    first = F.floor(position / F.lit(size))
    last = F.floor((position + before) / F.lit(size))
    return df.withColumn(name, F.explode(F.sequence(first, last))).withColumn("own", F.col(name) == first)


def sliding(df: DataFrame, keys: list[str], rn: str, frames: dict[str, tuple[str, str, int]]) -> DataFrame:
    """df with extremes over a key's last rows up to each row, as {name: ("max" | "min", column, rows)}; fewer rows at the start.

    rn numbers a key's rows from 0 without gaps. A frame of n rows is the end of one block of n rows and the beginning of the next:
    its extreme is that of two running extremes, whatever n is, and blocks are what windows are partitioned by.
    """
    for name, (kind, x, n) in frames.items():
        block = W.partitionBy(*keys, F.floor(F.col(rn) / n))
        to, back = (block.orderBy(o).rowsBetween(_FIRST, 0) for o in (F.col(rn), F.col(rn).desc()))
        df = df.withColumns({f"_to_{name}": AGGREGATES[kind](x).over(to), f"_from_{name}": AGGREGATES[kind](x).over(back)})
    kept = [c for c in df.columns if not c.startswith(("_to_", "_from_"))]
    # each row's own values, and what it is for the frame that begins with it, meet at the row where that frame ends
    at = df.select(*keys, rn, F.struct(*(c for c in df.columns if not c.startswith("_from_") and c not in (*keys, rn))).alias("row"), *(F.lit(None).cast(df.schema[f"_from_{n}"].dataType).alias(f"_from_{n}") for n in frames))
    moved = [
        df.select(*keys, (F.col(rn) + n - 1).cast(df.schema[rn].dataType).alias(rn), F.lit(None).cast(at.schema["row"].dataType).alias("row"), *((F.col(f"_from_{o}") if o == name else F.lit(None).cast(df.schema[f"_from_{o}"].dataType)).alias(f"_from_{o}") for o in frames))
        for name, (_, _, n) in frames.items()
    ]
    both = reduce(DataFrame.union, moved, at).groupBy(*keys, rn).agg(F.max("row").alias("row"), *(F.max(f"_from_{n}").alias(f"_from_{n}") for n in frames)).filter("row IS NOT NULL")
    best = lambda name, kind: (F.greatest if kind == "max" else F.least)(F.col(f"row._to_{name}"), F.col(f"_from_{name}"))
    return both.select(*(F.col(c) if c in (*keys, rn) else F.col(f"row.{c}").alias(c) for c in kept), *(best(n, k).alias(n) for n, (k, _, _) in frames.items()))


def ranked(df: DataFrame, by: list[str], value: str, ties: list[str] | None = None, width: float = 1.0) -> DataFrame:
    """df with rank, dense_rank and n (rows of the group), largest value first; given ties also row_number, by value and then ties.

    Equal values are counted first, so what is scanned is a row for each value of a group, in slices of values `width` wide: a group may
    have any number of rows. Equal values are numbered in slices by the beginning of the first of ties, a text. Nulls come last.
    """
    rows = df.withColumns({"_value": F.coalesce(F.col(value).cast("double"), F.lit(float("-inf"))), "_null": F.col(value).isNull()})
    key = [*by, "_value", "_null"]
    values = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    values = values.withColumn("_slice", F.when(F.col("_null"), F.lit(-(2**62))).otherwise(F.floor(F.col("_value") / F.lit(width))))
    values = values.withColumn("_order", F.struct("_slice", "_value"))
    counted = running(values, by, "_order", F.col("_slice"), {"_to": ("sum", F.col("_n")), "dense_rank": ("count", F.lit(1))}, descending=True)
    counted = counted.select(*key, (F.col("_to") - F.col("_n") + 1).alias("rank"), "dense_rank")
    found = rows.join(counted, key).join(df.groupBy(*by).agg(F.count("*").alias("n")), by)
    if ties:
        place = numbered(found.withColumn("_tie", F.struct(*ties)), key, "_tie", F.substring(ties[0], 1, 2), "_place")
        found = place.withColumn("row_number", F.col("rank") + F.col("_place")).drop("_place", "_tie")
    return found.drop("_value", "_null")


def tile(k: int, row: str = "row_number", n: str = "n") -> Column:
    """NTILE(k) from a row's number within its group and the group's size: the first tiles get what is left over."""
    size, more = F.floor(F.col(n) / k), F.col(n) % k
    first = more * (size + 1)
    return F.when(F.col(row) <= first, F.ceil(F.col(row) / (size + 1))).otherwise(more + F.ceil((F.col(row) - first) / size)).cast("long")
