"""Loader operators: cleaning, quarantine, calendar, upserts, reload, gaps and the null report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from candela.operators.scans import day_slice, dense_ids, previous


def to_decimal(text: Column, kind: str = "decimal(20,8)") -> Column:
    """A number from text; null for null, nan, inf, None and whatever is not a number or does not fit."""
    low = F.lower(F.trim(text.cast("string")))
    return F.when(~low.isin("nan", "inf", "-inf", "+inf", "infinity", "-infinity", "none", ""), low).try_cast(kind)


def quarantine(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars with a positive close, and the rest."""
    good = F.coalesce(F.col("close") > 0, F.lit(False))
    return bars.filter(good), bars.filter(~good)


def calendar(span: DataFrame) -> DataFrame:
    """date_dim for each day from `start` to `end` of span's one row. week is the ISO week, year the calendar year, Monday is 0."""
    day = F.col("date_id")
    return span.select(F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("date_id")).select(
        day, F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.weekofyear(day).alias("week"), F.weekday(day).alias("day_of_week"), (F.weekday(day) >= 5).alias("is_weekend"),
    )


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the last by order. order must be total."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(order.desc_nulls_last()))).filter("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """old with new's rows in place of those with equal keys; of several new ones the last by seq, which is dropped."""
    fresh = latest(new, keys, F.col(seq)).drop(seq)
    return old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def upsert_attributes(old: DataFrame, new: DataFrame, key: str, id_col: str, attributes: list[str]) -> DataFrame:
    """Dimension upsert: known keys keep their id and get new attributes, others get the next ids in the order of their key."""
    fresh = latest(new, [key], F.struct(*attributes))
    known = old.join(fresh.select(key, *(F.col(a).alias(f"_{a}") for a in attributes), F.lit(True).alias("_new")), key, "left")
    kept = known.select(*(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in attributes else F.col(c) for c in old.columns))
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).first()[0]
    added = dense_ids(fresh.join(old.select(key), key, "left_anti").select(key, *attributes), [key], id_col, after=top)
    return kept.unionByName(added.withColumn(id_col, F.col(id_col).cast(old.schema[id_col].dataType)), allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def reload(rows: DataFrame, order: list[str], id_col: str) -> DataFrame:
    """Full reload of a curated table: ids restart at 1 in the given order."""
    return dense_ids(rows, order, id_col)


def gaps(bars: DataFrame, key: str = "asset_id", day: str = "date", start: date | None = None, end: date | None = None) -> DataFrame:
    """The calendar days between a key's first and last bar without a bar; of them those from start to end, where given.

    A gap lies between two neighbouring bars, and only gaps are spread over their days: rows follow the gaps, not the calendar.
    """
    next_to = previous(bars.select(key, day).distinct(), [key], day, day_slice(day), {"_before": F.col(day)})
    first, last = F.date_add("_before", 1), F.date_sub(day, 1)
    first = first if start is None else F.greatest(first, F.lit(start))
    last = last if end is None else F.least(last, F.lit(end))
    between = next_to.filter(F.datediff(day, "_before") > 1).select(key, first.alias("a"), last.alias("b")).filter("a <= b")
    return between.select(key, F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias(day))


def null_report(metrics: DataFrame, expected: dict[str, int], key: str = "asset_id") -> DataFrame:
    """Null counts of each key's columns and whether all are as expected."""
    counts = metrics.groupBy(key).agg(F.count("*").alias("total_rows"), *((F.count("*") - F.count(c)).alias(f"null_{c}") for c in expected))
    ok = F.lit(True)
    for c, n in expected.items():
        ok = ok & (F.col(f"null_{c}") == n)
    return counts.withColumn("status", F.when(ok, "PASS").otherwise("WARN"))
