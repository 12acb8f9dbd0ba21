"""Daily tables by month on disk, and row upserts that rewrite only the months which the new rows hit.

Files of other months keep their names and times. Merged months are staged beside the table and then put in the place of the old ones
(dynamic overwrite). Months are replaced one by one, so a reader may see some of them new; a call that fails on the way can be
repeated with the same rows, and gives the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators.loading import insert_absent, upsert


def _month(day: str):
    return F.date_format(day, "yyyy-MM").alias("month")


def _write(rows: DataFrame, path: str, day: str, mode: str) -> None:
    # months of many rows are split over tasks and files, small ones share a task
    put = rows.select("*", _month(day)).hint("rebalance", "month").sortWithinPartitions("month", day)
    put.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def store(rows: DataFrame, path: str, day: str = "date") -> None:
    """rows as a new table."""
    _write(rows, path, day, "error")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "false").parquet(path).drop("month")


def months(rows: DataFrame, day: str = "date") -> list[str]:
    """The months of rows: as many as the calendar has between them, at most."""
    return sorted(x["month"] for x in rows.filter(F.col(day).isNotNull()).select(_month(day)).distinct().collect())


def upsert_into(path: str, new: DataFrame, keys: list[str], seq: str | None = None, day: str = "date") -> list[str]:
    """Rows of `new` in place of those with equal keys, of several the last by seq; without seq only those are inserted whose keys are not there.

    keys include the day, so a key lies in one month. Returns the months that were rewritten.
    """
    spark, hit = new.sparkSession, months(new, day)
    if not hit:
        return []
    old = spark.read.parquet(path).filter(F.col("month").cast("string").isin(hit)).drop("month")
    merged = upsert(old, new, keys, seq) if seq else insert_absent(old, new, keys)
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"  # readers skip names that begin so
    try:
        merged.select(*old.columns).write.parquet(staged)
        _write(spark.read.schema(old.schema).parquet(staged), path, day, "overwrite")
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return hit
