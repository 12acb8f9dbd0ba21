"""The five tables on disk: created if absent, checked on load, rewritten with a swap, bucketed and sorted by their key.

A table is a view over its current version. load() tags the rows that violate a constraint, writes the next version beside the
present one and replaces the view, which the catalog does in one step: readers see the old rows or the new ones, and a load that
fails or is refused leaves the old ones. A writer that computed its rows from a version which is no longer shown is refused too.
save() does the same without constraints, for rows that are known to satisfy them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from candela.operators.constraints import Rules, tagged, with_defaults
from candela.operators.scans import dense_ids
from candela.sources.market import EVENT_TYPES, LENGTHS

_FACT = {"asset_id": ("assets", "asset_id"), "date": ("date_dim", "date_id")}


@dataclass(frozen=True)
class Table:
    """Columns, the surrogate id that save() numbers (None: the rows bring their ids), the key by which rows lie on disk, and the constraints."""

    columns: str
    serial: str | None
    by: str
    order: tuple[str, ...]
    rules: Rules = field(default_factory=Rules)

    def kinds(self) -> dict[str, str]:
        return dict(c.split(" ", 1) for c in self.columns.split(", "))


TABLES = {
    "assets": Table(
        "asset_id int, symbol string, name string, category string, launch_date date, is_active boolean, created_at timestamp", None, "asset_id", ("asset_id",),
        Rules(keys=(("asset_id",), ("symbol",)), required=("asset_id", "symbol", "name"), lengths=LENGTHS["assets"], defaults={"is_active": "true", "created_at": "current_timestamp()"}),
    ),
    "date_dim": Table(
        "date_id date, year int, quarter int, month int, week int, day_of_week int, is_weekend boolean", None, "date_id", ("date_id",),
        Rules(keys=(("date_id",),), required=("date_id", "year", "quarter", "month", "week", "day_of_week", "is_weekend"), checks={"quarter": "quarter BETWEEN 1 AND 4", "month": "month BETWEEN 1 AND 12", "day_of_week": "day_of_week BETWEEN 0 AND 6"}),
    ),
    "daily_prices": Table(
        "price_id bigint, asset_id int, date date, open decimal(20,8), high decimal(20,8), low decimal(20,8), close decimal(20,8), volume_usd decimal(30,2), market_cap_usd decimal(30,2)",
        "price_id", "asset_id", ("asset_id", "date"),
        Rules(keys=(("asset_id", "date"),), required=("asset_id", "date", "close"), references=_FACT, checks={"close": "close > 0", "volume": "volume_usd >= 0"}),
    ),
    "daily_metrics": Table(
        "metric_id bigint, asset_id int, date date, daily_return_pct decimal(10,6), daily_range_pct decimal(10,6), vol_7d decimal(10,6), vol_30d decimal(10,6), sma_7 decimal(20,8), sma_30 decimal(20,8), volume_ratio_30d decimal(10,4)",
        "metric_id", "asset_id", ("asset_id", "date"), Rules(keys=(("asset_id", "date"),), required=("asset_id", "date"), references=_FACT),
    ),
    "market_events": Table(
        "event_id int, event_date date, event_type string, title string, description string, affected_assets string, source_url string", None, "event_id", ("event_date",),
        Rules(keys=(("event_id",),), required=("event_id", "event_date", "event_type", "title"), lengths=LENGTHS["market_events"], allowed={"event_type": EVENT_TYPES}),
    ),
}


class Refused(ValueError):
    """A load that violates constraints; `counts` has the rows of each."""

    def __init__(self, name: str, counts: dict[str, int]) -> None:
        super().__init__(f"{name} is left as it was: " + ", ".join(f"{k} by {n} rows" for k, n in counts.items()))
        self.counts = counts


class Conflict(RuntimeError):
    """Another writer replaced the table in the meantime."""


def create(spark: SparkSession, folder: str, schema: str = "default", buckets: int = 8) -> None:
    """The tables that are not there yet, empty; calling it again changes nothing. The database lies in folder, too."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema} LOCATION '{folder.rstrip('/')}/database'")
    for name, t in TABLES.items():
        if not spark.catalog.tableExists(f"{schema}.{name}"):
            save(spark.createDataFrame([], t.columns), name, folder, schema, buckets)


def drop(spark: SparkSession, schema: str) -> None:
    """The database with its tables and views; the files of versions stay for frames that still read them."""
    spark.sql(f"DROP DATABASE IF EXISTS {schema} CASCADE")


def shown(spark: SparkSession, name: str, schema: str = "default") -> str | None:
    """The version that the table's view shows."""
    if not spark.catalog.tableExists(f"{schema}.{name}"):
        return None
    return re.search(rf"{name}__\w+", spark.sql(f"SHOW CREATE TABLE {schema}.{name}").first()[0])[0]


def save(rows: DataFrame, name: str, folder: str, schema: str = "default", buckets: int = 8, seen: str | None = None) -> DataFrame:
    """All rows of a table, in place of those before. Rows may be computed from the table itself.

    Defaults fill nulls and missing columns, further columns are left out; constraints are load()'s. Serial ids are 1, 2, ... in the
    table's order. seen: the version that rows were computed from, by default the one shown now; if another is shown at
    the end, this raises Conflict. Old versions are dropped by drop_old().
    """
    spark, t = rows.sparkSession, TABLES[name]
    seen = seen or shown(spark, name, schema)
    with _staged(_conform(rows, t), folder, name) as put:
        return _swap(dense_ids(put, list(t.order), t.serial) if t.serial else put, name, folder, schema, buckets, seen)


def load(rows: DataFrame, name: str, folder: str, schema: str = "default", buckets: int = 8, rejected: str | None = None, seen: str | None = None) -> DataFrame:
    """save() under the table's constraints: keys, references, NOT NULL, checks, enumerations, lengths and the digits of numbers.

    Rows are written once as they come, which fixes them, and tagged with all that each violates; what is found is counted while the
    next version is written. Any violation refuses the load (Refused, with the rows of each constraint) and the table stays. With
    `rejected`, a folder, rows that violate something are appended there with their `violations`, and the rest is loaded.
    """
    spark, t = rows.sparkSession, TABLES[name]
    seen = seen or shown(spark, name, schema)
    parents = {p: spark.table(f"{schema}.{p}") for p, _ in t.rules.references.values()}
    with _staged(_conform(rows, t), folder, name) as raw:
        if rejected:
            with _staged(tagged(raw, t.rules, parents), folder, name) as found:
                bad = F.size("violations") + F.size("unfit") > 0
                found.filter(bad).withColumn("violations", F.concat("violations", "unfit")).drop("unfit").write.mode("append").parquet(rejected)
                good = found.filter(~bad)
                return _swap(dense_ids(good, list(t.order), t.serial) if t.serial else good, name, folder, schema, buckets, seen)
        names = [*t.rules.names(), *(f"domain ({c})" for c in t.kinds())]
        numbered = dense_ids(raw, list(t.order), t.serial) if t.serial and not _without_order(raw, t) else raw
        watch = Observation()
        found = tagged(numbered, t.rules, parents).withColumn("violations", F.concat("violations", "unfit"))
        found = found.observe(watch, *(F.count_if(F.array_contains("violations", n)).alias(f"v{i}") for i, n in enumerate(names)))

        def verdict() -> None:
            if bad := {n: watch.get[f"v{i}"] for i, n in enumerate(names) if watch.get[f"v{i}"]}:
                raise Refused(name, bad)

        return _swap(found, name, folder, schema, buckets, seen, verdict)


def _without_order(rows: DataFrame, t: Table) -> bool:
    """Whether rows lack the columns by which they are numbered: NOT NULL will refuse them."""
    missing = F.lit(False)
    for c in t.order:
        missing = missing | F.col(c).isNull()
    return not rows.filter(missing).isEmpty()


def _conform(rows: DataFrame, t: Table) -> DataFrame:
    """The table's columns but for its serial id, with defaults; a number that does not fit is null and named in `unfit`."""
    known, kinds = with_defaults(rows, **{c: F.expr(x) for c, x in t.rules.defaults.items()}), t.kinds()
    columns = [c for c in kinds if c != t.serial]
    there = [c for c in columns if c in known.columns]
    unfit = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(kinds[c]).isNull(), F.lit(f"domain ({c})")) for c in there]
    put = [(F.col(c) if c in there else F.lit(None)).try_cast(kinds[c]).alias(c) for c in columns]
    return known.select(*put, F.filter(F.array(*unfit), lambda x: x.isNotNull()).alias("unfit"))


@contextmanager
def _staged(rows: DataFrame, folder: str, name: str) -> Iterator[DataFrame]:
    """rows, written: what comes after may read them more than once."""
    path = f"{folder.rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    try:
        yield rows.sparkSession.read.schema(rows.schema).parquet(path)
    finally:
        _delete(rows.sparkSession, path)


def _swap(rows: DataFrame, name: str, folder: str, schema: str, buckets: int, seen: str | None, verdict: Callable[[], None] = lambda: None) -> DataFrame:
    """rows as the next version, which the view shows if the verdict on what was written and the version shown before allow it."""
    spark, t, root = rows.sparkSession, TABLES[name], folder.rstrip("/")
    version = f"{name}__{uuid.uuid4().hex}"
    _write(rows if not t.serial or t.serial in rows.columns else rows.withColumn(t.serial, F.lit(None)), t, f"{schema}.{version}", f"{root}/{version}", buckets)
    try:
        verdict()
        with _locked(spark, f"{root}/{name}.lock"):
            if (now := shown(spark, name, schema)) != seen:
                raise Conflict(f"{name} shows {now} and no longer {seen}")
            spark.sql(f"CREATE OR REPLACE VIEW {schema}.{name} AS SELECT * FROM {schema}.{version}")
    except Exception:
        spark.sql(f"DROP TABLE {schema}.{version}")
        _delete(spark, f"{root}/{version}")
        raise
    return spark.table(f"{schema}.{name}")


def _write(rows: DataFrame, t: Table, table: str, path: str, buckets: int) -> None:
    kinds = t.kinds()
    put = rows.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items())).repartition(buckets, t.by).sortWithinPartitions(*t.order)
    put.write.bucketBy(buckets, t.by).sortBy(*t.order).format("parquet").option("path", path).saveAsTable(table)


@contextmanager
def _locked(spark: SparkSession, path: str) -> Iterator[None]:
    """A file that one writer at a time can create, around the comparison of versions and the swap."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.createNewFile(p):
        raise Conflict(f"another writer holds {path}; a writer that died leaves it, and then it may be deleted")
    try:
        yield
    finally:
        fs.delete(p, False)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_old(spark: SparkSession, name: str, schema: str = "default") -> int:
    """Drops the versions of a table that its view does not show; the number dropped. Files of their folders stay for readers that still run."""
    now = shown(spark, name, schema)
    old = [x.name for x in spark.catalog.listTables(schema) if x.name.startswith(f"{name}__") and x.name != now]
    for x in old:
        spark.sql(f"DROP TABLE {schema}.{x}")
    return len(old)
