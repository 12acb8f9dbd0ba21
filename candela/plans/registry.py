"""Every market query by name: functions of (spark, directory), and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.operators import constraints as C
from candela.operators import loading as L
from candela.plans import oracle, quality_oracle
from candela.plans.analyses import ANALYSES
from candela.plans.metrics import WATERFALL, metrics, refreshed
from candela.plans.quality import CHECKS
from candela.sinks import months as by_month
from candela.sinks import tables as S
from candela.sources.market import Market, market

METRICS = dict(zip(("return", "range", "vol_7d", "vol_30d", "sma_7", "sma_30", "volume_ratio"), WATERFALL, strict=True))


def _closes(m: Market) -> DataFrame:
    return m.daily_prices.select("asset_id", "date", "close")


def _double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _upsert(m: Market) -> DataFrame:
    """Closes of each month's first day come again twice; the later doubled one stays."""
    first = _closes(m).filter(F.dayofmonth("date") == 1)
    new = first.withColumn("seq", F.lit(1)).unionByName(first.withColumn("close", (F.col("close") * 2).cast("decimal(20,8)")).withColumn("seq", F.lit(2)))
    return _double(L.upsert(_closes(m), new, ["asset_id", "date"], "seq"), "close")


def _insert_absent(m: Market) -> DataFrame:
    """Asset 1 comes again, and once more as asset 9, which is new."""
    own = _closes(m).filter("asset_id = 1").withColumn("close", (F.col("close") + 1).cast("decimal(20,8)"))
    return _double(L.insert_absent(_closes(m), own.unionByName(_closes(m).filter("asset_id = 1").withColumn("asset_id", F.lit(9))), ["asset_id", "date"]), "close")


def _reject(m: Market) -> DataFrame:
    good, bad = L.quarantine(_closes(m).withColumn("close", F.col("close") - 1000))
    return _double(good.withColumn("good", F.lit(True)).unionByName(bad.withColumn("good", F.lit(False))), "close")


def _upsert_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a dimension: every third gets another segment, and suppliers come in as new ones."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    old = read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    changed = old.filter("id % 3 = 0").select("name", F.lower("segment").alias("segment"))
    return L.upsert_attributes(old, changed.unionByName(read("supplier").select(F.col("s_name").alias("name"), F.lit("supply").alias("segment"))), "name", "id", ["segment"])


def _reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, numbered anew by segment and key."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey")
    return L.reload(rows, ["c_mktsegment", "c_custkey"], "row_id")


@contextmanager
def _folder(m: Market) -> Iterator[str]:
    """A new folder that driver and executors share; its files stay for the frames that read them."""
    spark = m.bars.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    yield f"{base.rstrip('/')}/candela_{uuid.uuid4().hex}"


@contextmanager
def _database(m: Market) -> Iterator[tuple[SparkSession, str, str]]:
    """A database of its own with assets, calendar, bars and events loaded, dropped at the end."""
    spark = m.bars.sparkSession
    with _folder(m) as folder:
        schema = folder.rpartition("/")[2]
        S.create(spark, folder, schema)
        try:
            for name in ("assets", "date_dim", "daily_prices", "market_events"):
                S.load(getattr(m, name), name, folder, schema)
            yield spark, folder, schema
        finally:
            S.drop(spark, schema)


def _recompute(m: Market) -> DataFrame:
    """The tables loaded, the metrics twice: the second rewrite takes the place of the first."""
    with _database(m) as (spark, folder, schema):
        prices, known = (spark.table(f"{schema}.{x}") for x in ("daily_prices", "assets"))
        S.load(metrics(prices.filter("asset_id < 3"), known), "daily_metrics", folder, schema)
        return _double(recompute(spark, folder, schema)[0], *WATERFALL)


def recompute(spark: SparkSession, folder: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The metrics of a database's bars, all computed anew and loaded, and the report on what was loaded: null counts of each asset, PASS or WARN."""
    found = S.load(metrics(spark.table(f"{schema}.daily_prices"), spark.table(f"{schema}.assets")), "daily_metrics", folder, schema)
    return found, L.null_report(found, WATERFALL)


def _load_report(m: Market) -> DataFrame:
    with _database(m) as (spark, folder, schema):
        return recompute(spark, folder, schema)[1]


def _bad_bars(m: Market) -> DataFrame:
    """Bars as a broken feed gives them: closes that are not positive or missing, days that come twice, unknown assets, days beyond the calendar, numbers that are too long."""
    day, p = F.dayofmonth("date"), m.daily_prices
    bars = p.withColumns({
        "close": F.when(day == 3, -F.col("close")).when(day == 4, None).otherwise(F.col("close")),
        "asset_id": F.when(day == 6, F.lit(99)).otherwise(F.col("asset_id")),
        "date": F.when(day == 7, F.date_add("date", 40_000)).otherwise(F.col("date")),
        "volume_usd": F.when(day == 8, F.lit("1e40")).when(day == 9, F.lit("-1")).otherwise(F.col("volume_usd").cast("string")),
    })
    return bars.unionByName(bars.filter(day == 5))


def _refused(m: Market) -> DataFrame:
    """What a load of broken bars is refused for, by constraint, and that the table is as before."""
    with _database(m) as (spark, folder, schema):
        before = spark.table(f"{schema}.daily_prices").count()
        try:
            S.load(_bad_bars(m), "daily_prices", folder, schema)
            counts = {}
        except S.Refused as e:
            counts = e.counts
        kept = spark.table(f"{schema}.daily_prices").count() == before
        return spark.createDataFrame([(k, n, kept) for k, n in counts.items()], "violated string, n long, table_kept boolean")


def _diverted(m: Market) -> DataFrame:
    """The same bars with violations diverted: what is loaded, with ids, and what is not, with its violations."""
    with _database(m) as (spark, folder, schema):
        found = S.load(_bad_bars(m), "daily_prices", folder, schema, rejected=f"{folder}/rejected")
        bad = spark.read.parquet(f"{folder}/rejected").select(F.lit(None).cast("long").alias("price_id"), "asset_id", "date", F.array_join(F.array_sort("violations"), "; ").alias("violations"))
        return found.select("price_id", "asset_id", "date", F.lit("").alias("violations")).unionByName(bad)


def _upsert_months(m: Market) -> DataFrame:
    """Closes by month on disk: those of 1995's first quarter come again, twice, and a new asset's; then a day that is there is not inserted again."""
    with _folder(m) as path:
        by_month.store(_closes(m), path)
        again = _closes(m).filter((F.year("date") == 1995) & (F.quarter("date") == 1))
        new = again.withColumn("seq", F.lit(1)).unionByName(again.withColumns({"close": (F.col("close") * 2).cast("decimal(20,8)"), "seq": F.lit(2)}))
        by_month.upsert_into(path, new.unionByName(again.filter("asset_id = 1").withColumns({"asset_id": F.lit(9), "seq": F.lit(1)})), ["asset_id", "date"], "seq")
        by_month.upsert_into(path, again.withColumn("close", F.lit(1).cast("decimal(20,8)")), ["asset_id", "date"])
        return _double(by_month.read(m.bars.sparkSession, path), "close")


def _changed_prices(m: Market) -> tuple[DataFrame, DataFrame]:
    """Bars with closes doubled in March 1996 (assets 1 to 3) and removed on days of May 1997 (asset 2), and the days that changed."""
    march = (F.col("asset_id") <= 3) & F.col("date").between("1996-03-05", "1996-03-20")
    gone = (F.col("asset_id") == 2) & F.col("date").between("1997-05-02", "1997-05-09")
    p = m.daily_prices
    return p.filter(~gone).withColumn("close", F.when(march, F.col("close") * 2).otherwise(F.col("close")).cast("decimal(20,8)")), p.filter(march | gone).select("asset_id", "date")


def _tail(m: Market) -> DataFrame:
    prices, days = _changed_prices(m)
    return _double(refreshed(prices, m.assets, m.daily_metrics, days), *WATERFALL)


def _defaults(m: Market) -> DataFrame:
    """Bars of each month's first day lack their volume, all lack the time of loading."""
    bars = m.daily_prices.select("asset_id", "date", F.when(F.dayofmonth("date") > 1, F.col("volume_usd")).alias("volume_usd"))
    full = C.with_defaults(bars, volume_usd=F.lit(0).cast("decimal(30,2)"), created_at=F.current_timestamp())
    return _double(full.withColumn("created", F.col("created_at") <= F.current_timestamp()).drop("created_at"), "volume_usd")


def _enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type is not one of those that a shop knows."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return C.outside(events, "event_type", ["view", "click", "purchase"])


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose segment, or name without its zeros, is too long."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment", F.regexp_replace("c_name", "#0+", "#").alias("name"))
    return C.too_long(rows, {"c_mktsegment": 9, "name": 11}).select("c_custkey", "name")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text, of which those of large quantities are not numbers."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    dirty = F.when(F.col("l_quantity") > 48, "nan").when(F.col("l_quantity") > 46, "-inf").when(F.col("l_quantity") > 44, "None").when(F.col("l_quantity") > 42, "1,5x").when(F.col("l_quantity") > 40, "").otherwise(F.col("l_extendedprice").cast("string"))
    return rows.withColumn("cleaned", L.to_decimal(dirty).cast("double"))


LOADERS: dict[str, Callable[[Market], DataFrame]] = {
    "l_prices": lambda m: _double(m.daily_prices.drop("market_cap_usd"), "open", "high", "low", "close", "volume_usd"),
    "l_calendar": lambda m: m.date_dim.withColumns({c: F.col(c).cast("long") for c in ("year", "quarter", "month", "week", "day_of_week")}),
    "l_upsert": _upsert,
    "l_insert_absent": _insert_absent,
    "l_gaps": lambda m: L.gaps(m.daily_prices),
    "l_reject": _reject,
    "l_gaps_range": lambda m: L.gaps(m.daily_prices, start=date(1996, 1, 1), end=date(1999, 6, 30)),
    "l_recompute": _recompute,
    "l_load_report": _load_report,
    "l_recompute_tail": _tail,
    "l_upsert_months": _upsert_months,
    "l_refused": _refused,
    "l_diverted": _diverted,
    "l_active": lambda m: _double(metrics(m.daily_prices, m.assets.withColumn("is_active", F.col("asset_id") % 3 != 0)).select("asset_id", "date", "sma_7"), "sma_7"),
    "l_null_waterfall": lambda m: L.null_report(m.daily_metrics, WATERFALL),
    "k_unique": lambda m: C.duplicates(m.daily_prices.select("asset_id", F.month("date").alias("month")), ["asset_id", "month"]),
    "k_not_null": lambda m: C.nulls(m.daily_metrics, ["vol_30d", "sma_30"]).select("asset_id", "date"),
    "k_foreign_key": lambda m: C.orphans(m.daily_prices, m.assets.filter("asset_id <= 6"), {"asset_id": "asset_id"}).select("asset_id", "date"),
    "k_default": _defaults,
    "k_numeric": lambda m: _double(C.unfit(m.daily_prices, {"close": "decimal(7,4)"}).select("asset_id", "date", "close"), "close"),
    "k_check": lambda m: _double(C.failing(m.daily_metrics, F.col("vol_30d") < 6).select("asset_id", "date", "vol_30d"), "vol_30d"),
}


#: Queries over other given tables than the market's.
ON_TABLES = {"l_clean": _clean, "l_upsert_assets": _upsert_assets, "l_reload": _reload, "k_enum": _enumeration, "k_length": _lengths}


def _on_market(build: Callable[[Market], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(market(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    metric = lambda c: lambda m: _double(m.daily_metrics.select("asset_id", "date", c), c)
    builds = {**ANALYSES, **{k: c.build for k, c in CHECKS.items()}, **{f"m_{n}": metric(c) for n, c in METRICS.items()}, **LOADERS}
    return {**{k: _on_market(b) for k, b in builds.items()}, **ON_TABLES}


def sql() -> dict[str, str]:
    return {**{k: oracle.sql(k) for k in oracle.QUERIES}, **{k: quality_oracle.sql(k) for k in quality_oracle.QUERIES}}
