"""The star schema: assets, date_dim, daily_prices, daily_metrics and market_events, from a directory of Parquet files.

Bars come from `lineitem` (one bar per asset and day); assets and events are fixed tables, the calendar is generated.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candela.functions.core import SMALL, few, small
from candela.operators.constraints import with_defaults
from candela.operators.loading import calendar
from candela.plans.metrics import metrics

# The assets, in the order of their ids.
ASSETS = [
    (1, "BTC", "Bitcoin", "layer1"),
    (2, "ETH", "Ethereum", "layer1"),
    (3, "SOL", "Solana", "layer1"),
    (4, "BNB", "BNB", "layer1_exchange"),
    (5, "ADA", "Cardano", "layer1"),
    (6, "AVAX", "Avalanche", "layer1"),
    (7, "LINK", "Chainlink", "oracle"),
    (8, "DOT", "Polkadot", "layer1_interop"),
]
# The curated events, in the order of their ids.
EVENTS = [
    ("2022-05-09", "crash", "Terra/LUNA collapse -- UST stablecoin depeg triggers death spiral", "ALL"),
    ("2022-06-13", "crash", "Celsius freezes withdrawals -- crypto lending crisis begins", "ALL"),
    ("2022-06-27", "exchange_event", "Three Arrows Capital ordered to liquidate", "ALL"),
    ("2022-09-15", "protocol_upgrade", "Ethereum Merge -- transition from Proof of Work to Proof of Stake", "ETH"),
    ("2022-11-02", "exchange_event", "CoinDesk exposes Alameda/FTX balance sheet -- FTX crisis begins", "ALL,SOL"),
    ("2022-11-08", "crash", "FTX halts withdrawals -- exchange collapse and $6B bank run", "ALL,SOL"),
    ("2023-03-10", "macro_event", "Silicon Valley Bank collapses -- US banking crisis hits crypto", "ALL"),
    ("2023-04-12", "protocol_upgrade", "Ethereum Shanghai/Shapella upgrade -- staking withdrawals enabled", "ETH"),
    ("2023-06-05", "regulatory", "SEC sues Binance and Coinbase in consecutive days", "BNB,ALL"),
    ("2023-10-24", "market_milestone", "BTC spot ETF approval anticipation rally -- BlackRock iShares filing progress", "BTC"),
    ("2024-01-10", "market_milestone", "SEC approves 11 spot Bitcoin ETFs -- institutional access begins", "BTC,ALL"),
    ("2024-03-14", "market_milestone", "Bitcoin hits pre-halving ATH of $73,800 -- first ATH before a halving", "BTC"),
    ("2024-04-20", "halving", "Fourth Bitcoin halving -- block reward reduced to 3.125 BTC", "BTC"),
    ("2024-07-23", "market_milestone", "Spot Ethereum ETFs begin trading in the US", "ETH"),
    ("2024-11-06", "market_milestone", "Trump wins 2024 presidential election -- crypto-friendly policy expected", "ALL"),
    ("2024-12-05", "market_milestone", "Bitcoin crosses $100,000 for the first time", "BTC,ALL"),
    ("2025-01-23", "regulatory", "Trump signs crypto executive order -- Strategic Bitcoin Reserve proposed", "ALL"),
    ("2025-10-10", "crash", "Trump 100% China tariff threat triggers $19B crypto liquidation cascade", "ALL"),
]
# The event types.
EVENT_TYPES = ["halving", "crash", "regulatory", "protocol_upgrade", "market_milestone", "exchange_event", "macro_event"]
# Lengths of text columns.
LENGTHS = {"assets": {"symbol": 10, "name": 100, "category": 50}, "market_events": {"event_type": 50, "title": 200, "affected_assets": 500}}
#: Bars of the test data lie earlier than the events; all event dates move back by whole weeks.
SHIFT_DAYS = 9492
#: Price level of each asset in the test data, by asset id.
LEVELS = (3000.0, 2000.0, 1500.0, 1000.0, 800.0, 600.0, 400.0, 300.0)

PRICE, AMOUNT = T.DecimalType(20, 8), T.DecimalType(30, 2)


def shifted(day: str) -> date:
    return date.fromisoformat(day) - timedelta(days=SHIFT_DAYS)


def assets(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(ASSETS, "asset_id int, symbol string, name string, category string").withColumn("launch_date", F.lit(None).cast("date"))
    return with_defaults(rows, is_active=F.lit(True), created_at=F.current_timestamp())


def market_events(spark: SparkSession) -> DataFrame:
    """description and source_url are there for a caller's own events; no query reads them."""
    rows = [(i, shifted(day), kind, title, affected) for i, (day, kind, title, affected) in enumerate(EVENTS, 1)]
    found = spark.createDataFrame(rows, "event_id int, event_date date, event_type string, title string, affected_assets string")
    return found.withColumns({c: F.lit(None).cast("string") for c in ("description", "source_url")})


def daily_prices(lineitem: DataFrame) -> DataFrame:
    """The first and last price by the rows' full key, the extremes, and the last row's volume.

    The full key is a struct, over which Spark aggregates by sorting all rows of a task. So a hash aggregation finds each bar's first and
    last order, and only the rows of those are compared by the full key. There are 8 bars a day at most, which are broadcast if
    their days are few.
    """
    day = F.col("l_shipdate").cast("date")
    asset = (F.pmod(F.col("l_suppkey"), F.lit(len(ASSETS))) + 1).cast("int")
    wave = 1000 + F.abs(F.pmod(F.datediff(day, F.lit("1995-01-01").cast("date")) + 97 * asset, F.lit(800)) - 400)
    level = F.element_at(F.array(*map(F.lit, LEVELS)), asset)
    price = (level * wave / F.lit(1000.0) + F.col("l_extendedprice") / F.lit(1000.0)).cast(PRICE)
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity")
    # a null order is the first, as in the struct
    number = F.coalesce(F.col("l_orderkey").cast("long"), F.lit(-(2**63)))
    rows = lineitem.select(asset.alias("asset_id"), day.alias("date"), price.alias("p"), (F.col("l_quantity") * F.col("l_extendedprice")).cast(AMOUNT).alias("v"), order.alias("o"), number.alias("k"))
    bars = rows.groupBy(F.col("asset_id").alias("a"), F.col("date").alias("d")).agg(F.max("p").alias("high"), F.min("p").alias("low"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    if few(lineitem.select(day.alias("d")).distinct(), SMALL // len(ASSETS)):
        bars = F.broadcast(bars)
    ends = rows.join(bars, F.col("asset_id").eqNullSafe(F.col("a")) & F.col("date").eqNullSafe(F.col("d"))).filter("k = lo or k = hi")
    return ends.groupBy("asset_id", "date").agg(
        F.min_by("p", "o").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("p", "o").alias("close"),
        F.max_by("v", "o").alias("volume_usd"), F.lit(None).cast(AMOUNT).alias("market_cap_usd"),
    )


@dataclass(frozen=True)
class Market:
    """The five tables as DataFrames. Facts are computed once per instance and kept until release()."""

    assets: DataFrame
    market_events: DataFrame
    bars: DataFrame

    @cached_property
    def daily_prices(self) -> DataFrame:
        return self.bars.persist()

    @cached_property
    def daily_metrics(self) -> DataFrame:
        return metrics(self.daily_prices, self.assets).persist()

    def release(self) -> None:
        for name in ("daily_metrics", "daily_prices"):
            if kept := self.__dict__.pop(name, None):
                kept.unpersist()

    @cached_property
    def date_dim(self) -> DataFrame:
        return calendar(self.daily_prices.agg(F.min("date").alias("start"), F.max("date").alias("end")))

    @cached_property
    def few_events(self) -> bool:
        """Whether events can be broadcast, counted once; their windows are two rows each at most."""
        return few(self.market_events)

    @cached_property
    def calendar(self) -> DataFrame:
        """date_dim for joins: a day is a row, which are counted from the bars' span before they are broadcast."""
        return small(self.date_dim)

    @cached_property
    def symbols(self) -> DataFrame:
        return small(self.assets.select("asset_id", "symbol"))

    def _named(self, facts: DataFrame) -> DataFrame:
        keys = ("asset_id", "date")
        return facts.select(*keys, *(F.col(c).cast("double").alias(c) for c in facts.columns if c not in keys)).join(self.symbols, "asset_id")

    @cached_property
    def dm(self) -> DataFrame:
        """The metrics with symbols; measures as DOUBLE."""
        return self._named(self.daily_metrics)

    @cached_property
    def dp(self) -> DataFrame:
        """The prices with symbols; measures as DOUBLE."""
        return self._named(self.daily_prices)


#: By default Spark shuffles a join by asset and day although both sides lie by asset; where no asset has more rows than a task
#: can take, this setting lets such joins read the tables as they lie.
LAYOUT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


class Stored(Market):
    """The market of tables on disk (candela.sinks.tables): facts are read as they lie there, bucketed by asset and sorted by day, and not kept."""

    @cached_property
    def daily_prices(self) -> DataFrame:
        return self.bars

    @cached_property
    def daily_metrics(self) -> DataFrame:
        return self.bars.sparkSession.table(f"{self.__dict__['schema']}.daily_metrics")


def stored(spark: SparkSession, schema: str) -> Stored:
    """The market of a database, for all analyses and checks."""
    m = Stored(*(spark.table(f"{schema}.{t}") for t in ("assets", "market_events", "daily_prices")))
    m.__dict__["schema"] = schema
    return m


_markets: dict[tuple[str, str], tuple[int, Market]] = {}


def _changed(spark: SparkSession, path: str) -> int:
    """When the file or folder was last changed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()


def market(spark: SparkSession, sf_dir: str) -> Market:
    """The market of a directory, kept for the Spark application until its bars' file changes or forget() is called."""
    key, bars = (spark.sparkContext.applicationId, sf_dir), f"{sf_dir}/lineitem.parquet"
    changed = _changed(spark, bars)
    if key not in _markets or _markets[key][0] != changed:
        forget(spark, sf_dir)
        _markets[key] = changed, Market(assets(spark), market_events(spark), daily_prices(spark.read.parquet(bars)))
    return _markets[key][1]


def forget(spark: SparkSession, sf_dir: str) -> None:
    """Releases what market() keeps of a directory."""
    if kept := _markets.pop((spark.sparkContext.applicationId, sf_dir), None):
        kept[1].release()
