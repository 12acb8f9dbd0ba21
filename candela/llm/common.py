"""What the corpus operators share: tables, written stages, and hashes of rows and text."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The characters \x20 and \x09-\x0D, which separate words and are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
LOWEST = -(2**63)
#: A written table of at most so many thin rows is broadcast; a larger one is joined by a shuffle.
SMALL = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here if a local session has none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


class _Runs(threading.local):
    """The folders of the run_folder() blocks that a thread is in."""

    def __init__(self) -> None:
        self.folders: list[str] = []


_runs = _Runs()


def new_path(spark: SparkSession, label: str) -> str:
    folder = _runs.folders[-1] if _runs.folders else shared_dir(spark)
    return f"{folder.rstrip('/')}/candela-{label}-{uuid.uuid4().hex}"


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What operators write in this block goes to one folder, which is deleted at its end: consume their results before."""
    _runs.folders.append(new_path(spark, "run"))
    try:
        yield _runs.folders[-1]
    finally:
        _delete(spark, _runs.folders.pop())


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder. It cuts the lineage: lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written() tables that no result reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.folder)


def small(df: DataFrame) -> DataFrame:
    """A written table of thin rows, broadcast if it has few of them."""
    return F.broadcast(df) if df.count() <= SMALL else df


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, LOWER)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes with different seeds."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(7), *cols)


def column(df: DataFrame, name: str) -> Column:
    """A column of df by its name, which may hold dots and back-ticks."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and the other columns as one struct `rest`, so that no column of docs can clash with an operator's own."""
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(
        column(docs, id_col).cast("long").alias("id"),
        column(docs, text_col).cast("string").alias("text"),
        (F.struct(*(column(docs, c) for c in rest)) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"),
    )


def with_rest(df: DataFrame, columns: str) -> T.StructType:
    """A schema of id, the `rest` of df, which is in the form of packed(), and further columns: names in it need no quoting, as they would in DDL."""
    return T.StructType([T.StructField("id", T.LongType()), df.schema["rest"], *T.StructType.fromDDL(columns).fields])


def unpacked(df: DataFrame, like: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of `like` from a frame in the form of packed()."""
    own = {id_col: F.col("id"), text_col: F.col("text")}
    return df.select(*(own.get(c, F.col("rest").getField(c)).alias(c) for c in like.columns))
