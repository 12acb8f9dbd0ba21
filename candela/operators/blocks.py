"""Correlation of all pairs of keys by blocks: sums, squares and products of two blocks of keys over a slice of days, added up.

A row for each pair and day, as a self-join gives, is quadratic in keys. Here a slice of days of one block of keys is shipped once for
each block that it meets, and two matrices give the sums of all their pairs at once.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candela.operators.scans import SLICE_DAYS, day_slice

# The function of a block goes to the executors whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys of a block, about.
BLOCK = 128
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _sums(group: pa.Table) -> pa.Table:
    """The sums of all pairs of a block p and a block q over a slice of days."""
    t, x, side = (group[c].to_numpy() for c in ("t", "x", "side"))
    key = group["key"].to_numpy()
    days, row = np.unique(t, return_inverse=True)

    def matrix(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, place = np.unique(key[mine], return_inverse=True)
        values, there = np.zeros((len(days), len(keys))), np.zeros((len(days), len(keys)))
        values[row[mine], place], there[row[mine], place] = x[mine], 1
        return keys, values, there

    (ka, a, m), (kb, b, k) = matrix(side == 0), matrix(side == 1)
    sums = dict(zip(SUMS, (m.T @ k, a.T @ k, m.T @ b, (a * a).T @ k, m.T @ (b * b), a.T @ b), strict=True))
    i, j = np.nonzero(sums["n"])
    # within a block each pair once; between blocks the smaller key first
    less = ka[i] < kb[j]
    if group["p"][0].as_py() == group["q"][0].as_py():
        i, j, less = i[less], j[less], less[less]
    own = {n: v[i, j] for n, v in sums.items()}
    other = {"sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"}
    kind = group.schema.field("key").type
    return pa.table({"k1": pa.array(np.where(less, ka[i], kb[j]), kind), "k2": pa.array(np.where(less, kb[j], ka[i]), kind), **{n: np.where(less, v, own[other.get(n, n)]) for n, v in own.items()}})


def pair_correlations(df: DataFrame, key: str, day: str, x: str, size: int = BLOCK, days: int = SLICE_DAYS) -> DataFrame:
    """key_1, key_2, n (days on which both have x) and corr for all pairs of keys, the smaller key first; null for a constant side. A key has one row a day."""
    rows = df.filter(F.col(x).isNotNull()).select(key, day, F.col(x).cast("double").alias("x"))
    # values count from the key's least one: a constant series is exactly zero
    least = rows.groupBy(key).agg(F.min("x").alias("least"))
    blocks = F.lit(-(-least.count() // size))
    placed = rows.join(least, key).select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), blocks).alias("block"), F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long").alias("t"), day_slice(day, days).alias("slice"), (F.col("x") - F.col("least")).alias("x"))
    # a row for each pair of blocks that its block is in: as first or as second, in a pair with itself as both
    copies = lambda lo, hi, p, q, side: placed.select("slice", F.explode(F.sequence(lo, hi)).alias("other"), "block", "key", "t", "x").select("slice", F.col(p).alias("p"), F.col(q).alias("q"), F.lit(side).alias("side"), "key", "t", "x")
    first, second = copies(F.col("block"), (blocks - 1).cast("long"), "block", "other", 0), copies(F.lit(0).cast("long"), F.col("block"), "other", "block", 1)
    kind = df.schema[key].dataType.simpleString()
    parts = first.union(second).groupBy("slice", "p", "q").applyInArrow(_sums, f"k1 {kind}, k2 {kind}, " + ", ".join(f"{n} double" for n in SUMS))
    s = parts.groupBy("k1", "k2").agg(*(F.sum(n).alias(n) for n in SUMS))
    cov = F.col("sxy") / F.col("n") - F.col("sx") * F.col("sy") / F.col("n") ** 2
    spread = lambda c: F.sqrt(F.greatest(F.col(f"s{c}{c}") / F.col("n") - (F.col(f"s{c}") / F.col("n")) ** 2, F.lit(0.0)))
    both = spread("x") * spread("y")
    return s.select(F.col("k1").alias(f"{key}_1"), F.col("k2").alias(f"{key}_2"), F.col("n").cast("long").alias("n"), (cov / F.when(both > 1e-12, both)).alias("corr"))
