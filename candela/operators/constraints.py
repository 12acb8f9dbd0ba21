"""Constraints: as queries that return the rows which violate them, and as rules that tag every violation of a row in one go."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """PRIMARY KEY and UNIQUE."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """NOT NULL."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(bad)


def orphans(df: DataFrame, parent: DataFrame, keys: dict[str, str]) -> DataFrame:
    """FOREIGN KEY: keys maps columns of df to columns of parent; a null key is no orphan."""
    there = parent.select(*(F.col(p).alias(c) for c, p in keys.items())).distinct()
    bad = df.join(there, list(keys), "left_anti")
    for c in keys:
        bad = bad.filter(F.col(c).isNotNull())
    return bad


def failing(df: DataFrame, predicate: Column) -> DataFrame:
    """CHECK: a null predicate passes."""
    return df.filter(~F.coalesce(predicate, F.lit(True)))


def outside(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """CHECK (column IN (...)): a null passes."""
    return failing(df, F.col(column).isin(allowed))


def unfit(df: DataFrame, domains: dict[str, str]) -> DataFrame:
    """NUMERIC(p, s): rows with a value that does not fit, as {"close": "decimal(20,8)"}; digits beyond the scale are rounded."""
    bad = F.lit(False)
    for c, kind in domains.items():
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull())
    return df.filter(bad)


def with_defaults(df: DataFrame, **defaults: Column) -> DataFrame:
    """DEFAULT for columns that are null or not there."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def too_long(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    """VARCHAR(n)."""
    bad = F.lit(False)
    for c, n in limits.items():
        bad = bad | (F.char_length(c) > n)
    return df.filter(bad)


@dataclass(frozen=True)
class Rules:
    """What the rows of a table must satisfy. keys: primary key first, then unique ones; references: of a column the table and column that it refers to."""

    keys: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    lengths: dict[str, int] = field(default_factory=dict)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    domains: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)

    def row_tags(self) -> dict[str, Column]:
        """Of each constraint that a row can violate alone, whether it does. Nulls violate NOT NULL only."""
        named = {f"not null ({c})": F.col(c).isNull() for c in self.required}
        named |= {f"check ({n})": ~F.coalesce(F.expr(x), F.lit(True)) for n, x in self.checks.items()}
        named |= {f"enumeration ({c})": ~F.coalesce(F.col(c).isin(xs), F.lit(True)) for c, xs in self.allowed.items()}
        named |= {f"length ({c})": F.coalesce(F.char_length(c) > n, F.lit(False)) for c, n in self.lengths.items()}
        return named | {f"domain ({c})": F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull() for c, kind in self.domains.items()}

    def names(self) -> list[str]:
        return [*self.row_tags(), *(f"key ({', '.join(k)})" for k in self.keys), *(f"reference ({c})" for c in self.references)]


def tagged(df: DataFrame, rules: Rules, parents: dict[str, DataFrame]) -> DataFrame:
    """df with `violations`, the names of all constraints that a row violates; every row of a repeated key violates it.

    Keys are counted with partial sums, so a key that fills a table is no task of its own; parents are joined by their keys. df is read
    once for each key and once for the rows: pass a table, not a computation.
    """
    tags = dict(rules.row_tags())
    for i, key in enumerate(rules.keys):
        there = duplicates(df.select(*key).dropna(), list(key)).select(*key, F.lit(True).alias(f"_key{i}"))
        df = df.join(there, list(key), "left")
        tags[f"key ({', '.join(key)})"] = F.col(f"_key{i}").isNotNull()
    for c, (parent, column) in rules.references.items():
        known = parents[parent].select(F.col(column).alias(c), F.lit(True).alias(f"_ref_{c}")).distinct()
        df = df.join(known, c, "left")
        tags[f"reference ({c})"] = F.col(c).isNotNull() & F.col(f"_ref_{c}").isNull()
    found = F.filter(F.array(*(F.when(bad, F.lit(n)) for n, bad in tags.items())), lambda x: x.isNotNull()) if tags else F.array().cast("array<string>")
    helpers = [f"_key{i}" for i in range(len(rules.keys))] + [f"_ref_{c}" for c in rules.references]
    return df.withColumn("violations", found).drop(*helpers)
