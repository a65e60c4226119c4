"""Set operations that keep order and precedence, and keyed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def few(df: DataFrame, most: int = 1_000) -> DataFrame:
    """A table to be broadcast if it has so few rows, which is looked at first; else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_by(df: DataFrame, key: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_rn = 1").drop("_rn")


def union_by_precedence(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """All keys, each from the first part that has it; `precedence` tells which."""
    every = reduce(DataFrame.unionByName, [p.withColumn("precedence", F.lit(i)) for i, p in enumerate(parts)])
    return first_by(every, key, ["precedence"])


def missing(wanted: DataFrame, have: DataFrame, key: list[str]) -> DataFrame:
    return wanted.join(have, key, "left_anti")


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with each changed key's new row; of several changes to one key the last by `seq` holds."""
    last = first_by(changes, [key], [F.desc("seq")]).drop("seq")
    return table.join(last, key, "left_anti").unionByName(last)


def merge_unseen(have: DataFrame, new: DataFrame, text: str, key: str) -> DataFrame:
    """What is there, and the new texts that differ from it by more than case."""
    k = F.lower(F.trim(F.col(text)))
    fresh = first_by(new.withColumn("_k", k), [key, "_k"], [text]).join(have.select(key, k.alias("_k")).distinct(), [key, "_k"], "left_anti").drop("_k")
    return have.withColumn("added", F.lit(False)).unionByName(fresh.withColumn("added", F.lit(True)))


def with_fallback(primary: DataFrame, other: DataFrame, key: str, cols: list[str], append: bool = False) -> DataFrame:
    """Empty columns of the first table from the second by key; with append, also the second's other rows."""
    o = other.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    out = primary.join(o, key, "full" if append else "left")
    return out.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in cols], *[c for c in primary.columns if c not in (key, *cols)])


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("rank") <= n)
