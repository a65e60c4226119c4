"""Helpers for arrays within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of an expression that is evaluated once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that later ones can use without computing it again: a generator is never merged into them."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def first_by_key(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in order; by sorting, so long arrays aren't compared pair by pair. (`sort_array`, as `array_sort` compares by an interpreted lambda.)"""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = bound(keyed, lambda s: F.filter(s, lambda v, i: (i == 0) | (F.get(s, i - 1)["k"] != v["k"])))
    return F.transform(F.sort_array(F.transform(first, lambda v: F.struct(v["i"].alias("i"), v["x"].alias("x")))), lambda v: v["x"])
