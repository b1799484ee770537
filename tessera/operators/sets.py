"""Set and map operations on tables and on integer columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _plain(df: DataFrame, by: str) -> DataFrame:
    """Keys that can match: NaN and null equal nothing."""
    if dict(df.dtypes)[by] in ("double", "float"):
        return df.where(F.col(by).isNotNull() & ~F.isnan(by))
    return df.where(F.col(by).isNotNull())


def retain_all(df: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """Rows whose value other has; duplicates stay."""
    return df.join(_plain(other, by).select(by), by, "left_semi")


def remove_all(df: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """Rows whose value other lacks; NaN always stays."""
    return df.join(_plain(other, by).select(by), by, "left_anti")


def contains_all(df: DataFrame, other: DataFrame, by: str) -> DataFrame:
    """One row: whether every value of other is in df."""
    missing = other.select(by).join(_plain(df, by).select(by), by, "left_anti")
    return missing.agg((F.count(F.lit(1)) == 0).alias("contains_all"))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def top_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k most frequent keys; ties by key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(k)


# int -> int maps


def put(m: Column, key, value) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != F.lit(key)), F.create_map(F.lit(key), F.lit(value)))


def put_all(m: Column, other: Column) -> Column:
    """The other map's entries win."""
    return F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(other, k)), other)


def lookup(m: Column, key, absent=-1) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key) if not isinstance(key, Column) else key), F.lit(absent))


def remove_key(m: Column, key) -> Column:
    return F.map_filter(m, lambda k, _: k != F.lit(key))


def contains_key(m: Column, key) -> Column:
    return F.map_contains_key(m, F.lit(key))


def contains_value(m: Column, value) -> Column:
    return F.array_contains(F.map_values(m), F.lit(value))


def add_int(s: Column, v) -> Column:
    return F.array_union(s, F.array(F.lit(v)))


def remove_int(s: Column, v) -> Column:
    return F.array_remove(s, F.lit(v))
