"""All queries over the standard tables and, where SQL can express them, their DuckDB
twins. Doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.session import checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("double"), places)


def round_list(a: Column, places: int = 6) -> Column:
    """An array as text of rounded entries: engines print arrays differently."""
    return F.array_join(F.transform(a, lambda x: F.format_string(f"%.{places}f", F.round(x.cast("double"), places) + 0.0)), ",")


def sql_list(a: str, places: int = 6) -> str:
    return f"list_aggregate(list_transform({a}, lambda q: printf('%.{places}f', round(CAST(q AS DOUBLE), {places}) + 0.0)), 'string_agg', ',')"


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


from . import catalogue_arrays, catalogue_math, catalogue_models, catalogue_stats  # noqa: E402

__all__ = ["ORACLES", "QUERIES", "catalogue_arrays", "catalogue_math", "catalogue_models", "catalogue_stats"]
