"""Generated axes, literal lists, complex vectors; Parquet and text in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_of(*values: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def linspace(spark: SparkSession, start: float, end: float, n: int = 128, f=None) -> DataFrame:
    """pos (0-based), x and, with f, y = f(x). Both ends are exact; one point (end) if
    n is 1 or the ends agree."""
    if n == 1 or start == end:
        out = spark.range(1).select(F.col("id").alias("pos"), F.lit(float(end)).alias("x"))
    else:
        step = (end - start) / (n - 1)
        out = spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") == n - 1, F.lit(float(end))).otherwise(F.lit(float(start)) + F.col("id") * step).alias("x"))
    return out if f is None else out.withColumn("y", f(F.col("x")))


def spacing(start: float, end: float, n: int) -> float:
    return 0.0 if n == 1 or start == end else abs(end - start) / (n - 1)


def centered_int_indexed(a: Column) -> Column:
    """Structs (x, y): whole numbers around 0; an even count begins one further left."""
    return F.transform(a, lambda y, i: F.struct((i - F.floor(F.size(a) / 2)).cast("double").alias("x"), y.alias("y")))


def centered_double_indexed(a: Column) -> Column:
    return F.transform(a, lambda y, i: F.struct((i - (F.size(a) - 1) / 2.0).alias("x"), y.alias("y")))


def complex_vector(re: Column, im: Column) -> Column:
    return F.when(F.size(re) == F.size(im), F.struct(re.alias("re"), im.alias("im"))).otherwise(F.raise_error(F.lit("unequal lengths")).cast("struct<re:array<double>,im:array<double>>"))


def to_array(df: DataFrame, x: str, pos: str) -> DataFrame:
    """One row with the series as an array; for series that fit one value."""
    return df.agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, x))), lambda s: s[x]).alias(x))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_text(df: DataFrame, array_col: str, path: str) -> None:
    from ..functions.arrays import to_text

    df.select(to_text(F.col(array_col)).alias("value")).write.mode("overwrite").text(path)
