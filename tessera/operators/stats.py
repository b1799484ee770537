"""Descriptive aggregates over groups of any size.

All are partial-and-final aggregates, so each shuffles a row for each group and
task. Quartiles follow the halves rule (the middle value of an odd count is in
neither half) and are found by rank selection, not by collecting a group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def double_statistics(x: Column) -> dict[str, Column]:
    """Aggregates of a stream of doubles: empty gives 0 counts and sums, infinite
    extremes, and variance 0 for fewer than two values."""
    return {
        "n": F.count(x),
        "total": F.coalesce(F.sum(x), F.lit(0.0)),
        "low": F.coalesce(F.min(x), F.lit(INF)),
        "high": F.coalesce(F.max(x), F.lit(-INF)),
        "average": F.coalesce(F.avg(x), F.lit(0.0)),
        "variance": F.greatest(F.coalesce(F.var_samp(x), F.lit(0.0)), F.lit(0.0)),
        "deviation": F.coalesce(F.stddev_samp(x), F.lit(0.0)),
    }


def summarize(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in double_statistics(F.col(x).cast("double")).items()])


def list_min(x: Column) -> Column:
    """NaN if any value is."""
    return F.when(F.max(F.isnan(x)), F.lit(NAN)).otherwise(F.min(x))


def list_max(x: Column) -> Column:
    return F.max(x)


def list_stddev(x: Column) -> Column:
    """Population standard deviation; null for fewer than two values."""
    return F.when(F.count(x) >= 2, F.stddev_pop(x))


def list_median(x: Column) -> Column:
    return F.median(x)


def norm2(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))


def dot(x: Column, y: Column) -> Column:
    return F.sum(x * y)


def log_sum_exp(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """m + ln(sum(exp(x - m))) with m the group's largest: two aggregations joined on
    the groups, no window over rows."""
    top = df.groupBy(*keys).agg(F.max(x).alias("__m"))
    joined = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))
    return joined.groupBy(*keys).agg((F.max("__m") + F.ln(F.sum(F.exp(F.col(x) - F.col("__m"))))).alias("log_sum_exp"))


#: Groups beyond this size have their ranks sought between approximate percentiles.
BRACKET_FROM = 100_000
BRACKET_WIDTH, BRACKET_ACCURACY = 0.001, 10_000


def halves_quartiles(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, n, lower_quartile, median, upper_quartile, iqr, low, high.

    One pass finds approximate percentiles on both sides of each quartile; the sketch's
    error is a tenth of the gap, so the exact ranks lie between them. A second pass
    counts what lies below each gap and how often each value within occurs. Only these
    values, a few thousandths of a large group, are put in order. Nulls are left out.
    """
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).alias("__x"))
    quarters = [0.25, 0.5, 0.75]
    edges = F.percentile_approx("__x", F.array(*[F.lit(q + s * BRACKET_WIDTH) for q in quarters for s in (-1, 1)]), F.lit(BRACKET_ACCURACY))
    about = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("low"), F.max("__x").alias("high"), edges.alias("__e"))
    wide = F.col("__n") < BRACKET_FROM
    gaps = F.array(*[F.struct(F.lit(j).alias("g"), F.when(wide, F.col("low")).otherwise(F.col("__e")[2 * j]).alias("a"), F.when(wide, F.col("high")).otherwise(F.col("__e")[2 * j + 1]).alias("b")) for j in range(3)])
    about = about.select(*keys, "__n", "low", "high", gaps.alias("__gaps"))
    joined = rows.join(about, keys) if keys else rows.crossJoin(F.broadcast(about))
    gap = lambda j: F.col("__gaps")[j]
    inside = lambda j: F.col("__x").between(gap(j)["a"], gap(j)["b"])
    below = joined.groupBy(*keys).agg(*[F.count_if(F.col("__x") < gap(j)["a"]).alias(f"__below{j}") for j in range(3)])
    near = joined.where(inside(0) | inside(1) | inside(2)).groupBy(*keys, "__x").agg(F.count(F.lit(1)).alias("__c"), F.first("__gaps").alias("__gaps"))
    placed = near.select(*keys, "__x", "__c", F.explode(F.filter(F.array(*[F.when(inside(j), F.lit(j)) for j in range(3)]), lambda g: g.isNotNull())).alias("__g"))
    upto = Window.partitionBy(*keys, "__g").orderBy("__x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = about.select(*keys, "__n", "low", "high")
    rest = below.join(sizes, keys) if keys else below.crossJoin(F.broadcast(sizes))
    ranked = placed.withColumn("__in", F.sum("__c").over(upto))
    ranked = ranked.join(rest, keys) if keys else ranked.crossJoin(F.broadcast(rest))
    first = F.when(F.col("__g") == 0, F.col("__below0")).when(F.col("__g") == 1, F.col("__below1")).otherwise(F.col("__below2"))
    ranked = ranked.withColumn("__to", first + F.col("__in"))
    n = F.col("__n")
    half = F.greatest(F.floor(n / 2), F.lit(1))

    def at(g: int, rank: Column) -> Column:
        return F.max(F.when((F.col("__g") == g) & (F.col("__to") - F.col("__c") < rank) & (rank <= F.col("__to")), F.col("__x")))

    def middle(g: int, first: Column, size: Column) -> Column:
        """Median of ranks first + 1 .. first + size."""
        return (at(g, first + F.floor((size + 1) / 2)) + at(g, first + F.floor(size / 2) + 1)) / 2.0

    out = ranked.groupBy(*keys).agg(
        F.max(n).alias("n"),
        F.coalesce(middle(0, F.lit(0), half), F.max("high")).alias("lower_quartile"),
        middle(1, F.lit(0), n).alias("median"),
        F.coalesce(middle(2, n - half, half), F.max("high")).alias("upper_quartile"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )
    return out.withColumn("iqr", F.col("upper_quartile") - F.col("lower_quartile"))


def outlier_fences(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Quartiles -/+ 1.5 iqr, no further out than the data."""
    q = halves_quartiles(df, keys, x)
    return q.select(*keys, F.greatest(F.col("lower_quartile") - 1.5 * F.col("iqr"), F.col("low")).alias("lower_fence"), F.least(F.col("upper_quartile") + 1.5 * F.col("iqr"), F.col("high")).alias("upper_fence"))


def outliers(df: DataFrame, keys: list[str], x: str, factor: float = 1.5) -> DataFrame:
    """Rows beyond the unclamped fences."""
    q = halves_quartiles(df, keys, x).select(*keys, "lower_quartile", "upper_quartile", "iqr")
    joined = df.join(q, keys) if keys else df.crossJoin(F.broadcast(q))
    return joined.where((F.col(x) < F.col("lower_quartile") - factor * F.col("iqr")) | (F.col(x) > F.col("upper_quartile") + factor * F.col("iqr"))).select(*df.columns)


# Covariance


def moments(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Partial state of a covariance accumulator: n, means and co-moments as arrays
    (lower triangle by rows). merge_moments combines such rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[: i + 1]]
    return df.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in columns]).alias("means"),
        F.array(*[F.coalesce(F.covar_pop(a, b) * F.count(F.lit(1)), F.lit(0.0)) for a, b in pairs]).alias("comoments"),
    )


def merge_moments(parts: DataFrame, dimension: int) -> DataFrame:
    """Pairwise combination of any number of moments() rows, in closed form: the
    co-moment about the joint mean is the parts' sum plus n (m - M)(m' - M')."""
    n = F.sum("n")
    means = parts.agg(n.alias("n"), F.array(*[F.sum(F.col("n") * F.col("means")[i]) / n for i in range(dimension)]).alias("m"))
    both = parts.withColumnRenamed("n", "k").crossJoin(F.broadcast(means))
    pairs = [(i, j) for i in range(dimension) for j in range(i + 1)]
    gap = lambda i: F.col("means")[i] - F.col("m")[i]
    return both.groupBy("n", F.col("m").alias("means")).agg(F.array(*[F.sum(F.col("comoments")[p] + F.col("k") * gap(i) * gap(j)) for p, (i, j) in enumerate(pairs)]).alias("comoments"))


def covariance_matrix(df: DataFrame, columns: list[str], population: bool = False) -> DataFrame:
    """Long form: i, j, covariance, for all pairs; one pass over the rows."""
    f = F.covar_pop if population else F.covar_samp
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), f(a, b).alias("covariance")) for a, b in pairs]).alias("p"))
    half = one.select(F.inline("p"))
    return half.unionByName(half.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "covariance"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson, long form; a constant column gives 0, and 1 on the diagonal."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = lambda a, b: F.lit(1.0) if a == b else F.coalesce(F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))), F.lit(0.0))
    one = df.agg(F.array(*[F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), r(a, b).alias("correlation")) for a, b in pairs]).alias("p"))
    half = one.select(F.inline("p"))
    return half.unionByName(half.where(F.col("i") != F.col("j")).select(F.col("j").alias("i"), F.col("i").alias("j"), "correlation"))


def bowley_skewness(x: Column) -> Column:
    """(q3 + q1 - 2 q2) / (q3 - q1); NaN for fewer than 4 values, 0 if q3 = q1."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return F.when(F.count(x) < 4, F.lit(NAN)).otherwise(F.coalesce(F.try_divide(q[2] + q[0] - 2 * q[1], q[2] - q[0]), F.lit(0.0)))


def tail_ratio(x: Column) -> Column:
    q = F.percentile(x, F.array(F.lit(0.01), F.lit(0.5), F.lit(0.99)))
    return F.coalesce(F.try_divide(q[2] - q[1], q[1] - q[0]), F.lit(0.0))


def multi_class_accuracy(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Share of rows where two vectors have their largest entry at the same place,
    rounded to 4 places; 0 without rows."""
    from ..functions.arrays import same_arg_max

    return df.agg(F.coalesce(F.round(F.avg(same_arg_max(predicted, actual).cast("double")), 4), F.lit(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def statistic(f: Callable[[np.ndarray], float]) -> Callable[[Column], Column]:
    """A caller's function of a sample as a column function of array<double>, in Arrow
    batches. Null arrays give null, null entries are left out."""

    @F.pandas_udf("double")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else float(f(np.asarray(x, dtype=float))) for x in a], dtype="Float64")

    return lambda a: run(F.filter(a.cast("array<double>"), lambda x: x.isNotNull()))
