"""Operators on ordered series: positions, windows, autocorrelation, as-of lookup."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import checkpoint_dir

NAN = float("nan")

#: Positions that acf() deals to one place.
RUN = 1 << 16


def positions(df: DataFrame, order: list, keys: list[str] | None = None, name: str = "pos") -> DataFrame:
    """0-based positions. With keys a window in each series. Without, a range sort
    and the partitions' counts, so that no task sees the whole series."""
    if keys:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("__id", 33)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # A row for each partition.
    starts = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    return ranged.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__id")


def combine_by_position(a: DataFrame, b: DataFrame, x: str, y: str, op: str = "add", pos: str = "pos") -> DataFrame:
    """Positional inner join: as long as the shorter series."""
    f = {"add": lambda u, v: u + v, "subtract": lambda u, v: u - v, "multiply": lambda u, v: u * v}[op]
    return a.select(pos, F.col(x).alias("__a")).join(b.select(pos, F.col(y).alias("__b")), pos).select(pos, f(F.col("__a"), F.col("__b")).alias("value"))


def slice_positions(df: DataFrame, begin: int, end: int, pos: str = "pos") -> DataFrame:
    """1-based, both ends included, in either order."""
    lo, hi = min(begin, end), max(begin, end)
    return df.where(F.col(pos).between(lo - 1, hi - 1))


def standardize(df: DataFrame, x: str, keys: list[str] | None = None, population: bool = False, name: str = "z") -> DataFrame:
    """Z-scores by group statistics joined back (small against the rows); null if the
    group has fewer than two values or no spread."""
    f = F.stddev_pop if population else F.stddev_samp
    stats = df.groupBy(*(keys or [])).agg(F.avg(x).alias("__m"), f(x).alias("__s"))
    joined = df.join(stats, keys) if keys else df.crossJoin(F.broadcast(stats))
    return joined.withColumn(name, F.try_divide(F.col(x) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def acf(df: DataFrame, x: str, pos: str, lags: int, keys: list[str] | None = None) -> DataFrame:
    """lag and r for lags 0..lags: the biased estimator, NaN for a constant series.

    Positions are dealt in runs of RUN, each with the first rows of the next one, so
    rows move once whatever the number of lags, and a long series is spread out.
    """
    keys = keys or []
    run = max(RUN, lags + 1)
    mean = df.groupBy(*keys).agg(F.avg(x).alias("__m"))
    place = F.col(pos).cast("long")
    d = (df.join(mean, keys) if keys else df.crossJoin(F.broadcast(mean))).select(*keys, place.alias("__p"), (F.col(x) - F.col("__m")).alias("__d"), F.pmod(place, F.lit(run)).alias("__at"))
    first = ((F.col("__p") - F.col("__at")) / run).cast("long")
    dealt = d.withColumn("__own", first).withColumn("__run", F.explode(F.when(F.col("__at") < lags, F.array(first, first - 1)).otherwise(F.array(first))))
    along = Window.partitionBy(*keys, "__run").orderBy("__p")
    products = dealt.select(*keys, "__p", "__own", "__run", *[(F.col("__d") * F.sum("__d").over(along.rangeBetween(k, k))).alias(f"__c{k}") for k in range(lags + 1)])
    sums = products.where("__own = __run").groupBy(*keys).agg(F.array(*[F.sum(f"__c{k}") for k in range(lags + 1)]).alias("__c"), (F.max("__p") - F.min("__p")).alias("__most"))
    return sums.select(*keys, "__c", "__most", F.posexplode("__c").alias("lag", "__l")).where(F.col("lag") <= F.col("__most")).select(*keys, "lag", F.coalesce(F.try_divide("__l", F.col("__c")[0]), F.lit(NAN)).alias("r"))


def durbin_levinson(r: np.ndarray) -> np.ndarray:
    """Partial autocorrelations of lags 0..len(r)-1; zeros once the error vanishes."""
    out = np.zeros(len(r))
    if len(r):
        out[0] = 1.0
    phi = np.zeros(0)
    error = 1.0
    for k in range(1, len(r)):
        if not error >= 1e-15:
            break
        a = (r[k] - phi @ r[k - 1 : 0 : -1] if k > 1 else r[1]) / error
        phi = np.append(phi - a * phi[::-1], a)
        error *= 1 - a * a
        out[k] = a
    return out


def pacf(df: DataFrame, x: str, pos: str, lags: int, keys: list[str] | None = None) -> DataFrame:
    """lag and partial autocorrelation; the recursion runs on the few lags of a key."""
    r = acf(df, x, pos, lags, keys)
    keys = keys or []
    rows = r.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "r"))), lambda s: s["r"]).alias("rs"))

    @F.pandas_udf("array<double>")
    def solve(rs: pd.Series) -> pd.Series:
        return rs.map(lambda v: durbin_levinson(np.asarray(v, dtype=float)))

    return rows.select(*keys, F.posexplode(solve("rs")).alias("lag", "partial"))


def acf_bound(n: Column) -> Column:
    """1.96 / sqrt(n); 0 for n <= 0."""
    return F.when(n > 0, 1.96 / F.sqrt(F.greatest(n, F.lit(1)))).otherwise(F.lit(0.0))


def is_significant(v: Column, n: Column) -> Column:
    return F.abs(v) > acf_bound(n)


def as_of(queries: DataFrame, knots: DataFrame, x: str, knot: str, payload: list[str], slices: int | None = None) -> DataFrame:
    """queries with the payload of the greatest knot <= x (the last but one knot's
    for x at the last one is the caller's affair); null below the first. Of equal
    knots the one with the greatest payload counts.

    Knots and queries are dealt into slices (as many as shuffle partitions, 64 at
    least) by quantiles of both; a window in each slice carries the last knot along,
    and a slice begins with the knot before it, found among the slices' last knots: a
    row for each slice. A value that fills several slices has as many parts, by hash
    of the query, each with the knots of its slice.
    """
    slices = slices or max(64, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    number = lambda df, c: df.select(F.col(c).cast("double").alias("__x"))
    edges = number(queries, x).unionAll(number(knots, knot)).agg(F.percentile_approx("__x", F.array(*[F.lit((i + 1) / slices) for i in range(slices - 1)]), max(1000, 20 * slices)).alias("e"))
    e = F.coalesce(F.col("e"), F.array().cast("array<double>"))

    def tag(df, c):
        """__slice, and __parts: as many as edges that are the slice's beginning."""
        sliced = df.withColumn("__x", F.col(c).cast("double")).crossJoin(F.broadcast(edges)).withColumn("__slice", F.size(F.filter(e, lambda v: v <= F.col("__x"))))
        return sliced.withColumn("__parts", F.greatest(F.size(F.filter(e, lambda v: v == F.get(F.col("e"), F.col("__slice") - 1))), F.lit(1))).drop("e")

    single = knots.groupBy(knot).agg(F.max(F.struct(*payload)).alias("__p"))
    held = F.struct(F.col(knot).alias("__k"), *[F.col(f"__p.{p}").alias(p) for p in payload])
    k = tag(single, knot).select("__slice", "__parts", "__x", F.lit(0).alias("__o"), held.alias("__held"))
    q = tag(queries, x).select("__slice", F.pmod(F.xxhash64(*[F.col(c) for c in queries.columns]), F.col("__parts")).cast("int").alias("__part"), "__x", F.lit(1).alias("__o"), *[F.col(c).alias(f"__q_{c}") for c in queries.columns])
    ends = k.groupBy("__slice").agg(F.max_by("__held", "__x").alias("__held"))
    full = q.sparkSession.range(slices).select(F.col("id").cast("int").alias("__slice")).join(ends, "__slice", "left")
    before = full.select("__slice", F.last("__held", ignorenulls=True).over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)).alias("__first"))
    everywhere = k.withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    both = everywhere.unionByName(q, allowMissingColumns=True)
    along = Window.partitionBy("__slice", "__part").orderBy("__x", "__o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("__held", F.last("__held", ignorenulls=True).over(along)).where("__o = 1").join(F.broadcast(before), "__slice", "left")
    got = found.withColumn("__held", F.coalesce("__held", "__first"))
    return got.select(*[F.col(f"__q_{c}").alias(c) for c in queries.columns], F.col("__held.__k").alias(f"{knot}_found"), *[F.col(f"__held.{p}").alias(p) for p in payload])


def by_partition(df: DataFrame, f, schema: str) -> DataFrame:
    """f over each partition's pandas batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return df.mapInPandas(run, schema)
