"""Bootstrap and jackknife of a sample.

The sample (one group's values) is an array that every task gets; replicates are
dealt over tasks, each drawn by a generator keyed by (seed, replicate).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special

#: Values of a sample that one task can hold.
SAMPLE_MOST = 5_000_000

STATISTICS: dict[str, Callable[[np.ndarray], float]] = {"mean": np.mean, "median": np.median, "variance": lambda v: np.var(v, ddof=1) if len(v) > 1 else 0.0, "stddev": lambda v: np.std(v, ddof=1) if len(v) > 1 else 0.0, "sum": np.sum}


def _check_size(n: int) -> None:
    if not 0 < n <= SAMPLE_MOST:
        raise ValueError(f"the sample has {n} values; 1 to {SAMPLE_MOST} are possible, use poisson_bootstrap beyond")


def whole_sample(df: DataFrame, x: str) -> np.ndarray:
    """All values of x, counted before they are collected; too many are an error."""
    _check_size(df.count())
    return np.array([r[0] for r in df.select(x).toLocalIterator()])


def bootstrap(spark: SparkSession, sample: np.ndarray, statistic: str | Callable[[np.ndarray], float] = "mean", iterations: int = 1000, seed: int = 0) -> DataFrame:
    """replicate, value: the statistic of iterations resamples with replacement."""
    sample = np.asarray(sample, dtype=float)
    _check_size(len(sample))
    f = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    held = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = held.value
        for b in batches:
            out = []
            for i in b["id"]:
                g = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(i)]))
                out.append(float(f(v[g.integers(0, len(v), len(v))])))
            yield pd.DataFrame({"replicate": b["id"], "value": out})

    return spark.range(iterations).mapInPandas(run, "replicate long, value double")


#: P(Poisson(1) <= k) as 64-bit thresholds; beyond k = 20 nothing is left in 64 bits.
_POISSON = np.array([min(2**64 - 1, int(2**64 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)))) for k in range(20)], dtype=np.uint64)


def _poisson_weights(ids: np.ndarray, iterations: int, seed: int) -> np.ndarray:
    """A Poisson(1) weight for each row and replicate: a counter-based hash of seed, id and
    replicate, looked up in the distribution. A row's weights depend on its id alone."""
    x = ids[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, iterations + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed & (2**64 - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return np.searchsorted(_POISSON, x ^ (x >> np.uint64(31)), side="right").astype(float)


def poisson_bootstrap(df: DataFrame, x: str, row_id: str, iterations: int = 200, seed: int = 0) -> DataFrame:
    """replicate, value: means of resamples of a table of any size, with Poisson(1)
    weights drawn by row and replicate; sums are partial in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros(iterations), np.zeros(iterations)
        for b in batches:
            b = b[b["__x"].notna()]
            ids, v = b["__id"].to_numpy().astype(np.uint64), b["__x"].to_numpy(dtype=float)
            for at in range(0, len(v), 4096):
                w = _poisson_weights(ids[at : at + 4096], iterations, seed)
                s += v[at : at + 4096] @ w
                n += w.sum(0)
        yield pd.DataFrame({"replicate": np.arange(iterations), "s": s, "n": n})

    parts = df.select(F.col(row_id).cast("long").alias("__id"), F.col(x).cast("double").alias("__x")).mapInPandas(run, "replicate long, s double, n double")
    return parts.groupBy("replicate").agg(F.try_divide(F.sum("s"), F.sum("n")).alias("value"))


def summary(replicates: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean, standard error and percentile interval of the replicates."""
    a = (1 - level) / 2
    return replicates.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std_error"), F.percentile("value", a).alias("lower"), F.percentile("value", 1 - a).alias("upper"))


def quantile(replicates: DataFrame, p: float) -> DataFrame:
    return replicates.agg(F.percentile("value", p).alias("quantile"))


def jackknife_mean(df: DataFrame, x: str) -> DataFrame:
    """Leave-one-out means, in closed form from the totals, and their acceleration."""
    totals = df.agg(F.sum(x).alias("__s"), F.count(x).alias("__n"))
    loo = df.crossJoin(F.broadcast(totals)).select(((F.col("__s") - F.col(x)) / (F.col("__n") - 1)).alias("t"))
    mean = loo.agg(F.avg("t").alias("__m"))
    d = F.col("__m") - F.col("t")
    return loo.crossJoin(F.broadcast(mean)).agg(F.coalesce(F.try_divide(F.sum(d * d * d), 6 * F.pow(F.sum(d * d), 1.5)), F.lit(0.0)).alias("acceleration"))


def acceleration(sample: np.ndarray, statistic: str | Callable[[np.ndarray], float]) -> float:
    """Jackknife skewness / 6; closed forms for sums and means."""
    v = np.asarray(sample, dtype=float)
    f = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    if statistic == "mean":
        t = (v.sum() - v) / (len(v) - 1)
    elif statistic == "sum":
        t = v.sum() - v
    else:
        t = np.array([f(np.delete(v, i)) for i in range(len(v))])
    d = t.mean() - t
    under = 6 * (d @ d) ** 1.5
    return float((d**3).sum() / under) if under > 0 else 0.0


def bca_interval(replicates: DataFrame, sample: np.ndarray, statistic: str | Callable[[np.ndarray], float] = "mean", level: float = 0.95) -> tuple[float, float]:
    """Bias-corrected, accelerated interval."""
    f = STATISTICS[statistic] if isinstance(statistic, str) else statistic
    seen = float(f(np.asarray(sample, dtype=float)))
    row = replicates.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < seen).alias("below"), F.count_if(F.col("value") == seen).alias("at")).first()
    p = min(max((row.below + row["at"] / 2) / row.n, 0.5 / row.n), 1 - 0.5 / row.n)
    z0 = float(special.normal_quantile(np.array([p]))[0])
    a = acceleration(sample, statistic)
    z = special.normal_quantile(np.array([(1 - level) / 2, (1 + level) / 2]))
    q = special.normal_cdf(z0 + (z0 + z) / (1 - a * (z0 + z)))
    return tuple(replicates.agg(F.percentile("value", F.array(*[F.lit(float(v)) for v in q])).alias("q")).first().q)


def report(replicates: DataFrame, sample: np.ndarray, statistic: str = "mean", level: float = 0.95) -> str:
    s = summary(replicates, level).first()
    low, high = bca_interval(replicates, sample, statistic, level)
    note = "\nthe bias-corrected interval has collapsed" if low == high else ""
    return f"mean {s.mean:.6g}\nstandard error {s.std_error:.6g}\n{level:.0%} percentile [{s.lower:.6g}, {s.upper:.6g}]\n{level:.0%} BCa [{low:.6g}, {high:.6g}]{note}"
