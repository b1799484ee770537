"""Frequency and quantile sketches as mergeable aggregates, and the order-dependent
median estimator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Count-min: a table (row, col, count). Tables add up, so parts merge by union and sum.


def _cells(item: Column, depth: int, width: int, seed: int) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.lit(seed), F.lit(r), item), F.lit(width)).cast("int").alias("col")) for r in range(depth)])


def count_min(df: DataFrame, item: str, depth: int = 5, width: int = 2000, seed: int = 0) -> DataFrame:
    """Counters of one pass: depth x width rows at most, summed on the map side."""
    return df.select(F.inline(_cells(F.col(item), depth, width, seed))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("count"))


def count_min_merge(*sketches: DataFrame) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("row", "col").agg(F.sum("count").alias("count"))


def count_min_estimate(sketch: DataFrame, items: DataFrame, item: str, depth: int = 5, width: int = 2000, seed: int = 0) -> DataFrame:
    """item and an estimate that is never below the true count. The sketch has a fixed
    size of depth x width counters, so it is broadcast."""
    asked = items.select(item).distinct().select(item, F.inline(_cells(F.col(item), depth, width, seed)))
    found = asked.join(F.broadcast(sketch), ["row", "col"], "left")
    return found.groupBy(item).agg(F.min(F.coalesce("count", F.lit(0))).alias("estimate"))


def count_min_top_k(df: DataFrame, item: str, k: int = 5, depth: int = 5, width: int = 2000, seed: int = 0) -> DataFrame:
    """The k items of largest estimate; ties by item."""
    estimates = count_min_estimate(count_min(df, item, depth, width, seed), df, item, depth, width, seed)
    return estimates.orderBy(F.desc("estimate"), item).limit(k)


def count_min_total(sketch: DataFrame) -> DataFrame:
    return sketch.where("row = 0").agg(F.sum("count").alias("total"))


# t-digest: centroids (mean, weight), merged in ascending order.


def _digest(means: np.ndarray, weights: np.ndarray, compression: float) -> tuple[np.ndarray, np.ndarray]:
    """One merging pass. A centroid that ends at quantile q holds 4 N q (1 - q) / c at most."""
    order = np.argsort(means, kind="stable")
    m, w = means[order], weights[order]
    total, done = w.sum(), 0.0
    out_m: list[float] = []
    out_w: list[float] = []
    for x, k in zip(m.tolist(), w.tolist(), strict=True):
        if out_w:
            joined = out_w[-1] + k
            q = (done + joined / 2) / total
            if joined <= 4 * total * q * (1 - q) / compression:
                out_m[-1] += (x - out_m[-1]) * k / joined
                out_w[-1] = joined
                continue
            done += out_w[-1]
        out_m.append(x)
        out_w.append(k)
    return np.array(out_m), np.array(out_w)


def t_digest(df: DataFrame, x: str, compression: float = 50.0, keys: list[str] | None = None) -> DataFrame:
    """keys, n and centroids array<struct<mean, weight>> (ascending; the ends are the
    extremes). Each task digests its rows by key; the parts of a key, a few hundred
    centroids each, are merged. NaN and nulls are left out."""
    keys = keys or []
    part = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    schema = (part + ", " if part else "") + "means array<double>, weights array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            b = b[b["__x"].notna()]
            groups = b.groupby(keys, dropna=False)["__x"] if keys else [((), b["__x"])]
            for key, xs in groups:
                key = key if isinstance(key, tuple) else (key,)
                m, w = held.get(key, (np.zeros(0), np.zeros(0)))
                v = xs.to_numpy(dtype=float)
                if len(v):
                    held[key] = _digest(np.concatenate([m, v]), np.concatenate([w, np.ones(len(v))]), compression)
        if held:
            yield pd.DataFrame([(*k, m.tolist(), w.tolist()) for k, (m, w) in held.items()], columns=[*keys, "means", "weights"])

    parts = df.select(*keys, F.col(x).cast("double").alias("__x")).mapInPandas(run, schema)

    @F.pandas_udf("struct<means:array<double>,weights:array<double>>")
    def merge(means: pd.Series, weights: pd.Series) -> pd.DataFrame:
        rows = [_digest(np.concatenate([np.asarray(p, dtype=float) for p in m]), np.concatenate([np.asarray(p, dtype=float) for p in w]), compression) for m, w in zip(means, weights, strict=True)]
        return pd.DataFrame({"means": [m.tolist() for m, _ in rows], "weights": [w.tolist() for _, w in rows]})

    level = parts.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(64)))
    for by in ([*keys, "__salt"], keys):  # at most 64 digests of a key meet in the last step
        level = level.groupBy(*by).agg(F.collect_list("means").alias("m"), F.collect_list("weights").alias("w")).where(F.size("m") > 0).withColumn("d", merge("m", "w")).select(*by, F.col("d.means").alias("means"), F.col("d.weights").alias("weights"))
    return level.select(*keys, F.aggregate("weights", F.lit(0.0), lambda a, b: a + b).cast("long").alias("n"), F.arrays_zip(F.col("means").alias("mean"), F.col("weights").alias("weight")).alias("centroids"))


def _quantile(means, weights, q: float) -> float:
    if not len(means):
        return float("nan")
    w = np.asarray(weights)
    centre = (np.cumsum(w) - w / 2) / w.sum()
    return float(np.interp(q, centre, means))


def _rank(means, weights, x: float) -> float:
    if not len(means):
        return float("nan")
    if x < means[0]:
        return 0.0
    if x >= means[-1]:
        return 1.0
    w = np.asarray(weights)
    return float(np.interp(x, means, (np.cumsum(w) - w / 2) / w.sum()))


def digest_quantile(centroids: Column, q: float) -> Column:
    """Interpolates between the centroids' centres."""

    @F.pandas_udf("double")
    def run(means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([_quantile(m, w, q) for m, w in zip(means, weights, strict=True)])

    return run(F.transform(centroids, lambda c: c["mean"]), F.transform(centroids, lambda c: c["weight"]))


def digest_cdf(centroids: Column, x: float) -> Column:
    """Share of values <= x; 0 below the first centroid, 1 from the last."""

    @F.pandas_udf("double")
    def run(means: pd.Series, weights: pd.Series) -> pd.Series:
        return pd.Series([_rank(m, w, x) for m, w in zip(means, weights, strict=True)])

    return run(F.transform(centroids, lambda c: c["mean"]), F.transform(centroids, lambda c: c["weight"]))


def digest_median(centroids: Column) -> Column:
    return digest_quantile(centroids, 0.5)


def digest_bowley_skewness(centroids: Column, n: Column) -> Column:
    a, b, c = (digest_quantile(centroids, q) for q in (0.25, 0.5, 0.75))
    return F.when(n < 4, F.lit(float("nan"))).otherwise(F.coalesce(F.try_divide(c + a - 2 * b, c - a), F.lit(0.0)))


def digest_tail_ratio(centroids: Column) -> Column:
    a, b, c = (digest_quantile(centroids, q) for q in (0.01, 0.5, 0.99))
    return F.coalesce(F.try_divide(c - b, b - a), F.lit(0.0))


def centroid_count(centroids: Column) -> Column:
    return F.size(centroids)


class RunningMedian:
    """P-square: five markers that follow the median of a stream in its order."""

    def __init__(self):
        self.first: list[float] = []
        self.q: list[float] = []
        self.at = [0, 1, 2, 3, 4]
        self.n = 0

    def accept(self, x: float) -> None:
        self.n += 1
        if len(self.first) < 5:
            self.first.append(x)
            if len(self.first) == 5:
                self.q = sorted(self.first)
            return
        q, at = self.q, self.at
        if x < q[0]:
            q[0], cell = x, 0
        elif x >= q[4]:
            q[4], cell = x, 3
        else:
            cell = next(i for i in range(4) if x < q[i + 1])
        for i in range(cell + 1, 5):
            at[i] += 1
        for i, share in ((1, 0.25), (2, 0.5), (3, 0.75)):
            gap = share * (self.n - 1) - at[i]
            if gap >= 1 and at[i + 1] - at[i] > 1 or gap <= -1 and at[i - 1] - at[i] < -1:
                d = 1 if gap > 0 else -1
                bent = q[i] + d / (at[i + 1] - at[i - 1]) * ((at[i] - at[i - 1] + d) * (q[i + 1] - q[i]) / (at[i + 1] - at[i]) + (at[i + 1] - at[i] - d) * (q[i] - q[i - 1]) / (at[i] - at[i - 1]))
                q[i] = bent if q[i - 1] < bent < q[i + 1] else q[i] + d * (q[i + d] - q[i]) / (at[i + d] - at[i])
                at[i] += d

    def median(self) -> float:
        if not self.n:
            return float("nan")
        return sorted(self.first)[self.n // 2] if self.n <= 5 else self.q[2]


def p_square_median(df: DataFrame, x: str, order: list[str], keys: list[str]) -> DataFrame:
    """keys, n, median: rows of a key stream through the markers in order; memory is
    five numbers, since sorted batches are read one after another."""
    part = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, F.col(x).cast("double").alias("__x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, out = None, None, []
        for b in batches:
            for row in b.itertuples(index=False):
                if tuple(row[:-1]) != key:
                    if state is not None:
                        out.append((*key, state.n, state.median()))
                    key, state = tuple(row[:-1]), RunningMedian()
                if row[-1] == row[-1]:
                    state.accept(row[-1])
        if state is not None:
            out.append((*key, state.n, state.median()))
        yield pd.DataFrame(out, columns=[*keys, "n", "median"])

    return dealt.mapInPandas(run, f"{part}, n long, median double")
