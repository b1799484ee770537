"""Principal components and non-negative factorisation of rows with an array column."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .matrix import fix_signs, gram, summed, symmetric_eigen, tall_svd, vectors


def _literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


@dataclass
class Components:
    """mean, vectors (dimension x k, columns by falling variance), variances, their total."""

    mean: np.ndarray
    vectors: np.ndarray
    variance: np.ndarray
    total: float

    def explained_ratio(self) -> np.ndarray:
        return self.variance / self.total if self.total else np.zeros_like(self.variance)

    def _project(self, vector: str, factors: np.ndarray) -> Column:
        fold = lambda w: F.aggregate(F.zip_with(F.zip_with(vector, _literal(self.mean), lambda x, m: x.cast("double") - m), _literal(w), lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
        return F.array(*[fold(factors[:, k]) for k in range(factors.shape[1])])

    def transform(self, df: DataFrame, vector: str, name: str = "scores") -> DataFrame:
        """Built-in expressions; the factors are literals."""
        return df.withColumn(name, self._project(vector, self.vectors))

    def whiten(self, df: DataFrame, vector: str, name: str = "scores") -> DataFrame:
        if not (self.variance > 0).all():
            raise ArithmeticError("a component has no variance")
        return df.withColumn(name, self._project(vector, self.vectors / np.sqrt(self.variance)))


def _mean(df: DataFrame, vector: str, dimension: int) -> tuple[int, np.ndarray]:
    v = F.col(vector)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(v[i].cast("double")).alias(f"m{i}") for i in range(dimension)]).first()
    return row.n, np.array(row[1:], dtype=float)


def covariance(df: DataFrame, vector: str, dimension: int, population: bool = False) -> tuple[np.ndarray, np.ndarray]:
    n, mean = _mean(df, vector, dimension)
    centred = df.select(F.zip_with(vector, _literal(mean), lambda x, m: x.cast("double") - m).alias("__c"))
    return mean, gram(centred, "__c", dimension) / (n if population else n - 1)


def covariance_pca(cov: np.ndarray, k: int, mean: np.ndarray | None = None) -> Components:
    w, v = symmetric_eigen(np.asarray(cov, dtype=float))
    w = np.maximum(w, 0)
    return Components(np.zeros(len(w)) if mean is None else np.asarray(mean, dtype=float), v[:, :k], w[:k], float(w.sum()))


def pca(df: DataFrame, vector: str, dimension: int, k: int) -> Components:
    """By the singular values of the centred rows."""
    n, mean = _mean(df, vector, dimension)
    centred = df.select(F.zip_with(vector, _literal(mean), lambda x, m: x.cast("double") - m).alias("__c"))
    s, v = tall_svd(centred, "__c", dimension)
    variance = s**2 / max(1, n - 1)
    return Components(mean, v[:, :k], variance[:k], float(variance.sum()))


def truncated_pca(df: DataFrame, vector: str, dimension: int, k: int, oversampling: int = 6, iterations: int = 30, tolerance: float = 1e-9, seed: int = 0, fixed: bool = False) -> Components:
    """Randomised block iteration. A round is one pass: tasks add up X^T (X Q). The
    blocks of all rounds are kept (dimension x width numbers each) and the components
    sought among all their combinations, so few passes do; it ends, if not before, when
    nothing new is left."""
    n, mean = _mean(df, vector, dimension)
    width = min(dimension, k + oversampling)
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimension, width)))
    basis, image, last = np.zeros((dimension, 0)), np.zeros((dimension, 0)), None
    for _ in range(iterations):
        held = df.sparkSession.sparkContext.broadcast(q)

        def part(b, held=held):
            x = vectors(b.column(0), dimension) - mean
            return x.T @ (x @ held.value)

        z = summed(df, [vector], dimension * q.shape[1], part).reshape(dimension, q.shape[1])
        held.destroy()
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        inner = basis.T @ image
        w, u = np.linalg.eigh((inner + inner.T) / 2)
        values, ritz = w[::-1][:k], (basis @ u[:, ::-1])[:, :k]
        if not fixed and last is not None and np.abs(values - last).max() <= tolerance * max(1e-300, abs(values[0])):
            break
        last = values
        fresh = z - basis @ (basis.T @ z)
        directions, size, _ = np.linalg.svd(fresh, full_matrices=False)
        q = directions[:, size > 1e-13 * np.linalg.norm(z)][:, : dimension - basis.shape[1]]
        if not q.shape[1]:
            break
        q, _ = np.linalg.qr(q - basis @ (basis.T @ q))
    _, cov_diag = n, df.agg(*[F.var_samp(F.col(vector)[i].cast("double")).alias(f"v{i}") for i in range(dimension)]).first()
    return Components(mean, fix_signs(ritz), np.maximum(values, 0) / max(1, n - 1), float(sum(cov_diag)))


def nmf(df: DataFrame, row_id: str, vector: str, dimension: int, k: int, iterations: int = 50, tolerance: float = 1e-4, seed: int = 0) -> tuple[DataFrame, np.ndarray, float]:
    """X ~ W H with non-negative factors: (rows with w, H, relative error).

    H (k x dimension) is on the driver. A round is one pass: a task finds its rows' w
    given H (coordinate descent from zero) and adds up W^T W and W^T X; H then follows
    by the same descent. Rows never move; w is made again from H when asked for.
    """
    scale = df.agg(F.avg(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double"))).alias("m"), F.sum(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("q"), F.min(F.array_min(vector)).alias("low")).first()
    if scale.low is not None and scale.low < 0:
        raise ValueError("entries must not be negative")
    h = np.random.default_rng(seed).random((k, dimension)) * ((scale.m or 0) / dimension / max(k, 1)) * 2 + 1e-12
    last = None
    for _ in range(iterations):
        held = df.sparkSession.sparkContext.broadcast(h)

        def run(batches, held=held):
            hh = held.value
            wtw, wtx = np.zeros((k, k)), np.zeros((k, dimension))
            for b in batches:
                if len(b):
                    x = np.stack(b[vector].to_numpy()).astype(float)
                    w = solve_rows(x, hh)
                    wtw += w.T @ w
                    wtx += w.T @ x
            both = np.concatenate([wtw.ravel(), wtx.ravel()])
            yield pd.DataFrame({"p": np.arange(len(both)), "v": both})

        rows = df.select(vector).mapInPandas(run, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()  # k (k + dimension) numbers
        both = np.zeros(k * k + k * dimension)
        for r in rows:
            both[r.p] = r.v
        wtw, wtx = both[: k * k].reshape(k, k), both[k * k :].reshape(k, dimension)
        error = float(scale.q - 2 * (wtx * h).sum() + (wtw * (h @ h.T)).sum())
        if last is not None and abs(last - error) <= tolerance * max(last, 1e-300):
            break
        last = error
        for _ in range(20):
            for j in range(k):
                if wtw[j, j] > 0:
                    h[j] = np.maximum(0, h[j] + (wtx[j] - wtw[j] @ h) / wtw[j, j])

    @F.pandas_udf("array<double>")
    def weights(x: pd.Series) -> pd.Series:
        return pd.Series(list(solve_rows(np.stack(x.to_numpy()).astype(float), h))) if len(x) else pd.Series([], dtype=object)

    relative = float(np.sqrt(max(last or 0.0, 0.0) / scale.q)) if scale.q else 0.0
    return df.select(row_id, vector, weights(vector).alias("w")), h, relative


def solve_rows(x: np.ndarray, h: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative w of each row with least |x - w H|."""
    g, c = h @ h.T, x @ h.T
    w = np.zeros((len(x), len(h)))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(h)):
            if g[j, j] > 0:
                w[:, j] = np.maximum(0, w[:, j] + (c[:, j] - w @ g[:, j]) / g[j, j])
        if np.abs(w - before).max(initial=0) <= 1e-12 * max(1e-300, np.abs(w).max(initial=0)):
            break
    return w


def reconstruct(weights: DataFrame, h: np.ndarray) -> DataFrame:
    cols = [_literal(h[:, j]) for j in range(h.shape[1])]
    fold = lambda c: F.aggregate(F.zip_with("w", c, lambda x, y: x * y), F.lit(0.0), lambda s, t: s + t)
    return weights.withColumn("approximation", F.array(*[fold(c) for c in cols]))


def reconstruction_error(weights: DataFrame, vector: str, h: np.ndarray) -> DataFrame:
    gap = F.aggregate(F.zip_with(vector, "approximation", lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda s, t: s + t)
    size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(x.cast("double"), 2))
    return reconstruct(weights, h).agg(F.sqrt(F.try_divide(F.sum(gap), F.sum(size))).alias("relative_error"))
