"""Regression: least squares in its plain, weighted, ridge, lasso, elastic net and
bounded forms. The rows are reduced on the executors, to a triangle (tall_qr) where
digits matter or to a Gram matrix; the small system is solved on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..functions.distributions import StudentT
from .matrix import gram, tall_qr


@dataclass
class Fit:
    beta: np.ndarray
    std_error: np.ndarray
    t: np.ndarray
    p: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    r2: float
    sigma2: float
    rss: float
    n: int
    extra: dict = field(default_factory=dict)


def _columns(df: DataFrame, features: list[str], y: str, weight: str | None = None) -> DataFrame:
    root = F.sqrt(F.col(weight).cast("double")) if weight else F.lit(1.0)
    return df.select(F.array(*[F.col(c).cast("double") * root for c in (*features, y)]).alias("__row"))


def ols(df: DataFrame, features: list[str], y: str, alpha: float = 0.05, weight: str | None = None) -> Fit:
    """Least squares without an implicit intercept; rank deficiency is an error.
    Weights must be finite and positive. R2 is about the (weighted) mean, at most 1."""
    if weight and df.where(F.col(weight).isNull() | ~(F.col(weight) > 0) | F.isnan(weight) | (F.col(weight) == float("inf"))).limit(1).count():
        raise ValueError("weights must be finite and positive")
    p = len(features)
    r = tall_qr(_columns(df, features, y, weight), "__row", p + 1)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = df.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("wy")).first()
    centre = sums.wy / sums.w
    sst = df.agg(F.sum(w * F.pow(F.col(y) - F.lit(centre), 2)).alias("s")).first().s
    rx, ry = r[:p, :p], r[:p, p]
    rss = float(r[p, p] ** 2) if len(r) > p else 0.0
    u, s, vt = np.linalg.svd(rx)
    if not len(s) or s[-1] <= s[0] * max(sums.n, p) * 2.0**-53:
        raise ArithmeticError("rank deficient")
    beta = vt.T @ ((u.T @ ry) / s)
    df_left = sums.n - p
    sigma2 = rss / df_left if df_left > 0 else float("nan")
    se = np.sqrt(np.maximum(((vt.T / s) ** 2).sum(1) * sigma2, 0)) if df_left > 0 else np.full(p, np.nan)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = beta / se
        tail = special.beta_i(df_left / 2, 0.5, df_left / (df_left + t * t)) if df_left > 0 else np.full(p, np.nan)
    q = float(StudentT(df_left).quantile_np(np.array([1 - alpha / 2]))[0]) if df_left > 0 else float("nan")
    r2 = min(1.0, 1 - rss / sst) if sst else 1.0
    return Fit(beta, se, t, tail, beta - q * se, beta + q * se, r2, sigma2, rss, sums.n)


def simple_regression(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Slope, intercept and R2 by group, as built-in aggregates."""
    return df.groupBy(*(keys or [])).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


@dataclass
class Scaled:
    """Centred, scaled Gram system."""

    n: int
    mean: np.ndarray
    scale: np.ndarray
    g: np.ndarray
    c: np.ndarray
    y_mean: float
    yy: float


def scaled_system(df: DataFrame, features: list[str], y: str) -> Scaled:
    p = len(features)
    shift = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate((*features, y))]).first()
    rows = df.select(F.array(*[F.col(c).cast("double") - F.lit(shift[i]) for i, c in enumerate((*features, y))], F.lit(1.0)).alias("__row"))
    m = gram(rows, "__row", p + 2)
    n = int(round(m[-1, -1]))
    scale = np.sqrt(np.diag(m)[:p] / n)
    safe = np.where(scale > 0, scale, 1.0)
    return Scaled(n, np.array(shift[:p], dtype=float), safe, m[:p, :p] / np.outer(safe, safe), m[:p, p] / safe, float(shift[p]), float(m[p, p]))


def _back(s: Scaled, b: np.ndarray) -> tuple[np.ndarray, float]:
    beta = b / s.scale
    return beta, s.y_mean - float(beta @ s.mean)


def ridge(df: DataFrame, features: list[str], y: str, penalty: float) -> dict:
    """Population-scaled features, unpenalised intercept; effective degrees of freedom."""
    s = scaled_system(df, features, y)
    if s.n < len(features):
        raise ValueError("fewer rows than features")
    w, v = np.linalg.eigh(s.g)
    b = v @ ((v.T @ s.c) / (w + penalty))
    beta, intercept = _back(s, b)
    return {"beta": beta, "intercept": intercept, "effective_df": float((w / (w + penalty)).sum()), "variance_factors": ((v * (np.sqrt(np.maximum(w, 0)) / (w + penalty))) ** 2).sum(1)}


def filtered_solve(s: np.ndarray, v: np.ndarray, uty: np.ndarray, penalty: float) -> np.ndarray:
    """sum_k s / (s^2 + penalty) (u.y) v of singular factors."""
    return v @ (s / (s * s + penalty) * uty)


def truncated_solve(s: np.ndarray, v: np.ndarray, uty: np.ndarray, tolerance: float) -> np.ndarray:
    keep = s > tolerance
    return v[:, keep] @ (uty[keep] / s[keep])


def variance_matrix(s: np.ndarray, v: np.ndarray, penalty: float = 0.0) -> np.ndarray:
    f = s / (s * s + penalty)
    return (v * f**2) @ v.T


def variance_diagonal(s, v, penalty=0.0) -> np.ndarray:
    return np.diag(variance_matrix(s, v, penalty))


def effective_df(s: np.ndarray, penalty: float) -> float:
    return float((s * s / (s * s + penalty)).sum())


def rank_deficient_at(s: np.ndarray, rows: int, columns: int) -> int:
    """Index of the first negligible singular value, -1 if there is none."""
    low = np.flatnonzero(s <= s[0] * max(rows, columns) * 2.0**-53) if len(s) else np.zeros(0, dtype=int)
    return int(low[0]) if len(low) else -1


def _descend(g: np.ndarray, c: np.ndarray, n: int, penalty: float, alpha: float, start: np.ndarray, tolerance: float = 1e-9, rounds: int = 100_000) -> np.ndarray:
    """Cyclic coordinate descent on a Gram system, over the active set between full rounds."""
    b = start.copy()
    d = np.diag(g) / n
    active = np.arange(len(b))
    full = True
    for _ in range(rounds):
        moved = 0.0
        for j in active:
            if d[j] == 0:
                continue
            z = (c[j] - g[j] @ b) / n + d[j] * b[j]
            new = np.sign(z) * max(abs(z) - penalty * alpha, 0) / (d[j] + penalty * (1 - alpha))
            moved = max(moved, abs(new - b[j]) * np.sqrt(d[j]))
            b[j] = new
        if moved < tolerance:
            if full:
                break
            active, full = np.arange(len(b)), True
        else:
            active, full = np.flatnonzero(b) if full and np.any(b) else active, not (full and np.any(b))
    return b


def lambda_max(df: DataFrame, features: list[str], y: str, alpha: float = 1.0) -> float:
    """The least penalty at which all coefficients are 0."""
    s = scaled_system(df, features, y)
    return float(np.nextafter(np.abs(s.c).max() / (s.n * alpha), np.inf))


def elastic_net(df: DataFrame, features: list[str], y: str, penalty: float, alpha: float = 1.0) -> dict:
    s = scaled_system(df, features, y)
    b = _descend(s.g, s.c, s.n, penalty, alpha, np.zeros(len(features)))
    beta, intercept = _back(s, b)
    return {"beta": beta, "intercept": intercept, "nonzero": int(np.count_nonzero(b))}


def lasso(df, features, y, penalty) -> dict:
    return elastic_net(df, features, y, penalty, 1.0)


def _grid(top: float, count: int, ratio: float) -> np.ndarray:
    return top * ratio ** (np.arange(count) / max(1, count - 1))


def path(df: DataFrame, features: list[str], y: str, alpha: float = 1.0, count: int = 100, ratio: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Penalties (descending), coefficients by penalty, intercepts; warm starts."""
    s = scaled_system(df, features, y)
    grid = _grid(float(np.nextafter(np.abs(s.c).max() / (s.n * alpha), np.inf)), count, ratio)
    b, out, at = np.zeros(len(features)), [], []
    for penalty in grid:
        b = _descend(s.g, s.c, s.n, penalty, alpha, b)
        beta, intercept = _back(s, b)
        out.append(beta)
        at.append(intercept)
    return grid, np.array(out), np.array(at)


def cross_validate(df: DataFrame, features: list[str], y: str, row_id: str, alpha: float = 1.0, folds: int = 5, seed: int = 0, count: int = 50, ratio: float = 1e-3) -> dict:
    """Mean squared error by penalty; folds by a keyed hash of row_id. One pass makes
    each fold's raw moments; a training set is the total less its fold."""
    p = len(features)
    cols = [*features, y]
    shift = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    rows = df.select(F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(folds)).cast("int").alias("__fold"), F.array(*[F.col(c).cast("double") - F.lit(shift[i]) for i, c in enumerate(cols)], F.lit(1.0)).alias("__row"))
    each = [gram(rows.where(F.col("__fold") == k), "__row", p + 2) for k in range(folds)]
    total = sum(each)

    def system(m):
        n = m[-1, -1]
        mean = m[-1, : p + 1] / n
        cov = m[: p + 1, : p + 1] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:p], 0) / n)
        scale = np.where(scale > 0, scale, 1.0)
        return n, mean, scale, cov[:p, :p] / np.outer(scale, scale), cov[:p, p] / scale

    n, _, _, _, c = system(total)
    grid = _grid(float(np.nextafter(np.abs(c).max() / (n * alpha), np.inf)), count, ratio)
    errors = np.zeros((folds, count))
    for k in range(folds):
        n, mean, scale, g, c = system(total - each[k])
        b = np.zeros(p)
        for i, penalty in enumerate(grid):
            b = _descend(g, c, n, penalty, alpha, b)
            beta = b / scale
            v = np.r_[-beta, 1.0, -(mean[p] - beta @ mean[:p])]
            errors[k, i] = v @ each[k] @ v / each[k][-1, -1]
    mse, se = errors.mean(0), errors.std(0, ddof=1) / np.sqrt(folds)
    best = int(mse.argmin())
    one_se = int(np.flatnonzero(mse <= mse[best] + se[best])[0])
    return {"penalties": grid, "mse": mse, "std_error": se, "lambda_min": float(grid[best]), "lambda_1se": float(grid[one_se])}


def bounded(df: DataFrame, features: list[str], y: str, lower: np.ndarray, upper: np.ndarray) -> dict:
    """Least squares within bounds, by an active set on the triangle of the rows."""
    p = len(features)
    r = tall_qr(_columns(df, features, y), "__row", p + 1)
    a, b = r[:, :p], r[:, p]
    lower, upper = np.asarray(lower, dtype=float), np.asarray(upper, dtype=float)
    x = np.clip(np.zeros(p), lower, upper)
    state = np.where(x <= lower, -1, np.where(x >= upper, 1, 0))
    for _ in range(30 * (p + 1)):
        g = a.T @ (b - a @ x)
        wants = np.where((state == -1) & (g > 1e-10) | (state == 1) & (g < -1e-10), np.abs(g), 0)
        if (state != 0).all() or not (state == 0).any():
            if not wants.any():
                break
        if wants.any():
            state[wants.argmax()] = 0
        while (state == 0).any():
            free = state == 0
            z = np.linalg.lstsq(a[:, free], b - a[:, ~free] @ x[~free], rcond=None)[0]
            lo, hi = lower[free], upper[free]
            if ((z >= lo) & (z <= hi)).all():
                x[free] = z
                break
            step = z - x[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(z < lo, (lo - x[free]) / step, np.where(z > hi, (hi - x[free]) / step, np.inf))
            k = int(np.nanargmin(room))
            x[free] = x[free] + min(1.0, max(0.0, room[k])) * step
            at = np.flatnonzero(free)[k]
            state[at] = -1 if z[k] < lo[k] else 1
            x[at] = lower[at] if state[at] == -1 else upper[at]
        g = a.T @ (b - a @ x)
        if not (((state == -1) & (g > 1e-9)) | ((state == 1) & (g < -1e-9))).any():
            break
    return {"beta": x, "active": state, "rss": float(((b - a @ x) ** 2).sum())}


def non_negative(df, features, y) -> dict:
    p = len(features)
    return bounded(df, features, y, np.zeros(p), np.full(p, np.inf))


@dataclass
class Standardization:
    mean: list[float]
    scale: list[float]
    columns: list[str]

    @classmethod
    def of(cls, df: DataFrame, columns: list[str], population: bool = False):
        f = F.stddev_pop if population else F.stddev_samp
        row = df.agg(*[F.avg(c) for c in columns], *[f(c) for c in columns]).first()
        k = len(columns)
        if any(v is None or not v > 0 or v == float("inf") for v in row[k:]):
            raise ValueError("a column is constant, too short or not finite")
        return cls(list(row[:k]), list(row[k:]), columns)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * s + m for c, m, s in zip(self.columns, self.mean, self.scale, strict=True)})

    def transform_row(self, row: list[float]) -> list[float]:
        return [(x - m) / s for x, m, s in zip(row, self.mean, self.scale, strict=True)]

    def inverse_row(self, row: list[float]) -> list[float]:
        return [x * s + m for x, m, s in zip(row, self.mean, self.scale, strict=True)]
