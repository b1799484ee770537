"""Piecewise cubics of one and two variables.

A curve is a table of segments (x_lo, x_hi, k0..k3), a cubic in x - x_lo. Values at
points outside the knots are an error, as is NaN. Knots are strictly increasing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import as_of


def kruger(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Constrained spline (no overshoot): the inner slope is the harmonic mean of the
    neighbouring ones, 0 at turns; the ends follow. Windows over the knots of a series."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(x)
    d = df.select(*(keys or []), F.col(x).cast("double").alias("x_lo"), F.col(y).cast("double").alias("__y"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("x_lo")
    d = d.withColumns({"x_hi": F.lead("x_lo").over(w), "__y2": F.lead("__y").over(w)})
    d = d.withColumn("__s", (F.col("__y2") - F.col("__y")) / (F.col("x_hi") - F.col("x_lo")))
    d = d.withColumn("__before", F.lag("__s").over(w))
    a, b = F.col("__before"), F.col("__s")
    d = d.withColumn("__m", F.when(a.isNull() | b.isNull(), None).when(a * b <= 0, F.lit(0.0)).otherwise(2.0 / (1.0 / F.when(a == 0, 1.0).otherwise(a) + 1.0 / F.when(b == 0, 1.0).otherwise(b))))
    d = d.withColumn("__m2", F.lead("__m").over(w)).where(F.col("x_hi").isNotNull())
    first = F.coalesce("__m", 1.5 * b - F.coalesce(F.col("__m2"), b) / 2)
    last = F.coalesce("__m2", 1.5 * b - F.coalesce(F.col("__m"), b) / 2)
    return _hermite(d.withColumns({"__f": first, "__l": last}), keys)


def _hermite(d: DataFrame, keys: list[str] | None) -> DataFrame:
    h = F.col("x_hi") - F.col("x_lo")
    s, f, g = F.col("__s"), F.col("__f"), F.col("__l")
    return d.select(*(keys or []), "x_lo", "x_hi", F.col("__y").alias("k0"), f.alias("k1"), ((3 * s - 2 * f - g) / h).alias("k2"), ((f + g - 2 * s) / (h * h)).alias("k3"))


def natural_coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows k0..k3 of the C2 spline with no curvature at the ends."""
    n = len(x)
    h, s = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1) if n < 400 else None
        r = 6 * np.diff(s)
        m[1:-1] = np.linalg.solve(a, r) if a is not None else _thomas(h[1:-1], 2 * (h[:-1] + h[1:]), r)
    return np.column_stack([y[:-1], s - h * (2 * m[:-1] + m[1:]) / 6, m[:-1] / 2, np.diff(m) / (6 * h)])


def _thomas(off: np.ndarray, diag: np.ndarray, r: np.ndarray) -> np.ndarray:
    d, r = diag.astype(float).copy(), r.copy()
    for i in range(1, len(d)):
        f = off[i - 1] / d[i - 1]
        d[i] -= f * off[i - 1]
        r[i] -= f * r[i - 1]
    out = np.zeros(len(d))
    out[-1] = r[-1] / d[-1]
    for i in range(len(d) - 2, -1, -1):
        out[i] = (r[i] - off[i] * out[i + 1]) / d[i]
    return out


def akima_coefficients(x: np.ndarray, y: np.ndarray, modified: bool = False) -> np.ndarray:
    """Local cubics from weighted neighbouring slopes, two extrapolated at each end."""
    s = np.diff(y) / np.diff(x)
    if len(s) == 1:
        return np.array([[y[0], s[0], 0.0, 0.0]])
    e = np.concatenate([[3 * s[0] - 2 * s[1], 2 * s[0] - s[1]], s, [2 * s[-1] - s[-2], 3 * s[-1] - 2 * s[-2]]])
    gap, middle = np.abs(np.diff(e)), np.abs(e[1:] + e[:-1]) / 2
    w = gap + middle if modified else gap
    left, right = w[2:], w[:-2]
    total = left + right
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.where(total > 1e-9 * max(total.max(), 1e-300), (left * e[1:-2] + right * e[2:-1]) / total, 0.0 if modified else (e[1:-2] + e[2:-1]) / 2)
    h = np.diff(x)
    return np.column_stack([y[:-1], m[:-1], (3 * s - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * s) / h**2])


def kruger_coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    s = np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    with np.errstate(divide="ignore"):
        m[1:-1] = np.where(s[:-1] * s[1:] > 0, 2 / (1 / np.where(s[:-1] == 0, 1, s[:-1]) + 1 / np.where(s[1:] == 0, 1, s[1:])), 0.0)
    m[0] = 1.5 * s[0] - (m[1] if len(s) > 1 else s[0]) / 2
    m[-1] = 1.5 * s[-1] - (m[-2] if len(s) > 1 else s[-1]) / 2
    h = np.diff(x)
    return np.column_stack([y[:-1], m[:-1], (3 * s - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * s) / h**2])


SCHEMES = {"natural": natural_coefficients, "kruger": kruger_coefficients, "akima": akima_coefficients, "akima_modified": lambda x, y: akima_coefficients(x, y, True)}


def spline(df: DataFrame, x: str, y: str, keys: list[str], scheme: str = "natural") -> DataFrame:
    """Segments of each key's series, whose knots one task holds."""
    part = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(x)
        xs, ys = b[x].to_numpy(dtype=float), b[y].to_numpy(dtype=float)
        if len(xs) < 2 or (np.diff(xs) <= 0).any():
            raise ValueError("knots must increase strictly, two at least")
        k = SCHEMES[scheme](xs, ys)
        return pd.DataFrame({**dict(zip(keys, ([v] * len(k) for v in key), strict=True)), "x_lo": xs[:-1], "x_hi": xs[1:], "k0": k[:, 0], "k1": k[:, 1], "k2": k[:, 2], "k3": k[:, 3]})

    return df.select(*keys, x, y).groupBy(*keys).applyInPandas(run, f"{part}, x_lo double, x_hi double, k0 double, k1 double, k2 double, k3 double")


def horner(t: Column, order: int = 0) -> Column:
    k = [F.col(f"k{i}") for i in range(4)]
    if order == 0:
        return k[0] + t * (k[1] + t * (k[2] + t * k[3]))
    return k[1] + t * (2 * k[2] + t * 3 * k[3]) if order == 1 else 2 * k[2] + 6 * k[3] * t


def evaluate(segments: DataFrame, queries: DataFrame, x: str, order: int = 0, name: str = "value") -> DataFrame:
    """The curve's value (order 0), slope (1) or curvature (2) at each query."""
    found = as_of(queries, segments, x, "x_lo", ["x_hi", "k0", "k1", "k2", "k3"])
    out = F.col("x_lo_found").isNull() | F.isnan(F.col(x).cast("double")) | (F.col(x) > F.col("x_hi"))
    value = F.when(out, F.raise_error(F.lit("outside the knots")).cast("double")).otherwise(horner(F.col(x) - F.col("x_lo_found"), order))
    return found.select(*queries.columns, value.alias(name))


def integrate(segments: DataFrame, a: float, b: float) -> DataFrame:
    """One row: the exact integral from a to b, signed."""
    lo, hi = min(a, b), max(a, b)

    def anti(t):
        return t * (F.col("k0") + t * (F.col("k1") / 2 + t * (F.col("k2") / 3 + t * F.col("k3") / 4)))

    t1, t2 = F.greatest(F.lit(lo), F.col("x_lo")) - F.col("x_lo"), F.least(F.lit(hi), F.col("x_hi")) - F.col("x_lo")
    inside = segments.where((F.col("x_hi") > lo) & (F.col("x_lo") < hi))
    return inside.agg((F.lit(1.0 if a <= b else -1.0) * F.coalesce(F.sum(anti(t2) - anti(t1)), F.lit(0.0))).alias("integral"))


def segment_count(segments: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return segments.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("segments"))


# Surfaces: cells (x_lo, x_hi, y_lo, y_hi, c array of 16: powers of x by rows)


def bilinear_cells(grid: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Cells from grid rows (i, j, x, y, z): each cell joins its four corners by index."""
    g = grid.select("i", "j", F.col(x).alias("x_lo"), F.col(y).alias("y_lo"), F.col(z).alias("z00"))
    at = lambda di, dj, cols: grid.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), *cols)
    c = g.join(at(1, 0, [F.col(x).alias("x_hi"), F.col(z).alias("z10")]), ["i", "j"]).join(at(0, 1, [F.col(y).alias("y_hi"), F.col(z).alias("z01")]), ["i", "j"]).join(at(1, 1, [F.col(z).alias("z11")]), ["i", "j"])
    h, k = F.col("x_hi") - F.col("x_lo"), F.col("y_hi") - F.col("y_lo")
    zero = F.lit(0.0)
    coefficients = [F.col("z00"), (F.col("z01") - F.col("z00")) / k, zero, zero, (F.col("z10") - F.col("z00")) / h, (F.col("z11") - F.col("z10") - F.col("z01") + F.col("z00")) / (h * k), *[zero] * 10]
    return c.select("i", "j", "x_lo", "x_hi", "y_lo", "y_hi", F.array(*coefficients).alias("c"))


def bicubic_coefficients(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Tensor natural spline: (nx-1, ny-1, 4, 4)."""
    along = np.array([natural_coefficients(y, row) for row in z])
    out = np.zeros((len(x) - 1, len(y) - 1, 4, 4))
    for j in range(len(y) - 1):
        for q in range(4):
            out[:, j, :, q] = natural_coefficients(x, along[:, j, q])
    return out


def bicubic_cells(spark, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> DataFrame:
    c = bicubic_coefficients(x, y, z)
    rows = [(i, j, float(x[i]), float(x[i + 1]), float(y[j]), float(y[j + 1]), c[i, j].ravel().tolist()) for i in range(len(x) - 1) for j in range(len(y) - 1)]
    return spark.createDataFrame(rows, "i int, j int, x_lo double, x_hi double, y_lo double, y_hi double, c array<double>")


def surface_value(cells: DataFrame, queries: DataFrame, x: str, y: str, dx: int = 0, dy: int = 0, name: str = "value") -> DataFrame:
    """Value or a first derivative at points. Each axis is an as-of lookup against its
    distinct edges; the cells then join by their corner."""
    edge = lambda lo, hi: cells.select(lo, hi).distinct()
    a = as_of(queries, edge("x_lo", "x_hi"), x, "x_lo", ["x_hi"]).withColumnRenamed("x_hi", "__xh").withColumnRenamed("x_lo_found", "__xl")
    b = as_of(a, edge("y_lo", "y_hi"), y, "y_lo", ["y_hi"]).withColumnRenamed("y_hi", "__yh").withColumnRenamed("y_lo_found", "__yl")
    c = b.join(cells.select(F.col("x_lo").alias("__xl"), F.col("y_lo").alias("__yl"), "c"), ["__xl", "__yl"], "left")
    u, v = F.col(x) - F.col("__xl"), F.col(y) - F.col("__yl")
    power = lambda t, k, d: F.lit(1.0 if k == 0 else 0.0) if d and k == 0 else (k * F.pow(t, k - 1) if d else F.pow(t, k)) if k else F.lit(1.0)
    zero = F.lit(0.0)
    terms = [F.col("c")[4 * p + q] * (zero if dx and not p else power(u, p, dx)) * (zero if dy and not q else power(v, q, dy)) for p in range(4) for q in range(4)]
    out = F.col("c").isNull() | (F.col(x) > F.col("__xh")) | (F.col(y) > F.col("__yh"))
    return c.select(*queries.columns, F.when(out, F.raise_error(F.lit("outside the grid")).cast("double")).otherwise(sum(terms[1:], terms[0])).alias(name))


def surface_integral(cells: DataFrame, ax: float, bx: float, ay: float, by: float) -> DataFrame:
    """One row: the exact integral over a rectangle, signed."""
    xl, xh, yl, yh = min(ax, bx), max(ax, bx), min(ay, by), max(ay, by)
    sign = (1 if ax <= bx else -1) * (1 if ay <= by else -1)
    span = lambda lo, hi, a, b: (F.greatest(F.lit(a), F.col(lo)) - F.col(lo), F.least(F.lit(b), F.col(hi)) - F.col(lo))
    u1, u2 = span("x_lo", "x_hi", xl, xh)
    v1, v2 = span("y_lo", "y_hi", yl, yh)
    part = lambda s, t, k: (F.pow(t, k + 1) - F.pow(s, k + 1)) / (k + 1)
    terms = [F.col("c")[4 * p + q] * part(u1, u2, p) * part(v1, v2, q) for p in range(4) for q in range(4)]
    inside = cells.where((F.col("x_hi") > xl) & (F.col("x_lo") < xh) & (F.col("y_hi") > yl) & (F.col("y_lo") < yh))
    return inside.agg((float(sign) * F.coalesce(F.sum(sum(terms[1:], terms[0])), F.lit(0.0))).alias("integral"))


def curve(x: np.ndarray, k: np.ndarray, q: float) -> float:
    i = min(max(int(np.searchsorted(x, q, "right")) - 1, 0), len(k) - 1)
    if not x[0] <= q <= x[-1]:
        raise ValueError("outside the knots")
    t = q - x[i]
    return float(k[i, 0] + t * (k[i, 1] + t * (k[i, 2] + t * k[i, 3])))


def successive(queries: DataFrame, px: str, py: str, x: np.ndarray, y: np.ndarray, z: np.ndarray, scheme: str = "natural", name: str = "value") -> DataFrame:
    """For each query, curves along x for every y, then one along y through their values."""
    rows = [SCHEMES[scheme](x, z[:, j]) for j in range(len(y))]

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([curve(y, SCHEMES[scheme](y, np.array([curve(x, k, p) for k in rows])), q) for p, q in zip(a, b, strict=True)])

    return queries.withColumn(name, run(px, py))
