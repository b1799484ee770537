"""Numerical integration. Nodes are rows, an integrand is a column expression, and a
panel, or a whole frontier of panels, is one aggregation."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The 15 Kronrod nodes' upper half, and weights of Kronrod and Gauss.
NODES = (0.0, 0.207784955007898467600689403773245, 0.405845151377397166906606412076961, 0.586087235467691130294144691258259, 0.741531185599394439863864773280788, 0.864864423359769072789712788640926, 0.949107912342758524526189684047851, 0.991455371120812639206854697526329)
KRONROD = (0.209482141084727828012999174891714, 0.204432940075298892414161999234649, 0.190350578064785409913256402421014, 0.169004726639267902826583426598550, 0.140653259715525918745189590510238, 0.104790010322250183839876322541518, 0.063092092629978553290700663189204, 0.022935322010529224963732008058970)
GAUSS = (0.417959183673469387755102040816327, 0.0, 0.381830050505118944950369775488975, 0.0, 0.279705391489276667901467771423780, 0.0, 0.129484966168869693270611432679082, 0.0)


@dataclass
class Integral:
    value: float
    error: float
    evaluations: int
    converged: bool = True


def rule() -> list[tuple[float, float, float]]:
    """(node, Kronrod weight, Gauss weight) on [-1, 1]."""
    upper = list(zip(NODES, KRONROD, GAUSS, strict=True))
    return [(-x, k, g) for x, k, g in reversed(upper[1:])] + upper


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule(), "node double, kronrod double, gauss double")


def _names(d: int) -> list[str]:
    return ["x", "y", "z"][:d]


def _panels(spark: SparkSession, f: Callable[..., Column], boxes: list[list[tuple[float, float]]]) -> list[tuple[float, float]]:
    """Integral and error of each box: the rule's tensor grid over a table of boxes."""
    d = len(boxes[0])
    rows = [(n, *[v for lo, hi in b for v in (lo, hi)]) for n, b in enumerate(boxes)]
    table = spark.createDataFrame(rows, "panel long, " + ", ".join(f"lo{k} double, hi{k} double" for k in range(d))).repartition(max(1, min(len(boxes), spark.sparkContext.defaultParallelism)), "panel")
    wk, wg = F.lit(1.0), F.lit(1.0)
    for k, name in enumerate(_names(d)):
        grid = F.array(*[F.struct(F.lit(x).alias("t"), F.lit(a).alias("k"), F.lit(b).alias("g")) for x, a, b in rule()])
        half = (F.col(f"hi{k}") - F.col(f"lo{k}")) / 2
        table = table.withColumn(f"n{k}", F.explode(grid)).withColumn(name, (F.col(f"hi{k}") + F.col(f"lo{k}")) / 2 + half * F.col(f"n{k}.t"))
        wk, wg = wk * half * F.col(f"n{k}.k"), wg * half * F.col(f"n{k}.g")
    value = f(*[F.col(n) for n in _names(d)])
    got = table.groupBy("panel").agg(F.sum(wk * value).alias("k"), F.sum(wg * value).alias("g")).collect()  # a row for each panel
    out = [(0.0, 0.0)] * len(boxes)
    for r in got:
        out[r.panel] = (r.k, abs(r.k - r.g))
    return out


def gauss_kronrod(spark: SparkSession, f: Callable[..., Column], *limits: tuple[float, float]) -> Integral:
    """One panel in one, two or three dimensions."""
    (value, error), = _panels(spark, f, [list(limits)])
    return Integral(value, error, 15 ** len(limits))


def adaptive(spark: SparkSession, f: Callable[..., Column], *limits: tuple[float, float], tolerance: float = 1e-10, max_depth: int = 20, forced: int = 1, most_panels: int = 200_000) -> Integral:
    """Bisection of all axes of the panels whose error is above their share; one job a
    level, for the whole frontier. The first forced levels are always split."""
    frontier = [list(limits)]
    volume = math.prod(b - a for a, b in limits)
    total = error = 0.0
    evaluations = 0
    for depth in range(max_depth + 1):
        got = _panels(spark, f, frontier)
        evaluations += len(frontier) * 15 ** len(limits)
        split = []
        for box, (v, e) in zip(frontier, got, strict=True):
            share = abs(math.prod(b - a for a, b in box) / volume) if volume else 1.0
            if depth < max_depth and (depth < forced or not e <= tolerance * max(share, 1e-12)):
                split.append(box)
            else:
                total += v
                error += e
        if not split:
            return Integral(total, error, evaluations, error <= 10 * tolerance * max(1.0, abs(total)))
        frontier = [list(b) for box in split for b in product(*[((a, (a + c) / 2), ((a + c) / 2, c)) for a, c in box])]
        if len(frontier) > most_panels:
            raise ArithmeticError("too many panels")
    raise AssertionError


def chebyshev_weights(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Clenshaw-Curtis nodes and weights on [-1, 1], n even."""
    theta = np.pi * np.arange(n + 1) / n
    v = np.ones(n + 1)
    for k in range(1, n // 2):
        v -= 2 * np.cos(2 * k * theta) / (4 * k * k - 1)
    v -= np.cos(n * theta) / (n * n - 1)
    w = 2 * v / n
    w[[0, n]] = 1 / (n * n - 1)
    return np.cos(theta), w


def _rule_sum(spark: SparkSession, f: Callable[..., Column], axes: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """Sum of weights times f over the tensor grid of (nodes, weights) axes."""
    tables = [spark.createDataFrame(list(zip(x.tolist(), w.tolist(), strict=True)), f"{n} double, w{n} double") for n, (x, w) in zip(_names(len(axes)), axes, strict=True)]
    grid = tables[0]
    for t in tables[1:]:
        grid = grid.crossJoin(F.broadcast(t))  # rule nodes: a few hundred an axis
    w = math.prod([F.col(f"w{n}") for n in _names(len(axes))], start=F.lit(1.0))
    return grid.agg(F.sum(w * f(*[F.col(n) for n in _names(len(axes))])).alias("s")).first().s


#: Least and most nodes of the nested rule by dimension.
CC_RANGE = {1: (32, 2048), 2: (16, 256), 3: (8, 64)}


def clenshaw_curtis(spark: SparkSession, f: Callable[..., Column], *limits: tuple[float, float], tolerance: float = 1e-10, least: int | None = None, most: int | None = None) -> Integral:
    """Nested rule with doubling until two levels agree."""
    lo, hi = CC_RANGE[len(limits)]
    n, last, evaluations = least or lo, None, 0
    while True:
        x, w = chebyshev_weights(n)
        value = _rule_sum(spark, f, [((a + b) / 2 + (b - a) / 2 * x, (b - a) / 2 * w) for a, b in limits])
        evaluations += (n + 1) ** len(limits)
        if last is not None and abs(value - last) <= tolerance * max(1.0, abs(value)):
            return Integral(value, abs(value - last), evaluations)
        if 2 * n > (most or hi):
            return Integral(value, abs(value - last) if last is not None else math.inf, evaluations, False)
        n, last = 2 * n, value


def double_exponential(spark: SparkSession, f: Callable[[Column], Column], a: float, b: float, tolerance: float = 1e-12, least: int = 3, most: int = 12) -> Integral:
    """tanh-sinh on finite limits, exp-sinh and sinh-sinh on infinite ones: ends with
    singularities are never evaluated. Levels halve the step."""
    if a > b:
        got = double_exponential(spark, f, b, a, tolerance, least, most)
        return Integral(-got.value, got.error, got.evaluations, got.converged)
    last, evaluations = None, 0
    for level in range(least, most + 1):
        h = 2.0**-level
        t = np.arange(-int(6.5 / h), int(6.5 / h) + 1) * h
        u = np.pi / 2 * np.sinh(t)
        with np.errstate(all="ignore"):
            if math.isfinite(a) and math.isfinite(b):
                gap = (b - a) / (1 + np.exp(2 * np.abs(u)))  # distance from the nearer end
                x = np.where(t < 0, a + gap, b - gap)
                w = (b - a) / 2 * np.pi / 2 * np.cosh(t) / np.cosh(u) ** 2
            elif math.isfinite(a) or math.isfinite(b):
                e = np.exp(u)
                x = a + e if math.isfinite(a) else b - e
                w = np.pi / 2 * np.cosh(t) * e
            else:
                x, w = np.sinh(u), np.pi / 2 * np.cosh(t) * np.cosh(u)
        ok = np.isfinite(x) & np.isfinite(w) & (w > 0) & (x != a) & (x != b)
        value = _rule_sum(spark, lambda c: F.coalesce(F.when(F.isnan(f(c)) | (F.abs(f(c)) == float("inf")), 0.0).otherwise(f(c)), F.lit(0.0)), [(x[ok], w[ok] * h)])
        evaluations += int(ok.sum())
        if last is not None and abs(value - last) <= tolerance * max(1.0, abs(value)):
            return Integral(value, abs(value - last), evaluations)
        last, before = value, last
    return Integral(last, abs(last - before) if before is not None else math.inf, evaluations, False)


def infinite(spark: SparkSession, f: Callable[..., Column], *limits: tuple[float, float], tolerance: float = 1e-8, max_depth: int = 14) -> Integral:
    """Infinite limits by substitution of each axis onto [-1, 1] or [0, 1]."""
    boxes, maps = [], []
    for a, b in limits:
        if math.isinf(a) and math.isinf(b):
            boxes.append((-1.0, 1.0))
            maps.append((lambda t: t / (1 - t * t), lambda t: (1 + t * t) / F.pow(1 - t * t, 2)))
        elif math.isinf(b):
            boxes.append((0.0, 1.0))
            maps.append((lambda t, a=a: a + t / (1 - t), lambda t: 1 / F.pow(1 - t, 2)))
        elif math.isinf(a):
            boxes.append((0.0, 1.0))
            maps.append((lambda t, b=b: b - (1 - t) / t, lambda t: 1 / F.pow(t, 2)))
        else:
            boxes.append((a, b))
            maps.append((lambda t: t, lambda t: F.lit(1.0)))

    def inner(*ts):
        value = f(*[m(t) for (m, _), t in zip(maps, ts, strict=True)])
        weight = math.prod([w(t) for (_, w), t in zip(maps, ts, strict=True)], start=F.lit(1.0))
        out = value * weight
        return F.when(F.isnan(out), F.lit(0.0)).otherwise(out)

    got = adaptive(spark, inner, *boxes, tolerance=tolerance, max_depth=max_depth, forced=3 if len(limits) == 1 else 1)
    if not math.isfinite(got.value) or not got.converged:
        raise ArithmeticError("the integral did not settle")
    return got


def smart(spark: SparkSession, f: Callable[..., Column], *limits: tuple[float, float], tolerance: float = 1e-10) -> Integral:
    """Smooth integrands (an oscillation index under 0.05: sign changes of second
    differences on 64 points of the first axis) by the nested rule, others adaptively."""
    if any(math.isinf(v) for ab in limits for v in ab):
        return infinite(spark, f, *limits, tolerance=max(tolerance, 1e-8))
    (a, b), rest = limits[0], limits[1:]
    middle = [F.lit((lo + hi) / 2) for lo, hi in rest]
    xs = spark.createDataFrame([(i, a + (b - a) * (i + 0.5) / 64) for i in range(64)], "i int, x double")
    y = np.array([r.v for r in xs.select("i", f(F.col("x"), *middle).alias("v")).orderBy("i").collect()], dtype=float)
    bends = np.sign(np.diff(y, 2))
    if np.count_nonzero(bends[1:] * bends[:-1] < 0) / 62 < 0.05:
        got = clenshaw_curtis(spark, f, *limits, tolerance=tolerance)
        if got.converged:
            return got
    return adaptive(spark, f, *limits, tolerance=tolerance)
