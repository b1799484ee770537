"""Roots, nonlinear systems, and optimisation.

Small problems run in NumPy on the driver or, by the row or group, inside pandas
UDFs. Where the objective is a sum over a table, sum_objective() makes its value and
gradient one aggregation, and every optimiser takes it as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = np.finfo(float).eps


@dataclass
class Result:
    point: np.ndarray
    value: float
    iterations: int
    converged: bool
    why: str = ""
    extra: dict | None = None


# Roots


def brent_dekker(f: Callable[[np.ndarray], np.ndarray], a, b, tolerance: float = 1e-12, most: int = 150) -> np.ndarray:
    """Roots in brackets, all elements at once: inverse quadratic or secant steps where
    they stay inside, halving elsewhere. The signs of the bracket aren't checked."""
    a, b = (np.array(v, dtype=float) for v in np.broadcast_arrays(a, b))
    fa, fb = f(a), f(b)
    c, fc = a.copy(), fa.copy()
    d = e = b - a
    for _ in range(most):
        swap = np.abs(fc) < np.abs(fb)
        a, b, c = np.where(swap, b, a), np.where(swap, c, b), np.where(swap, b, c)
        fa, fb, fc = np.where(swap, fb, fa), np.where(swap, fc, fb), np.where(swap, fb, fc)
        tol = 2 * EPS * np.abs(b) + tolerance / 2
        m = (c - b) / 2
        done = (np.abs(m) <= tol) | (fb == 0)
        if done.all():
            break
        with np.errstate(all="ignore"):
            s = fb / fa
            q1, r = fa / fc, fb / fc
            p = np.where(a == c, 2 * m * s, s * (2 * m * q1 * (q1 - r) - (b - a) * (r - 1)))
            q = np.where(a == c, 1 - s, (q1 - 1) * (r - 1) * (s - 1))
            q = np.where(p > 0, -q, q)
            p = np.abs(p)
            good = (np.abs(e) >= tol) & (np.abs(fa) > np.abs(fb)) & (2 * p < np.minimum(3 * m * q - np.abs(tol * q), np.abs(e * q)))
            step = np.where(good, p / q, m)
        e = np.where(good, d, m)
        d = step
        a, fa = np.where(done, a, b), np.where(done, fa, fb)
        b = np.where(done, b, b + np.where(np.abs(d) > tol, d, np.sign(m) * tol))
        fb = np.where(done, fb, f(b))
        flip = ~done & (np.sign(fb) == np.sign(fc))
        c, fc = np.where(flip, a, c), np.where(flip, fa, fc)
        d, e = np.where(flip, b - a, d), np.where(flip, b - a, e)
    return b


def root_column(f: Callable[[np.ndarray, np.ndarray], np.ndarray], parameter: Column, a: float, b: float, tolerance: float = 1e-12) -> Column:
    """For each row the root in x of f(x, parameter) between a and b."""

    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        v = p.to_numpy(dtype=float)
        return pd.Series(brent_dekker(lambda x: f(x, v), np.full(len(v), a), np.full(len(v), b), tolerance))

    return run(parameter)


def gradient(f: Callable[[np.ndarray], float], x: np.ndarray) -> np.ndarray:
    """Forward differences."""
    x = np.asarray(x, dtype=float)
    f0 = f(x)
    out = np.zeros(len(x))
    for i in range(len(x)):
        h = np.sqrt(EPS) * max(1.0, abs(x[i]))
        y = x.copy()
        y[i] += h
        out[i] = (f(y) - f0) / (y[i] - x[i])
    return out


def jacobian(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    f0 = np.asarray(f(x), dtype=float)
    out = np.zeros((len(f0), len(x)))
    for i in range(len(x)):
        h = np.sqrt(EPS) * max(1.0, abs(x[i]))
        y = x.copy()
        y[i] += h
        out[:, i] = (np.asarray(f(y), dtype=float) - f0) / (y[i] - x[i])
    return out


def newton(f: Callable, start, jac: Callable | None = None, tolerance: float = 1e-10, most: int = 200) -> Result:
    """Damped Newton: a step is halved until the residual falls."""
    x = np.array(start, dtype=float)
    r = np.asarray(f(x), dtype=float)
    for k in range(most):
        size = np.linalg.norm(r)
        if size <= tolerance:
            return Result(x, size, k, True, "residual")
        step = np.linalg.lstsq(jac(x) if jac else jacobian(f, x), -r, rcond=None)[0]
        t = 1.0
        while t > 1e-10:
            y = x + t * step
            ry = np.asarray(f(y), dtype=float)
            if np.isfinite(ry).all() and np.linalg.norm(ry) < size:
                break
            t /= 2
        else:
            return Result(x, size, k, False, "no descent")
        x, r = y, ry
    return Result(x, float(np.linalg.norm(r)), most, False, "iterations")


def broyden(f: Callable, start, jac: Callable | None = None, tolerance: float = 1e-10, most: int = 400) -> Result:
    """Rank-one updates of the Jacobian, made anew when a step fails."""
    x = np.array(start, dtype=float)
    r = np.asarray(f(x), dtype=float)
    make = lambda p: jac(p) if jac else jacobian(f, p)
    b, fresh = make(x), True
    for k in range(most):
        size = np.linalg.norm(r)
        if size <= tolerance:
            return Result(x, size, k, True, "residual")
        step = np.linalg.lstsq(b, -r, rcond=None)[0]
        t = 1.0
        while t > 1e-8:
            y = x + t * step
            ry = np.asarray(f(y), dtype=float)
            if np.isfinite(ry).all() and np.linalg.norm(ry) < size:
                break
            t /= 2
        else:
            if fresh:
                return Result(x, size, k, False, "no descent")
            b, fresh = make(x), True
            continue
        s = y - x
        b = b + np.outer(ry - r - b @ s, s) / (s @ s)
        x, r, fresh = y, ry, False
    return Result(x, float(np.linalg.norm(r)), most, False, "iterations")


# Objectives over tables


def sum_objective(df: DataFrame, columns: list[str], f: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray]], dimension: int) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """w -> (value, gradient) of a sum over rows: f(w, block of rows) is added up in each
    task, and the tasks' sums by position: dimension + 1 numbers come to the driver."""

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        held = df.sparkSession.sparkContext.broadcast(np.asarray(w, dtype=float))

        def run(batches):
            total = np.zeros(dimension + 1)
            for b in batches:
                if len(b):
                    v, g = f(held.value, b.to_numpy(dtype=float))
                    total[0] += v
                    total[1:] += g
            yield pd.DataFrame({"p": np.arange(dimension + 1), "v": total})

        rows = df.select(*columns).mapInPandas(run, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(dimension + 1)
        for r in rows:
            out[r.p] = r.v
        held.unpersist()
        return float(out[0]), out[1:]

    return evaluate


def logistic_likelihood(w: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Log-likelihood and gradient of the last column (0 or 1) on the others."""
    z, y = x[:, :-1] @ w, x[:, -1]
    return float((y * z - np.logaddexp(0, z)).sum()), x[:, :-1].T @ (y - 1 / (1 + np.exp(-z)))


def line_fit(b: pd.DataFrame) -> Result:
    """Least squares of the second column on the first, by residuals."""
    x, y = (b[c].to_numpy(dtype=float) for c in b.columns[-2:])
    return levenberg_marquardt(lambda p: p[0] + p[1] * x - y, [0.0, 0.0])


# Gradient methods


def _two_loop(g: np.ndarray, s: list, y: list) -> np.ndarray:
    q = g.copy()
    a = []
    for u, v in zip(reversed(s), reversed(y), strict=True):
        k = (u @ q) / (u @ v)
        a.append(k)
        q -= k * v
    if s:
        q *= (s[-1] @ y[-1]) / (y[-1] @ y[-1])
    for u, v, k in zip(s, y, reversed(a), strict=True):
        q += u * (k - (v @ q) / (u @ v))
    return q


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start, maximize: bool = True, l1: float = 0.0, memory: int = 4, tolerance: float = 1e-4, gradient_tolerance: float = 1e-3, most: int = 1000, watch: Callable[[np.ndarray, float, int], bool] | None = None) -> Result:
    """Limited-memory quasi-Newton ascent (descent with maximize=False). With l1 the
    orthant-wise form: |w| l1 is subtracted and steps keep to an orthant. watch gets the
    point, the value and the step's number, and tells whether to go on."""
    sign = -1.0 if maximize else 1.0

    def cost(w):
        v, g = f(w)
        return sign * v, sign * np.asarray(g, dtype=float)

    def pseudo(w, g):
        if not l1:
            return g
        out = g + l1 * np.sign(w)
        zero = w == 0
        out[zero] = np.where(g[zero] + l1 < 0, g[zero] + l1, np.where(g[zero] - l1 > 0, g[zero] - l1, 0.0))
        return out

    x = np.array(start, dtype=float)
    v, g = cost(x)
    total = v + l1 * np.abs(x).sum()
    s_list: list[np.ndarray] = []
    y_list: list[np.ndarray] = []
    why, k = "iterations", 0
    for k in range(1, most + 1):
        pg = pseudo(x, g)
        if np.abs(pg).max(initial=0) <= gradient_tolerance * max(1.0, 0.0) and np.linalg.norm(pg) <= gradient_tolerance:
            why = "gradient"
            break
        d = -_two_loop(pg, s_list, y_list)
        if l1:
            d = np.where(d * pg < 0, d, 0.0)
        if d @ pg >= 0:
            d, s_list, y_list = -pg, [], []
        orthant = np.where(x != 0, np.sign(x), -np.sign(pg)) if l1 else None
        t = 1.0 if s_list else min(1.0, 1.0 / max(np.abs(pg).sum(), 1e-300))
        for _ in range(50):
            z = x + t * d
            if l1:
                z = np.where(z * orthant > 0, z, 0.0)
            vz, gz = cost(z)
            tz = vz + l1 * np.abs(z).sum()
            if np.isfinite(tz) and tz <= total + 1e-4 * (pg @ (z - x)):
                break
            t /= 2
        else:
            why = "line search"
            break
        s, y = z - x, gz - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            s_list, y_list = [*s_list, s][-memory:], [*y_list, y][-memory:]
        small = 2 * abs(total - tz) <= tolerance * (abs(total) + abs(tz) + 1e-10)
        x, v, g, total = z, vz, gz, tz
        if small:
            why = "value"
            break
        if watch and not watch(x, sign * total, k):
            why = "stopped"
            break
    return Result(x, sign * total, k, why in ("gradient", "value"), why)


def conjugate_gradient(f: Callable[[np.ndarray], float], start, grad: Callable | None = None, maximize: bool = False, tolerance: float = 1e-10, most: int = 500) -> Result:
    """Polak-Ribiere directions with a derivative-free line search."""
    sign = -1.0 if maximize else 1.0
    value = lambda w: sign * f(w)
    slope = (lambda w: sign * np.asarray(grad(w), dtype=float)) if grad else (lambda w: gradient(value, w))
    x = np.array(start, dtype=float)
    v, g = value(x), slope(x)
    d = -g
    for k in range(most):
        if np.linalg.norm(g) <= tolerance:
            return Result(x, sign * v, k, True, "gradient")
        if d @ g >= 0:
            d = -g
        line = lambda t, x=x, d=d: value(x + t * d)
        step = 1.0 / max(np.linalg.norm(d), 1.0)
        got = line_minimize(line, *bracket(line, 0.0, step))
        y = x + got.point[0] * d
        vy = got.value
        if not vy < v:
            return Result(x, sign * v, k, np.linalg.norm(g) < 1e-4 * max(1.0, abs(v)), "no descent")
        done = 2 * abs(v - vy) <= tolerance * (abs(v) + abs(vy) + 1e-20)
        gy = slope(y)
        beta = max(0.0, gy @ (gy - g) / (g @ g))
        x, v, g, d = y, vy, gy, -gy + beta * d
        if done:
            return Result(x, sign * v, k + 1, True, "value")
    return Result(x, sign * v, most, False, "iterations")


def nelder_mead(f: Callable[[np.ndarray], float], start, step=None, tolerance: float = 1e-12, most: int = 20_000, restarts: int = 1) -> Result:
    """Simplex with coefficients by dimension, restarted once at the best point."""
    x = np.array(start, dtype=float)
    n = len(x)
    width = np.array(step, dtype=float) if step is not None else np.where(x != 0, 0.05 * np.abs(x), 0.00025)
    grow, shrink, inside = 1 + 2 / n, 1 - 1 / n if n > 1 else 0.5, 0.75 - 1 / (2 * n)
    used = 0
    ok = False
    for _ in range(restarts + 1):
        p = np.vstack([x, x + np.diag(width)])
        v = np.array([f(q) for q in p])
        ok = False
        while used < most:
            used += 1
            o = np.argsort(v, kind="stable")
            p, v = p[o], v[o]
            if abs(v[-1] - v[0]) <= tolerance * (abs(v[0]) + abs(v[-1]) + 1e-30) and np.abs(p - p[0]).max() <= 1e-8 * max(1.0, np.abs(p[0]).max()):
                ok = True
                break
            c = p[:-1].mean(0)
            r = c + (c - p[-1])
            fr = f(r)
            if fr < v[0]:
                e = c + grow * (c - p[-1])
                fe = f(e)
                p[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < v[-2]:
                p[-1], v[-1] = r, fr
            else:
                q = c + inside * ((r if fr < v[-1] else p[-1]) - c)
                fq = f(q)
                if fq < min(fr, v[-1]):
                    p[-1], v[-1] = q, fq
                else:
                    p[1:] = p[0] + max(shrink, 0.5) * (p[1:] - p[0])
                    v[1:] = [f(q) for q in p[1:]]
        x = p[v.argmin()]
        width = np.where(x != 0, 0.05 * np.abs(x), 0.00025)
    return Result(x, float(f(x)), used, ok, "simplex" if ok else "iterations")


def bracket(f: Callable[[float], float], a: float, b: float) -> tuple[float, float, float]:
    """a, b, c around a minimum, by golden growth."""
    fa, fb = f(a), f(b)
    if fb > fa:
        a, b, fa, fb = b, a, fb, fa
    c = b + 1.618034 * (b - a)
    fc = f(c)
    for _ in range(200):
        if not fc < fb:
            break
        a, b, c, fb = b, c, c + 1.618034 * (c - b), fc
        fc = f(c)
    return a, b, c


def _slope_zero(f: Callable[[float], float], slope: Callable[[float], float], lo: float, hi: float, tolerance: float, most: int) -> Result:
    """Where the slope changes from falling to rising: secants, and a bisection wherever
    a step didn't halve the interval."""
    a, b = slope(lo), slope(hi)
    for end, g, outward in ((lo, a, a >= 0), (hi, b, b <= 0)):
        if outward:  # the least value of the interval is at this end, or the slope is 0 there
            return Result(np.array([end]), f(end), 0, g == 0)
    halve, k = False, 0
    for k in range(1, most + 1):
        width = hi - lo
        x = (lo + hi) / 2 if halve else min(max(lo - a * width / (b - a), lo), hi)
        if width <= tolerance * max(1.0, abs(x)):
            return Result(np.array([x]), f(x), k, True)
        g = slope(x)
        if g == 0:
            return Result(np.array([x]), f(x), k, True)
        lo, hi, a, b = (lo, x, a, g) if g > 0 else (x, hi, g, b)
        halve = not halve and hi - lo > width / 2
    return Result(np.array([(lo + hi) / 2]), f((lo + hi) / 2), k, False)


def line_minimize(f: Callable[[float], float], a: float, b: float, c: float, tolerance: float = 1e-10, most: int = 200, slope: Callable[[float], float] | None = None) -> Result:
    """Minimum in a bracket: parabolic steps, golden ones where they fail; with slope,
    secant steps to the derivative's zero."""
    lo, hi = min(a, c), max(a, c)
    if slope is not None:
        return _slope_zero(f, slope, lo, hi, tolerance, most)
    x = w = v = b
    fx = fw = fv = f(b)
    d = e = 0.0
    for k in range(most):
        m = (lo + hi) / 2
        t = tolerance * abs(x) + 1e-14
        if abs(x - m) <= 2 * t - (hi - lo) / 2:
            return Result(np.array([x]), fx, k, True)
        r, q = (x - w) * (fx - fv), (x - v) * (fx - fw)
        p, q = (x - v) * q - (x - w) * r, 2 * (q - r)
        p, q = (-p, q) if q > 0 else (p, -q)
        if abs(e) > t and abs(p) < abs(q * e / 2) and q * (lo - x) < p < q * (hi - x):
            e, d = d, p / q
        else:
            e = (hi if x < m else lo) - x
            d = 0.381966 * e
        u = x + (d if abs(d) >= t else np.copysign(t, d))
        fu = f(u)
        if fu <= fx:
            lo, hi = (x, hi) if u >= x else (lo, x)
            v, w, x, fv, fw, fx = w, x, u, fw, fx, fu
        else:
            lo, hi = (u, hi) if u < x else (lo, u)
            if fu <= fw or w == x:
                v, w, fv, fw = w, u, fw, fu
            elif fu <= fv or v in (x, w):
                v, fv = u, fu
    return Result(np.array([x]), fx, most, False)


def levenberg_marquardt(f: Callable, start, jac: Callable | None = None, lower=None, upper=None, tolerance: float = 1e-14, most: int = 1000) -> Result:
    """Least squares of residuals f, also within bounds (steps are clipped, bound
    coordinates whose gradient points outwards are held); covariance and standard
    errors in extra."""
    x = np.array(start, dtype=float)
    lo = np.full(len(x), -np.inf) if lower is None else np.asarray(lower, dtype=float)
    hi = np.full(len(x), np.inf) if upper is None else np.asarray(upper, dtype=float)
    x = np.clip(x, lo, hi)
    make = lambda p: np.asarray(jac(p) if jac else jacobian(f, p), dtype=float)
    r = np.asarray(f(x), dtype=float)
    cost = r @ r
    scale = np.zeros(len(x))
    damp, why, k = 1e-3, "iterations", 0
    j = make(x)
    for k in range(1, most + 1):
        g = j.T @ r
        free = ~((x <= lo) & (g > 0) | (x >= hi) & (g < 0))
        scale = np.maximum(scale, np.sqrt((j * j).sum(0)))
        if not free.any() or np.abs(g[free]).max() <= 1e-300:
            why = "gradient"
            break
        s = np.where(scale > 0, scale, 1.0)
        for _ in range(60):
            a = np.vstack([j[:, free], np.diag(np.sqrt(damp) * s[free])])
            step = np.zeros(len(x))
            step[free] = np.linalg.lstsq(a, np.concatenate([-r, np.zeros(int(free.sum()))]), rcond=None)[0]
            y = np.clip(x + step, lo, hi)
            ry = np.asarray(f(y), dtype=float)
            if np.isfinite(ry).all() and ry @ ry < cost:
                break
            damp = max(damp * 4, 1e-12)
        else:
            why = "no descent"
            break
        fall, move = cost - ry @ ry, np.linalg.norm(s * (y - x))
        x, r, cost, damp = y, ry, ry @ ry, damp / 9
        j = make(x)
        if fall <= tolerance * cost and move <= 1e-9 * max(np.linalg.norm(s * x), 1e-300) or cost == 0:
            why = "value"
            break
    left = len(r) - len(x)
    cov = np.linalg.pinv(j.T @ j) * (cost / left) if left > 0 else np.full((len(x), len(x)), np.nan)
    return Result(x, float(cost), k, why != "iterations", why, {"covariance": cov, "std_error": np.sqrt(np.maximum(np.diag(cov), 0)), "residuals": r})


def projected_gradient(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start, project: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-8, most: int = 2000, memory: int = 10) -> Result:
    """Spectral projected gradient on a convex set, given by its projection."""
    x = project(np.array(start, dtype=float))
    v, g = f(x)
    last, step = [v], 1.0
    best = (v, x)
    for k in range(most):
        if np.abs(project(x - g) - x).max(initial=0) <= tolerance:
            return Result(x, v, k, True, "gradient")
        d = project(x - step * g) - x
        slope, t = g @ d, 1.0
        for _ in range(60):
            y = x + t * d
            vy, gy = f(y)
            if vy <= max(last[-memory:]) + 1e-4 * t * slope:
                break
            t /= 2
        s, u = y - x, gy - g
        step = float(np.clip((s @ s) / (s @ u), 1e-10, 1e10)) if s @ u > 0 else 1e10
        x, v, g = y, vy, gy
        last.append(v)
        best = min(best, (v, x), key=lambda p: p[0])
    return Result(best[1], best[0], most, False, "iterations")


def box(lower, upper) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: np.clip(x, lower, upper)


def simplex(total: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    def project(x):
        d = np.sort(x)[::-1]
        t = (np.cumsum(d) - total) / np.arange(1, len(d) + 1)
        return np.maximum(x - t[np.flatnonzero(d - t > 0)[-1]], 0)

    return project


def ball(radius: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x if np.linalg.norm(x) <= radius else x * radius / np.linalg.norm(x)


def l1_ball(radius: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: x if np.abs(x).sum() <= radius else np.sign(x) * simplex(radius)(np.abs(x))


def by_group(df: DataFrame, keys: list[str], columns: list[str], fit: Callable[[pd.DataFrame], Result], names: list[str]) -> DataFrame:
    """An optimisation for each group: keys, names (the point), value, converged."""
    part = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)

    def run(key, b: pd.DataFrame) -> pd.DataFrame:
        r = fit(b)
        return pd.DataFrame([[*key, *map(float, r.point), float(r.value), bool(r.converged)]], columns=[*keys, *names, "value", "converged"])

    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, f"{part}, " + ", ".join(f"{n} double" for n in names) + ", value double, converged boolean")
