"""Special functions over NumPy arrays: error function, log-gamma, incomplete gamma
and beta, and their inverses. The distributions' pandas UDFs use them."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np

def _erfc_fit(terms: int = 40) -> np.ndarray:
    """Chebyshev coefficients, in t = 2 / (2 + x), of ln(exp(x^2) erfc(x) / t) for x from 0 to 6."""
    lo = 2 / (2 + 6.0)
    u = np.cos(np.pi * (np.arange(terms) + 0.5) / terms)
    t = (1 + lo) / 2 + (1 - lo) / 2 * u
    x = 2 / t - 2
    y = np.array([v * v + math.log(math.erfc(v)) for v in x]) - np.log(t)
    c = 2 / terms * np.cos(np.pi * np.outer(np.arange(terms), np.arange(terms) + 0.5) / terms) @ y
    c[0] /= 2
    return c


_ERFC = _erfc_fit()


def erfc(x) -> np.ndarray:
    """A Chebyshev fit up to 6, beyond it the continued fraction."""
    x = np.asarray(x, dtype=float)
    z = np.abs(x)
    lo = 2 / (2 + 6.0)
    near = np.minimum(np.where(np.isnan(z), 0, z), 6.0)
    t = 2 / (2 + near)
    out = t * np.exp(-near * near + np.polynomial.chebyshev.chebval((t - (1 + lo) / 2) / ((1 - lo) / 2), _ERFC))
    far = np.minimum(np.where(z > 6, z, 6.0), 30.0)
    f = far.copy()
    for k in range(40, 0, -1):
        f = far + k / 2 / f
    out = np.where(z > 6, np.exp(-far * far) / (f * math.sqrt(math.pi)), out)
    out = np.where(x < 0, 2 - out, out)
    return np.where(np.isnan(x), np.nan, np.where(z > 28, np.where(x < 0, 2.0, 0.0), out))


def erf(x) -> np.ndarray:
    """1 - erfc, and the series of Kummer's function where that cancels."""
    x = np.asarray(x, dtype=float)
    z = np.where(np.abs(x) < 0.5, x, 0.0)
    term = total = np.ones_like(z)
    for k in range(1, 20):
        term = term * z * z / (k + 0.5)
        total = total + term
    return np.where(np.abs(x) < 0.5, 2 / math.sqrt(math.pi) * z * np.exp(-z * z) * total, 1 - erfc(x))


def _lgamma(x) -> np.ndarray:
    """ln |gamma|: reflection below 0.5, a shift to 10 and Stirling's series."""
    x = np.asarray(x, dtype=float)
    low = x < 0.5
    v = np.where(low, 1 - x, x)
    shift, product = np.where(np.isfinite(v), v, 10.0), np.ones_like(v)
    for _ in range(10):
        small = shift < 10
        product = np.where(small, product * shift, product)
        shift = np.where(small, shift + 1, shift)
    r = 1 / (shift * shift)
    tail = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * (691 / 360360 - r / 156)))))) / shift
    with np.errstate(all="ignore"):
        out = (shift - 0.5) * np.log(shift) - shift + 0.5 * math.log(2 * math.pi) + tail - np.log(product)
        # lgamma vanishes at 1 and 2, where the parts above cancel.
        for root in (1.0, 2.0):
            e = v - root
            out = np.where(np.abs(e) < 1e-4, _near_root(e, root), out)
        whole = np.floor(x) == x
        out = np.where(low, math.log(math.pi) - np.log(np.abs(np.sin(np.pi * (x - np.floor(x))))) - out, out)
    return np.where(np.isnan(x), np.nan, np.where(np.isinf(x) | ((x <= 0) & whole), np.inf, out))


#: Euler's constant, zeta(2) to zeta(4).
EULER, ZETA2, ZETA3, ZETA4 = 0.57721566490153286, 1.6449340668482264, 1.2020569031595943, 1.0823232337111382


def _near_root(e: np.ndarray, root: float) -> np.ndarray:
    at_one = e * (-EULER + e * (ZETA2 / 2 + e * (-ZETA3 / 3 + e * ZETA4 / 4)))
    return at_one if root == 1 else at_one + np.log1p(e)


_inv = NormalDist().inv_cdf


def lgamma(x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    if x.size > 1 and (x == x.flat[0]).all():  # a parameter, spread over the rows
        return np.full(x.shape, _lgamma(x.flat[0]))
    return _lgamma(x)


def normal_cdf(x) -> np.ndarray:
    return 0.5 * erfc(-np.asarray(x, dtype=float) / math.sqrt(2))


def normal_quantile(p) -> np.ndarray:
    p = np.asarray(p, dtype=float)
    out = np.full(p.shape, np.nan)
    out[p <= 0], out[p >= 1] = -np.inf, np.inf
    mid = (p > 0) & (p < 1)
    out[mid] = [_inv(v) for v in p[mid]]
    return out


def gamma_p(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma: a series below a + 1, else a continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.where(np.isnan(x), np.nan, np.where(x <= 0, 0.0, 1.0))
    live = (x > 0) & np.isfinite(x)
    low, high = live & (x < a + 1), live & (x >= a + 1)
    if low.any():
        aa, xx = a[low], x[low]
        term = 1 / aa
        total, k = term.copy(), aa.copy()
        for _ in range(10_000):
            k = k + 1
            term = term * xx / k
            total += term
            if (np.abs(term) < np.abs(total) * 1e-17).all():
                break
        out[low] = total * np.exp(-xx + aa * np.log(xx) - lgamma(aa))
    if high.any():
        aa, xx = a[high], x[high]
        tiny = 1e-300
        b = xx + 1 - aa
        c = np.full(xx.shape, 1 / tiny)
        d = 1 / np.where(b == 0, tiny, b)
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - aa)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h *= step
            if (np.abs(step - 1) < 5e-16).all():
                break
        out[high] = 1 - np.exp(-xx + aa * np.log(xx) - lgamma(aa)) * h
    return np.clip(out, 0, 1)


def beta_i(a, b, x) -> np.ndarray:
    """Regularised incomplete beta, by Lentz's continued fraction."""
    a, b, x = (v.astype(float) for v in np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(b, dtype=float), np.asarray(x, dtype=float)))
    out = np.where(np.isnan(x), np.nan, np.where(x <= 0, 0.0, 1.0))
    live = (x > 0) & (x < 1)
    if not live.any():
        return out
    a, b, x = a[live], b[live], x[live]
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / p
    tiny = 1e-300
    c = np.ones(y.shape)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 20_000):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if (np.abs(d * c - 1) < 5e-16).all():
            break
    got = front * h
    out[live] = np.clip(np.where(swap, 1 - got, got), 0, 1)
    return out


def invert(cdf: Callable[[np.ndarray], np.ndarray], p: np.ndarray, low: float, high: float, start: float) -> np.ndarray:
    """x with cdf(x) = p for 0 < p < 1, by bracketing and bisection to the last bits.
    low and high may be infinite."""
    p = np.asarray(p, dtype=float)
    lo = np.full(p.shape, low if np.isfinite(low) else start - 1.0)
    hi = np.full(p.shape, high if np.isfinite(high) else start + 1.0)
    step = max(1.0, abs(start))
    for _ in range(1100):
        short = (cdf(hi) < p) & (hi < high)
        if not short.any():
            break
        hi = np.where(short, np.minimum(hi + step, high), hi)
        step *= 2
    step = max(1.0, abs(start))
    for _ in range(1100):
        long = (cdf(lo) > p) & (lo > low)
        if not long.any():
            break
        lo = np.where(long, np.maximum(lo - step, low), lo)
        step *= 2
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        under = cdf(mid) < p
        lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        if (hi - lo <= 4e-16 * np.maximum(np.abs(lo), np.abs(hi))).all():
            break
    return lo + (hi - lo) / 2
