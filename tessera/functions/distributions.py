"""Probability distributions as column expressions.

Parameters are validated and become literals. Densities and everything with a
closed form are built-in expressions; the incomplete gamma and beta functions are
Arrow-batched pandas UDFs. Quantiles of probabilities <= 0 or >= 1 are the ends
of the support; a discrete quantile outside [0, 1] is an error.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

NAN, INF = float("nan"), float("inf")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _udf(f):
    """A double pandas UDF of a NumPy function."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(dtype=float, na_value=np.nan)
        return pd.Series(f(v)).where(x.notna() | np.isnan(v), None)

    return run


class Continuous:
    """Methods take and return columns; the parameters are plain numbers."""

    low, high = -INF, INF

    def pdf(self, x: Column) -> Column:
        raise NotImplementedError

    def cdf_np(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def cdf(self, x: Column) -> Column:
        return _udf(self.cdf_np)(x)

    def start(self) -> float:
        m = self.mean()
        return m if math.isfinite(m) else 1.0

    def quantile_np(self, p: np.ndarray) -> np.ndarray:
        out = np.where(p <= 0, self.low, np.where(p >= 1, self.high, np.nan))
        mid = (p > 0) & (p < 1)
        if mid.any():
            out[mid] = special.invert(self.cdf_np, p[mid], self.low, self.high, self.start())
        return out

    def inverse_cdf(self, p: Column) -> Column:
        return _udf(self.quantile_np)(p)

    def probability(self, x0: Column, x1: Column) -> Column:
        return F.when(x0 > x1, F.raise_error(F.lit("x0 > x1")).cast("double")).otherwise(self.cdf(x1) - self.cdf(x0))

    def mean(self) -> float:
        raise NotImplementedError

    def variance(self) -> float:
        raise NotImplementedError

    def support_lower_bound(self) -> float:
        return self.low

    def support_upper_bound(self) -> float:
        return self.high

    def _ends(self, p: Column, inner: Column) -> Column:
        return F.when(p <= 0, F.lit(float(self.low))).when((p >= 1) & ~F.isnan(p), F.lit(float(self.high))).otherwise(inner)


@dataclass(frozen=True)
class Beta(Continuous):
    alpha: float
    beta: float
    low, high = 0.0, 1.0

    def __post_init__(self):
        _need(self.alpha > 0 and self.beta > 0, "alpha and beta must be positive")

    def pdf(self, x):
        a, b = self.alpha, self.beta
        log_b = math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
        inside = (x > 0) & (x < 1)
        y = F.when(inside, x).otherwise(F.lit(0.5))
        return F.when(inside, F.exp((a - 1) * F.ln(y) + (b - 1) * F.log1p(-y) - log_b)).otherwise(F.lit(0.0))

    def cdf_np(self, x):
        return special.beta_i(self.alpha, self.beta, x)

    def mean(self):
        return self.alpha / (self.alpha + self.beta)

    def variance(self):
        s = self.alpha + self.beta
        return self.alpha * self.beta / (s * s * (s + 1))


@dataclass(frozen=True)
class Cauchy(Continuous):
    location: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _need(self.scale > 0, "scale must be positive")

    def pdf(self, x):
        z = (x - self.location) / self.scale
        return 1.0 / (math.pi * self.scale * (1.0 + z * z))

    def cdf(self, x):
        return 0.5 + F.atan((x - self.location) / self.scale) / math.pi

    def inverse_cdf(self, p):
        return self._ends(p, self.location + self.scale * F.tan(math.pi * (p - 0.5)))

    def mean(self):
        return NAN

    def variance(self):
        return NAN


@dataclass(frozen=True)
class Gamma(Continuous):
    shape: float
    scale: float = 1.0
    low = 0.0

    def __post_init__(self):
        _need(self.shape > 0 and self.scale > 0, "shape and scale must be positive")

    def pdf(self, x):
        k, t = self.shape, self.scale
        y = F.when(x > 0, x).otherwise(F.lit(1.0))
        return F.when(x > 0, F.exp((k - 1) * F.ln(y) - y / t - math.lgamma(k) - k * math.log(t))).otherwise(F.lit(0.0))

    def cdf_np(self, x):
        return special.gamma_p(self.shape, x / self.scale)

    def mean(self):
        return self.shape * self.scale

    def variance(self):
        return self.shape * self.scale**2


@dataclass(frozen=True)
class ChiSquare(Continuous):
    degrees: float
    low = 0.0

    def __post_init__(self):
        _need(self.degrees > 0, "degrees of freedom must be positive")

    def pdf(self, x):
        return Gamma(self.degrees / 2, 2.0).pdf(x)

    def cdf_np(self, x):
        return np.where(x > 100 * self.degrees, 1.0, special.gamma_p(self.degrees / 2, x / 2))

    def mean(self):
        return self.degrees

    def variance(self):
        return 2 * self.degrees


@dataclass(frozen=True)
class Exponential(Continuous):
    rate: float = 1.0
    low = 0.0

    def __post_init__(self):
        _need(self.rate > 0, "rate must be positive")

    def pdf(self, x):
        return F.when(x < 0, F.lit(0.0)).otherwise(self.rate * F.exp(-self.rate * x))

    def cdf(self, x):
        return F.when(x <= 0, F.lit(0.0)).when(self.rate * x >= 100, F.lit(1.0)).otherwise(-F.expm1(-self.rate * x))

    def inverse_cdf(self, p):
        return self._ends(p, -F.log1p(-F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))) / self.rate)

    def mean(self):
        return 1 / self.rate

    def variance(self):
        return 1 / self.rate**2


@dataclass(frozen=True)
class FisherF(Continuous):
    d1: int
    d2: int
    low = 0.0

    def __post_init__(self):
        _need(self.d1 > 0 and self.d2 > 0, "degrees of freedom must be positive")

    def pdf(self, x):
        a, b = self.d1 / 2, self.d2 / 2
        log_c = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(self.d1 / self.d2)
        y = F.when(x > 0, x).otherwise(F.lit(1.0))
        return F.when(x > 0, F.exp(log_c + (a - 1) * F.ln(y) - (a + b) * F.log1p(y * self.d1 / self.d2))).otherwise(F.lit(0.0))

    def cdf_np(self, x):
        y = np.maximum(x, 0) * self.d1
        return np.where(np.isinf(x) & (x > 0), 1.0, special.beta_i(self.d1 / 2, self.d2 / 2, np.where(np.isinf(y), 1.0, y / (y + self.d2))))

    def start(self):
        return 1.0

    def mean(self):
        return self.d2 / (self.d2 - 2) if self.d2 > 2 else NAN

    def variance(self):
        d1, d2 = self.d1, self.d2
        return 2 * d2 * d2 * (d1 + d2 - 2) / (d1 * (d2 - 2) ** 2 * (d2 - 4)) if d2 > 4 else NAN


@dataclass(frozen=True)
class Normal(Continuous):
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        _need(self.sigma > 0, "standard deviation must be positive")

    def pdf(self, x):
        z = (x - self.mu) / self.sigma
        return F.exp(-0.5 * z * z) / (self.sigma * math.sqrt(2 * math.pi))

    def cdf_np(self, x):
        return special.normal_cdf((x - self.mu) / self.sigma)

    def quantile_np(self, p):
        return self.mu + self.sigma * special.normal_quantile(p)

    def mean(self):
        return self.mu

    def variance(self):
        return self.sigma**2


@dataclass(frozen=True)
class LogNormal(Continuous):
    mu: float = 0.0
    sigma: float = 1.0
    low = 0.0

    def __post_init__(self):
        _need(self.sigma > 0, "sigma must be positive")

    def pdf(self, x):
        y = F.when(x > 0, x).otherwise(F.lit(1.0))
        z = (F.ln(y) - self.mu) / self.sigma
        return F.when(x > 0, F.exp(-0.5 * z * z) / (y * self.sigma * math.sqrt(2 * math.pi))).otherwise(F.lit(0.0))

    def cdf_np(self, x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, special.normal_cdf((np.log(np.where(x > 0, x, 1.0)) - self.mu) / self.sigma), np.where(np.isnan(x), np.nan, 0.0))

    def quantile_np(self, p):
        return np.exp(self.mu + self.sigma * special.normal_quantile(p))

    def mean(self):
        return math.exp(self.mu + self.sigma**2 / 2)

    def variance(self):
        return math.expm1(self.sigma**2) * math.exp(2 * self.mu + self.sigma**2)


@dataclass(frozen=True)
class StudentT(Continuous):
    df: float

    def __post_init__(self):
        _need(self.df > 0, "degrees of freedom must be positive")

    def pdf(self, x):
        v = self.df
        log_c = math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi)
        return F.exp(log_c - (v + 1) / 2 * F.log1p(x * x / v))

    def cdf_np(self, x):
        with np.errstate(over="ignore", invalid="ignore"):
            tail = 0.5 * special.beta_i(self.df / 2, 0.5, np.where(np.isinf(x), 0.0, self.df / (self.df + x * x)))
        return np.where(np.isnan(x), np.nan, np.where(x > 0, 1 - tail, tail))

    def start(self):
        return 0.0

    def mean(self):
        return 0.0 if self.df > 1 else NAN

    def variance(self):
        return self.df / (self.df - 2) if self.df > 2 else INF if self.df == 2 else NAN


@dataclass(frozen=True)
class Uniform(Continuous):
    a: float = 0.0
    b: float = 1.0

    def __post_init__(self):
        _need(self.b > self.a, "b must be greater than a")

    @property
    def low(self):
        return self.a

    @property
    def high(self):
        return self.b

    def pdf(self, x):
        return F.when(F.isnan(x), F.lit(NAN)).when((x >= self.a) & (x <= self.b), F.lit(1 / (self.b - self.a))).otherwise(F.lit(0.0))

    def cdf(self, x):
        return F.when(F.isnan(x), F.lit(NAN)).when(x <= self.a, F.lit(0.0)).when(x >= self.b, F.lit(1.0)).otherwise((x - self.a) / (self.b - self.a))

    def inverse_cdf(self, p):
        return self._ends(p, self.a + p * (self.b - self.a))

    def mean(self):
        return self.a + (self.b - self.a) / 2

    def variance(self):
        return (self.b - self.a) ** 2 / 12


@dataclass(frozen=True)
class Weibull(Continuous):
    scale: float = 1.0
    shape: float = 1.0
    low = 0.0

    def __post_init__(self):
        _need(self.scale > 0 and self.shape > 0, "scale and shape must be positive")

    def pdf(self, x):
        y = F.when(x > 0, x).otherwise(F.lit(1.0)) / self.scale
        return F.when(x > 0, self.shape / self.scale * F.pow(y, self.shape - 1) * F.exp(-F.pow(y, self.shape))).otherwise(F.lit(0.0))

    def cdf(self, x):
        return F.when(x <= 0, F.lit(0.0)).otherwise(-F.expm1(-F.pow(F.greatest(x, F.lit(0.0)) / self.scale, self.shape)))

    def inverse_cdf(self, p):
        q = F.when((p > 0) & (p < 1), p).otherwise(F.lit(0.5))
        return self._ends(p, self.scale * F.pow(-F.log1p(-q), 1 / self.shape))

    def mean(self):
        return self.scale * math.gamma(1 + 1 / self.shape)

    def variance(self):
        return self.scale**2 * (math.gamma(1 + 2 / self.shape) - math.gamma(1 + 1 / self.shape) ** 2)


class Discrete:
    low, high = 0, 2**31 - 1

    def log_pmf_np(self, k: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pmf_np(self, k):
        with np.errstate(all="ignore"):
            out = np.exp(self.log_pmf_np(np.clip(k, self.low, self.high)))
        return np.where((k < self.low) | (k > self.high), 0.0, out)

    def cdf_np(self, k: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pmf(self, k: Column) -> Column:
        return _udf(self.pmf_np)(k.cast("double"))

    def cdf(self, k: Column) -> Column:
        return _udf(self.cdf_np)(k.cast("double"))

    def probability(self, k0: Column, k1: Column) -> Column:
        return F.when(k0 > k1, F.raise_error(F.lit("k0 > k1")).cast("double")).otherwise(self.cdf(k1) - self.cdf(k0))

    def quantile_np(self, p: np.ndarray) -> np.ndarray:
        """The smallest k with cdf(k) >= p: galloping, then bisection."""
        if ((p < 0) | (p > 1)).any():
            raise ValueError("probability outside [0, 1]")
        lo = np.full(p.shape, float(self.low - 1))
        hi = np.full(p.shape, min(float(self.high), float(self.low) + 16))
        while True:
            short = (self.cdf_np(hi) < p) & (hi < self.high)
            if not short.any():
                break
            lo, hi = np.where(short, hi, lo), np.where(short, np.minimum(hi + 2 * (hi - self.low) + 16, self.high), hi)
        while (hi - lo > 1).any():
            mid = np.floor((lo + hi) / 2)
            under = self.cdf_np(mid) < p
            lo, hi = np.where(under, mid, lo), np.where(under, hi, mid)
        return hi

    def quantile(self, p: Column) -> Column:
        return _udf(self.quantile_np)(p).cast("int")

    def mean(self) -> float:
        raise NotImplementedError

    def variance(self) -> float:
        raise NotImplementedError

    def support_lower_bound(self) -> int:
        return self.low

    def support_upper_bound(self) -> int:
        return self.high


@dataclass(frozen=True)
class Binomial(Discrete):
    n: int
    p: float

    def __post_init__(self):
        _need(self.n >= 0 and 0 <= self.p <= 1, "n >= 0 and 0 <= p <= 1")

    @property
    def high(self):
        return self.n

    def log_pmf_np(self, k):
        if self.p in (0.0, 1.0):
            return np.where(k == self.n * self.p, 0.0, -np.inf)
        return special.lgamma(self.n + 1) - special.lgamma(k + 1) - special.lgamma(self.n - k + 1) + k * math.log(self.p) + (self.n - k) * math.log1p(-self.p)

    def cdf_np(self, k):
        k = np.floor(k)
        inner = special.beta_i(np.maximum(self.n - k, 1e-9), np.maximum(k + 1, 1e-9), np.full(k.shape, 1 - self.p))
        return np.where(k < 0, 0.0, np.where(k >= self.n, 1.0, inner))

    def mean(self):
        return self.n * self.p

    def variance(self):
        return self.n * self.p * (1 - self.p)


@dataclass(frozen=True)
class DiscreteUniform(Discrete):
    a: int
    b: int

    def __post_init__(self):
        _need(self.b >= self.a, "b >= a")

    @property
    def low(self):
        return self.a

    @property
    def high(self):
        return self.b

    @property
    def count(self):
        return self.b - self.a + 1

    def pmf(self, k):
        return F.when((k >= self.a) & (k <= self.b), F.lit(1.0 / self.count)).otherwise(F.lit(0.0))

    def cdf(self, k):
        return F.when(k < self.a, F.lit(0.0)).when(k >= self.b, F.lit(1.0)).otherwise((k - self.a + 1) / F.lit(float(self.count)))

    def quantile(self, p):
        ok = (p >= 0) & (p <= 1)
        return F.when(~ok, F.raise_error(F.lit("probability outside [0, 1]")).cast("int")).otherwise(F.greatest(F.lit(self.a), (self.a - 1 + F.ceil(p * self.count)).cast("int")))

    def mean(self):
        return (self.a + self.b) / 2

    def variance(self):
        return (self.count**2 - 1) / 12


@dataclass(frozen=True)
class Geometric(Discrete):
    """Failures before the first success."""

    p: float

    def __post_init__(self):
        _need(0 < self.p <= 1, "0 < p <= 1")

    def _log_q(self) -> float:
        return math.log1p(-self.p) if self.p < 1 else -745.0

    def pmf(self, k):
        return F.when(k < 0, F.lit(0.0)).otherwise(self.p * F.exp(k * self._log_q()))

    def cdf(self, k):
        return F.when(k < 0, F.lit(0.0)).otherwise(-F.expm1((k + 1) * self._log_q()))

    def quantile(self, p):
        ok = (p >= 0) & (p <= 1)
        inner = F.ceil(F.log1p(-F.when(p < 1, p).otherwise(F.lit(0.5))) / self._log_q() - 1)
        fixed = F.when((inner > 0) & (self.cdf(inner - 1) >= p), inner - 1).when(self.cdf(inner) < p, inner + 1).otherwise(inner)
        return F.when(~ok, F.raise_error(F.lit("probability outside [0, 1]")).cast("int")).when(p >= 1, F.lit(2**31 - 1)).otherwise(F.greatest(F.lit(0), F.least(fixed, F.lit(2**31 - 1))).cast("int"))

    def mean(self):
        return (1 - self.p) / self.p

    def variance(self):
        return (1 - self.p) / self.p**2


@dataclass(frozen=True)
class Hypergeometric(Discrete):
    population: int
    successes: int
    draws: int

    def __post_init__(self):
        _need(0 <= self.successes <= self.population and 0 <= self.draws <= self.population, "successes and draws within the population")

    @property
    def low(self):
        return max(0, self.draws + self.successes - self.population)

    @property
    def high(self):
        return min(self.draws, self.successes)

    def log_pmf_np(self, k):
        choose = lambda n, r: special.lgamma(np.asarray(n) + 1.0) - special.lgamma(np.asarray(r) + 1.0) - special.lgamma(np.asarray(n) - r + 1.0)
        return choose(self.successes, k) + choose(self.population - self.successes, self.draws - k) - choose(self.population, self.draws)

    def cdf_np(self, k):
        ks = np.arange(self.low, self.high + 1, dtype=float)
        up = np.cumsum(self.pmf_np(ks))
        at = np.clip(np.floor(np.nan_to_num(k)) - self.low, 0, len(ks) - 1).astype(int)
        return np.where(k < self.low, 0.0, np.where(k >= self.high, 1.0, np.minimum(up[at], 1.0)))

    def mean(self):
        return self.draws * self.successes / self.population if self.population else 0.0

    def variance(self):
        n, m, d = self.population, self.successes, self.draws
        return d * (m / n) * (1 - m / n) * (n - d) / (n - 1) if n > 1 else 0.0


@dataclass(frozen=True)
class NegativeBinomial(Discrete):
    """Failures before the r-th success."""

    r: int
    p: float

    def __post_init__(self):
        _need(self.r > 0 and 0 < self.p <= 1, "r > 0 and 0 < p <= 1")

    def log_pmf_np(self, k):
        if self.p == 1:
            return np.where(k == 0, 0.0, -np.inf)
        return special.lgamma(k + self.r) - special.lgamma(k + 1) - special.lgamma(self.r) + self.r * math.log(self.p) + k * math.log1p(-self.p)

    def cdf_np(self, k):
        k = np.floor(k)
        return np.where(k < 0, 0.0, special.beta_i(self.r, np.maximum(k + 1, 1e-9), np.full(k.shape, self.p)))

    def mean(self):
        return self.r * (1 - self.p) / self.p

    def variance(self):
        return self.r * (1 - self.p) / self.p**2


@dataclass(frozen=True)
class Poisson(Discrete):
    rate: float

    def __post_init__(self):
        _need(self.rate > 0, "rate must be positive")

    def log_pmf_np(self, k):
        return k * math.log(self.rate) - self.rate - special.lgamma(k + 1)

    def cdf_np(self, k):
        k = np.floor(k)
        return np.where(k < 0, 0.0, 1 - special.gamma_p(np.maximum(k + 1, 1e-9), np.full(k.shape, self.rate)))

    def mean(self):
        return self.rate

    def variance(self):
        return self.rate
