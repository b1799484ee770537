"""Discrete Fourier transforms. dft() is relational, for one long series; fft() runs
in NumPy on series that are array values (any length)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


def dft(df: DataFrame, x: str, pos: str, n: int, frequencies: int | None = None, inverse: bool = False, im: str | None = None) -> DataFrame:
    """k, re, im of a series of n rows; sums are partial in each task, a row for each
    frequency. The angle is reduced in whole numbers."""
    sign = 1.0 if inverse else -1.0
    each = df.select(F.col(pos).cast("long").alias("__p"), F.col(x).cast("double").alias("__r"), (F.col(im).cast("double") if im else F.lit(0.0)).alias("__i"))
    rows = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit((frequencies or n) - 1))))
    angle = sign * 2 * np.pi * F.pmod(F.col("__p") * F.col("k"), F.lit(n)) / n
    scale = 1.0 / n if inverse else 1.0
    return rows.groupBy("k").agg((F.sum(F.col("__r") * F.cos(angle) - F.col("__i") * F.sin(angle)) * scale).alias("re"), (F.sum(F.col("__r") * F.sin(angle) + F.col("__i") * F.cos(angle)) * scale).alias("im"))


def series_fft(df: DataFrame, x: str, pos: str, n: int, inverse: bool = False, im: str | None = None) -> DataFrame:
    """k, re, im of a series of n rows with positions 0 to n - 1, as dft() in n log n steps.

    n = a b, a the largest divisor up to the root: the b strided series of a values are
    transformed, turned, and the a series of b values they make are transformed. A
    task holds one of these, n values if n is prime.
    """
    a = max(d for d in range(1, math.isqrt(n) + 1) if n % d == 0)
    b = n // a
    sign = 1 if inverse else -1
    start = df.select(F.col(pos).cast("long").alias("p"), *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c else F.lit(0.0)).alias(o) for c, o in ((x, "re"), (im, "im"))])

    def transformed(z: np.ndarray) -> np.ndarray:
        return np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)

    def strided(g: pd.DataFrame) -> pd.DataFrame:  # positions p = b q + r of one r
        z = np.zeros(a, dtype=complex)
        p = g["p"].to_numpy()
        np.add.at(z, p // b, g["re"].to_numpy() + 1j * g["im"].to_numpy())
        r, k = int(p[0] % b), np.arange(a)
        z = transformed(z) * np.exp(sign * 2j * np.pi * (r * k % n) / n)
        return pd.DataFrame({"k": k, "r": r, "re": z.real, "im": z.imag})

    def crossed(g: pd.DataFrame) -> pd.DataFrame:  # frequencies k + a m of one k
        z = np.zeros(b, dtype=complex)
        z[g["r"].to_numpy()] = g["re"].to_numpy() + 1j * g["im"].to_numpy()
        z = transformed(z) / (n if inverse else 1)
        return pd.DataFrame({"k": int(g["k"].iloc[0]) + a * np.arange(b), "re": z.real, "im": z.imag})

    first = start.groupBy(F.pmod("p", F.lit(b)).alias("r")).applyInPandas(strided, "k long, r long, re double, im double")
    return first.groupBy("k").applyInPandas(crossed, "k long, re double, im double")


_COMPLEX = "struct<re:array<double>,im:array<double>>"


def _clean(z: np.ndarray) -> np.ndarray:
    """Magnitudes of no more than rounding noise are 0."""
    cut = 4 * len(z) * EPS
    re, im = z.real.copy(), z.imag.copy()
    re[np.abs(re) <= cut], im[np.abs(im) <= cut] = 0.0, 0.0
    return re + 1j * im


def fft(re: Column, im: Column | None = None) -> Column:
    """Forward transform, not normalised, of array columns."""

    @F.pandas_udf(_COMPLEX)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [_clean(np.fft.fft(np.asarray(x, dtype=float) + 1j * np.asarray(y, dtype=float))) if len(x) else np.zeros(0, dtype=complex) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})

    return run(re, im if im is not None else F.transform(re, lambda _: F.lit(0.0)))


def ifft(c: Column) -> Column:
    """Inverse transform with 1/n."""

    @F.pandas_udf(_COMPLEX)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = [np.fft.ifft(np.asarray(x, dtype=float) + 1j * np.asarray(y, dtype=float)) if len(x) else np.zeros(0, dtype=complex) for x, y in zip(a, b, strict=True)]
        return pd.DataFrame({"re": [z.real for z in out], "im": [z.imag for z in out]})

    return run(c["re"], c["im"])


def power(c: Column) -> Column:
    return F.zip_with(c["re"], c["im"], lambda x, y: x * x + y * y)


def power_scaled(c: Column) -> Column:
    return F.transform(power(c), lambda p: p / F.size(c["re"]))


def shift(a: Column) -> Column:
    """Frequency 0 goes to the centre."""
    n = F.size(a)
    cut = F.ceil(n / 2).cast("int")
    return F.concat(F.slice(a, cut + 1, n - cut), F.slice(a, F.lit(1), cut))


def unshift(a: Column) -> Column:
    n = F.size(a)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.slice(a, cut + 1, n - cut), F.slice(a, F.lit(1), cut))


def complex_dot(a: Column, b: Column) -> Column:
    """sum a b, without conjugation: struct(re, im)."""
    fold = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    p = complex_product(a, b)
    return F.struct(fold(p["re"]).alias("re"), fold(p["im"]).alias("im"))


def complex_product(a: Column, b: Column) -> Column:
    times = lambda x, y: F.zip_with(x, y, lambda u, v: u * v)
    re = F.zip_with(times(a["re"], b["re"]), times(a["im"], b["im"]), lambda x, y: x - y)
    im = F.zip_with(times(a["re"], b["im"]), times(a["im"], b["re"]), lambda x, y: x + y)
    return F.struct(re.alias("re"), im.alias("im"))
