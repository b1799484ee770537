"""Activation functions and derivatives as built-in expressions.

gelu is the tanh approximation. Beyond the cut-offs a function is its limit, as
double arithmetic rounds it. single(f) is the float form of a function.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of the tanh form of gelu, and cut-offs of the limits.
ROOT = math.sqrt(2 / math.pi)
CUBE = 0.044715
GELU_CUT, GELU_SLOPE_CUT, SWISH_CUT = 4.861, 7.446, 17.0
MISH_LOW, MISH_HIGH = -8.0, 16.0


def relu(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), x).otherwise(F.lit(0.0))


def relu_slope(x: Column) -> Column:
    return F.when((x > 0) & ~F.isnan(x), F.lit(1.0)).otherwise(F.lit(0.0))


def gelu(x: Column) -> Column:
    inner = ROOT * (x + CUBE * x * x * x)
    return F.when(x < -GELU_CUT, F.lit(-0.0)).when((x > GELU_CUT) & ~F.isnan(x), x).otherwise(0.5 * x * (1.0 + F.tanh(inner)))


def gelu_slope(x: Column) -> Column:
    inner = ROOT * (x + CUBE * x * x * x)
    t = F.tanh(inner)
    slope = 0.5 * (1.0 + t) + 0.5 * x * sech2(inner) * ROOT * (1.0 + 3 * CUBE * x * x)
    return F.when(x < -GELU_SLOPE_CUT, F.lit(0.0)).when((x > GELU_SLOPE_CUT) & ~F.isnan(x), F.lit(1.0)).otherwise(slope)


def mish(x: Column) -> Column:
    return F.when(x < MISH_LOW, x * F.exp(x)).when((x > MISH_HIGH) & ~F.isnan(x), x).otherwise(x * F.tanh(F.log1p(F.exp(x))))


def mish_slope(x: Column) -> Column:
    e = F.exp(x)
    t = F.tanh(F.log1p(e))
    slope = t + x * (1.0 - t * t) * e / (1.0 + e)
    return F.when(x < MISH_LOW, (1.0 + x) * F.exp(x)).when((x > MISH_HIGH) & ~F.isnan(x), F.lit(1.0)).otherwise(slope)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def swish(x: Column) -> Column:
    return F.when(x < -SWISH_CUT, x * F.exp(x)).when((x > SWISH_CUT) & ~F.isnan(x), x).otherwise(x * sigmoid(x))


def swish_slope(x: Column) -> Column:
    s = sigmoid(x)
    return F.when(x < -SWISH_CUT, (1.0 + x) * F.exp(x)).when((x > SWISH_CUT) & ~F.isnan(x), F.lit(1.0)).otherwise(s + x * s * (1.0 - s))


def sech2(x: Column) -> Column:
    return F.pow(1.0 / F.cosh(F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))), 2)


def cosh(x: Column) -> Column:
    return F.cosh(x)


def tanh(x: Column) -> Column:
    return F.tanh(x)


def single(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: f(x.cast("double")).cast("float")
