"""Element access, edits, arithmetic and norms on array<double> columns.

Positions of list functions are 0-based. Comparison is by value as in IEEE
arithmetic: NaN equals nothing and -0.0 equals 0.0. All are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def same(x: Column, v: Column) -> Column:
    return (x == v) & ~F.isnan(x) & ~F.isnan(v)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once for the row however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# Access and edits


def contains(a: Column, v) -> Column:
    return F.exists(a, lambda x: same(x, _c(v)))


def index_of(a: Column, v) -> Column:
    """First position, -1 if absent."""
    hits = F.filter(F.transform(a, lambda x, i: F.when(same(x, _c(v)), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.array_min(hits)).otherwise(F.lit(-1))


def last_index_of(a: Column, v) -> Column:
    hits = F.filter(F.transform(a, lambda x, i: F.when(same(x, _c(v)), i)), lambda i: i.isNotNull())
    return F.when(F.size(hits) > 0, F.array_max(hits)).otherwise(F.lit(-1))


def get(a: Column, k) -> Column:
    """Element k; an error outside the list."""
    k = _c(k)
    return F.when((k < 0) | (k >= F.size(a)), F.raise_error(F.lit("index out of bounds")).cast("double")).otherwise(F.get(a, k))


def set_at(a: Column, k, v) -> Column:
    return F.transform(a, lambda x, i: F.when(i == _c(k), _c(v)).otherwise(x))


def append(a: Column, v) -> Column:
    return F.array_append(a, _c(v))


def insert_at(a: Column, k: int, v) -> Column:
    return F.concat(F.slice(a, 1, k), F.array(_c(v)), F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))))


def insert_all(a: Column, k: int, b: Column) -> Column:
    return F.concat(F.slice(a, 1, k), b, F.slice(a, k + 1, F.greatest(F.size(a) - k, F.lit(0))))


def remove_at(a: Column, k) -> Column:
    return F.filter(a, lambda x, i: i != _c(k))


def remove_value(a: Column, v) -> Column:
    """Without the first equal element."""
    at = index_of(a, v)
    return F.filter(a, lambda x, i: i != at)


def keep(a: Column, predicate: Callable[[Column], Column]) -> Column:
    return F.filter(a, predicate)


def clear() -> Column:
    return F.array().cast("array<double>")


def size(a: Column) -> Column:
    return F.size(a)


def is_empty(a: Column) -> Column:
    return F.size(a) == 0


def sub_list(a: Column, begin: int, end: int) -> Column:
    return F.slice(a, begin + 1, end - begin)


def retain_all(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: F.exists(b, lambda y: same(x, y)))


def remove_all(a: Column, b: Column) -> Column:
    return F.filter(a, lambda x: ~F.exists(b, lambda y: same(x, y)))


def contains_all(a: Column, b: Column) -> Column:
    return F.forall(b, lambda y: F.exists(a, lambda x: same(x, y)))


def add_all(a: Column, b: Column) -> Column:
    return F.concat(a, b)


def sort(a: Column) -> Column:
    return F.array_sort(a)


def shuffle(a: Column, seed: int) -> Column:
    return F.shuffle(a, F.lit(seed))


def fill(a: Column, v) -> Column:
    return F.transform(a, lambda _: _c(v).cast("double"))


def round_half_even(a: Column, scale: int) -> Column:
    return F.transform(a, lambda x: F.bround(x, scale))


def plus(a: Column, v) -> Column:
    return F.transform(a, lambda x: x + _c(v))


def times(a: Column, v) -> Column:
    return F.transform(a, lambda x: x * _c(v))


def plus_at(a: Column, k, v) -> Column:
    return F.transform(a, lambda x, i: F.when(i == _c(k), x + _c(v)).otherwise(x))


def times_at(a: Column, k, v) -> Column:
    return F.transform(a, lambda x, i: F.when(i == _c(k), x * _c(v)).otherwise(x))


def _paired(a: Column, b: Column, f) -> Column:
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def plus_paired(a: Column, b: Column) -> Column:
    """By position, as long as the shorter."""
    return _paired(a, b, lambda x, y: x + y)


def minus_paired(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x - y)


def times_paired(a: Column, b: Column) -> Column:
    return _paired(a, b, lambda x, y: x * y)


def sanitize(x: Column, nan=0.0, pos_inf=0.0, neg_inf=0.0) -> Column:
    """Each non-finite value's surrogate, independently; for arrays use sanitize_all."""
    return F.when(F.isnan(x), _c(nan)).when(x == INF, _c(pos_inf)).when(x == -INF, _c(neg_inf)).otherwise(x)


def sanitize_all(a: Column, nan=0.0, pos_inf=0.0, neg_inf=0.0) -> Column:
    return F.transform(a, lambda x: sanitize(x, nan, pos_inf, neg_inf))


def round_signed(x: Column, places: int) -> Column:
    """x rounded half away from zero; what rounds to zero keeps its sign, as in C."""
    return F.signum(x) * F.round(F.abs(x), places)


def approx_equal(a: Column, b: Column, rel: float = 1e-8, absolute: float = 0.0) -> Column:
    """Equal sizes, and each pair within rel of the larger or within absolute."""
    near = lambda x, y: ~F.isnan(x) & ~F.isnan(y) & ((x == y) | (F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * rel) | (F.abs(x - y) <= absolute)) & (F.abs(x - y) != INF)
    exact = lambda x, y: same(x, y)
    return (F.size(a) == F.size(b)) & F.forall(_paired(a, b, lambda x, y: near(x, y) | exact(x, y)), lambda t: t)


def equal(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & F.forall(_paired(a, b, same), lambda t: t)


def to_text(a: Column) -> Column:
    """[1.000000000000E+00, ...]"""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string("%.12E", x)), ", "), F.lit("]"))


# Reductions


def _fold(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), f)


def total(a: Column) -> Column:
    return _fold(a, lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), lambda s, x: s + x)


def cross(a: Column, b: Column) -> Column:
    g = F.get
    return F.array(*[g(a, F.lit(i)) * g(b, F.lit(j)) - g(a, F.lit(j)) * g(b, F.lit(i)) for i, j in ((1, 2), (2, 0), (0, 1))])


def abs_norm(a: Column) -> Column:
    return _fold(a, lambda s, x: s + F.abs(x.cast("double")))


def infinity_norm(a: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(0.0))


def two_norm(a: Column) -> Column:
    """Scaled by the largest magnitude, so that squares neither overflow nor vanish."""
    scaled = lambda m: m * F.sqrt(_fold(a, lambda s, x: s + F.pow(x.cast("double") / F.when(m == 0.0, 1.0).otherwise(m), 2)))
    return let(infinity_norm(a), lambda m: F.when((m == 0.0) | (m == INF), m).otherwise(scaled(m)))


def norm2(a: Column) -> Column:
    """Unscaled."""
    return F.sqrt(_fold(a, lambda s, x: s + x.cast("double") * x.cast("double")))


def abs_normalize(a: Column) -> Column:
    return let(abs_norm(a), lambda n: F.transform(a, lambda x: F.try_divide(x.cast("double"), n)))


def any_nan(a: Column) -> Column:
    return F.exists(a, F.isnan)


def max_value(a: Column) -> Column:
    """Without NaN; -Infinity if there is none."""
    return F.coalesce(F.array_max(F.filter(a, lambda x: ~F.isnan(x))), F.lit(-INF))


def min_value(a: Column) -> Column:
    return F.coalesce(F.array_min(F.filter(a, lambda x: ~F.isnan(x))), F.lit(INF))


def add_scaled(a: Column, b: Column, factor=1.0) -> Column:
    """a + factor * b; opposite infinities add up to 0."""

    def add(x, y):
        z = y * _c(factor)
        return F.when((F.abs(x) == INF) & (F.abs(z) == INF) & (x != z), 0.0).otherwise(x + z)

    return F.zip_with(a, b, add)


def arg_max(a: Column) -> Column:
    """First position of the largest, 0-based."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a).cast("double"), lambda m: m + F.ln(_fold(a, lambda s, x: s + F.exp(x.cast("double") - m))))


# Softmax and similarity


def softmax(a: Column) -> Column:
    raised = let(F.array_max(a).cast("double"), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))
    return let(raised, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def normalized_softmax(a: Column, scale: float) -> Column:
    return F.transform(softmax(a), lambda x: x * scale)


def reweigh(p: Column, t: float) -> Column:
    """p ** (1 / t), renormalised; one-hot at the largest if all vanish."""
    if t <= 0:
        raise ValueError("temperature must be positive")
    if t == 1:
        return p
    tiny = 2.2250738585072014e-308
    raised = F.transform(p, lambda x: F.pow(F.greatest(x.cast("double"), F.lit(tiny)), 1.0 / t))
    one_hot = let(arg_max(p), lambda k: F.transform(p, lambda _, i: (i == k).cast("double")))
    shared = lambda e: let(total(e), lambda s: F.when(s > 0, F.transform(e, lambda x: F.try_divide(x, s))).otherwise(one_hot))
    return let(raised, shared)


def sample_class(p: Column, u: Column) -> Column:
    """The class that the uniform draw u falls into; class 0 if rounding leaves none."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("found"))

    def step(acc, x):
        up = acc["sum"] + x.cast("double")
        hit = F.when((acc["found"] < 0) & (u < up), acc["at"]).otherwise(acc["found"])
        return F.struct(up.alias("sum"), (acc["at"] + 1).alias("at"), hit.alias("found"))

    return F.aggregate(p, start, step, lambda acc: F.greatest(acc["found"], F.lit(0)))


def hellinger_similarity(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x.cast("double")) - F.sqrt(y.cast("double")), 2))
    return 1.0 - F.sqrt(_fold(gaps, lambda s, x: s + x)) / F.sqrt(F.lit(2.0))


def same_arg_max(a: Column, b: Column) -> Column:
    return arg_max(a) == arg_max(b)


# Projections on convex sets


def project_box(a: Column, low: Column, high: Column) -> Column:
    return F.zip_with(F.zip_with(a, low, lambda x, y: F.greatest(x, y)), high, lambda x, y: F.least(x, y))


def project_non_negative(a: Column) -> Column:
    return F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))


def project_simplex(a: Column, s: float = 1.0) -> Column:
    """The nearest point with non-negative entries that add up to s."""
    shifts = lambda d: F.transform(d, lambda _, i: (total(F.slice(d, F.lit(1), i + 1)) - s) / (i + 1))
    last = lambda d: F.get(F.filter(F.reverse(F.zip_with(d, shifts(d), lambda x, t: F.when(x - t > 0, t))), lambda t: t.isNotNull()), F.lit(0))
    return let(let(F.reverse(F.array_sort(a)), last), lambda t: F.transform(a, lambda x: F.greatest(x - t, F.lit(0.0))))


def project_ball(a: Column, radius: float = 1.0) -> Column:
    return let(two_norm(a), lambda n: F.when(n <= radius, a).otherwise(F.transform(a, lambda x: x * radius / F.when(n == 0, 1.0).otherwise(n))))


def project_l1_ball(a: Column, radius: float = 1.0) -> Column:
    shrunk = project_simplex(F.transform(a, F.abs), radius)
    return F.when(abs_norm(a) <= radius, a).otherwise(F.zip_with(shrunk, a, lambda m, x: m * F.signum(x)))
