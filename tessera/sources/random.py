"""Reproducible random tables.

Row number i belongs to block i // BLOCK. A block's generator is seeded from (seed,
block) alone, so a table is the same however Spark cuts it, and again after an
executor is lost. A block runs LANES generators side by side in NumPy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, special

BLOCK, LANES = 1 << 14, 256
U = np.uint64

#: Increments and multipliers of the published generators.
GOLDEN = 0x9E3779B97F4A7C15
XORSHIFT64_STAR, XORSHIFT1024_STAR = 0x2545F4914F6CDD1D, 0x9E3779B97F4A7C13
LCG = 0xD1342543DE82EF95
MT_MATRIX, MT_MASK_B, MT_MASK_C, MT_MASK_D, MT_INIT = 0xB5026F5AA96619E9, 0x71D67FFFEDA60000, 0xFFF7EEE000000000, 0x5555555555555555, 6364136223846793005


def _rol(v, k):
    return (v << U(k)) | (v >> U(64 - k))


def seeds(seed: int, block: int, n: int) -> np.ndarray:
    """n x LANES seed words of a block, by the splittable mixer."""
    base = bits.stafford_mix13(np.array([(seed & (2**64 - 1)) ^ (block * GOLDEN & (2**64 - 1))], dtype=U))
    return bits.stafford_mix13(base + U(GOLDEN) * np.arange(1, n * LANES + 1, dtype=U)).reshape(n, LANES)


class SplitMix64:
    def __init__(self, seed, block):
        self.state = seeds(seed, block, 1)[0]

    def next(self):
        self.state = self.state + U(GOLDEN)
        return bits.xnasam(self.state)


class XorShift64Star:
    def __init__(self, seed, block):
        self.x = seeds(seed, block, 1)[0] | U(1)

    def next(self):
        x = self.x
        x = x ^ (x >> U(12))
        x = x ^ (x << U(25))
        self.x = x = x ^ (x >> U(27))
        return x * U(XORSHIFT64_STAR)


class XorShift128Plus:
    def __init__(self, seed, block):
        self.a, self.b = seeds(seed, block, 2)

    def next(self):
        a, b = self.a, self.b
        out = a + b
        a = a ^ (a << U(23))
        self.a, self.b = b, a ^ b ^ (a >> U(18)) ^ (b >> U(5))
        return out


class XorShift1024Star:
    def __init__(self, seed, block):
        self.x, self.at = seeds(seed, block, 16).copy(), 0

    def next(self):
        s0 = self.x[self.at]
        self.at = (self.at + 1) % 16
        s1 = self.x[self.at] ^ (self.x[self.at] << U(31))
        self.x[self.at] = s = s1 ^ s0 ^ (s1 >> U(11)) ^ (s0 >> U(30))
        return s * U(XORSHIFT1024_STAR)


class Xoshiro256:
    def __init__(self, seed, block):
        self.s = list(seeds(seed, block, 4))

    def advance(self):
        a, b, c, d = self.s
        c, d = c ^ a, d ^ b
        self.s = [a ^ d, b ^ c, c ^ (b << U(17)), _rol(d, 45)]


class XorShiftRot256PlusPlus(Xoshiro256):
    def next(self):
        out = _rol(self.s[0] + self.s[3], 23) + self.s[0]
        self.advance()
        return out


class XorShiftRot256StarStar(Xoshiro256):
    def next(self):
        out = _rol(self.s[1] * U(5), 7) * U(9)
        self.advance()
        return out


class Sfc64:
    def __init__(self, seed, block):
        self.a, self.b, self.c = seeds(seed, block, 3)
        self.n = U(1)
        for _ in range(12):
            self.next()

    def next(self):
        out = self.a + self.b + self.n
        self.n = self.n + U(1)
        self.a, self.b, self.c = self.b ^ (self.b >> U(11)), self.c + (self.c << U(3)), _rol(self.c, 24) + out
        return out


class Lcg64Xor1024Mix:
    def __init__(self, seed, block):
        words = seeds(seed, block, 18)
        self.add, self.s, self.x, self.at = words[0] | U(1), words[1], words[2:].copy(), 15

    def next(self):
        last, self.at = self.at, (self.at + 1) % 16
        s15, s0 = self.x[last], self.x[self.at]
        out = bits.lea_mix64(self.s + s0)
        self.s = U(LCG) * self.s + self.add
        s15 = s15 ^ s0
        self.x[last], self.x[self.at] = _rol(s0, 25) ^ s15 ^ (s15 << U(27)), _rol(s15, 36)
        return out


class MersenneTwister64:
    """One lane of the 312-word generator; its words fill the lanes in turn."""

    def __init__(self, seed, block):
        x = int(seeds(seed, block, 1)[0, 0])
        words = []
        for i in range(312):
            x = x if not i else (MT_INIT * (x ^ (x >> 62)) + i) & (2**64 - 1)
            words.append(x)
        self.words, self.held = np.array(words, dtype=U), np.zeros(0, dtype=U)

    def turn(self):
        m = self.words
        for k in range(312):
            y = (int(m[k]) & 0xFFFFFFFF80000000) | (int(m[(k + 1) % 312]) & 0x7FFFFFFF)
            m[k] = int(m[(k + 156) % 312]) ^ (y >> 1) ^ (MT_MATRIX if y & 1 else 0)
        x = m.copy()
        x ^= (x >> U(29)) & U(MT_MASK_D)
        x ^= (x << U(17)) & U(MT_MASK_B)
        x ^= (x << U(37)) & U(MT_MASK_C)
        return x ^ (x >> U(43))

    def next(self):
        while len(self.held) < LANES:
            self.held = np.concatenate([self.held, self.turn()])
        out, self.held = self.held[:LANES], self.held[LANES:]
        return out


class Interleaved4:
    """Round robin over four counting generators."""

    def __init__(self, seed, block):
        self.each, self.at = [Sfc64(seed + k, block) for k in range(4)], -1

    def next(self):
        self.at = (self.at + 1) % 4
        return self.each[self.at].next()


GENERATORS = {c.__name__: c for c in (SplitMix64, XorShift64Star, XorShift128Plus, XorShift1024Star, XorShiftRot256PlusPlus, XorShiftRot256StarStar, Sfc64, Lcg64Xor1024Mix, MersenneTwister64, Interleaved4)}


def words(generator: str, seed: int, block: int, n: int = BLOCK) -> np.ndarray:
    g = GENERATORS[generator](seed, block)
    with np.errstate(over="ignore"):
        return np.concatenate([g.next() for _ in range(-(-n // LANES))])[:n]


def split(seed: int, k: int) -> int:
    """The seed of child k: independent streams for rows, groups or tasks."""
    with np.errstate(over="ignore"):
        return int(bits.rrxmrrxmsx(np.array([(seed + (k + 1) * GOLDEN) & (2**64 - 1)], dtype=U)).view(np.int64)[0])


def _table(spark: SparkSession, n: int, kind: str, f: Callable[[int, int], np.ndarray], parts: int | None = None) -> DataFrame:
    """id, value: f(block, size) for each block."""
    blocks = spark.range(0, -(-n // BLOCK), 1, parts or max(1, min(-(-n // BLOCK), spark.sparkContext.defaultParallelism)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block in b["id"]:
                size = min(BLOCK, n - block * BLOCK)
                yield pd.DataFrame({"id": np.arange(size) + block * BLOCK, "value": f(int(block), size)})

    return blocks.mapInPandas(run, f"id long, value {kind}")


def longs(spark, n, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    return _table(spark, n, "long", lambda b, k: words(generator, seed, b, k).view(np.int64))


def ints(spark, n, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    """The upper 32 bits."""
    return _table(spark, n, "int", lambda b, k: (words(generator, seed, b, k) >> U(32)).astype(np.uint32).view(np.int32))


def top_bits(spark, n, count: int, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    return _table(spark, n, "int", lambda b, k: (words(generator, seed, b, k) >> U(64 - count)).astype(np.uint32).view(np.int32))


def booleans(spark, n, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    return _table(spark, n, "boolean", lambda b, k: words(generator, seed, b, k).view(np.int64) < 0)


def floats(spark, n, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    return _table(spark, n, "float", lambda b, k: ((words(generator, seed, b, k) >> U(40)).astype(np.float32) * np.float32(2.0**-24)))


def byte_strings(spark, n, length: int, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    """length bytes each, little-endian words."""
    per = -(-length // 8)

    def f(b, k):
        raw = words(generator, seed, b, k * per).astype("<u8").tobytes()
        return [raw[i * per * 8 : i * per * 8 + length] for i in range(k)]

    return _table(spark, n, "binary", f)


def unit(generator: str, seed: int, block: int, n: int) -> np.ndarray:
    return (words(generator, seed, block, n) >> U(11)).astype(float) * 2.0**-53


def doubles(spark, n, low=0.0, high=1.0, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    """[low, high)"""
    if not low < high:
        raise ValueError("low must be less than high")
    half = (high / 2 - low / 2) * 2

    def f(b, k):
        u = unit(generator, seed, b, k)
        x = low + u * half if np.isfinite(half) else 2 * (low / 2 + u * (high / 2 - low / 2))
        return np.where(x >= high, np.nextafter(high, low), x)

    return _table(spark, n, "double", f)


def bounded_longs(spark, n, low: int, high: int, seed=0, generator="XorShiftRot256StarStar") -> DataFrame:
    """low..high, both included, unbiased: draws beyond the last whole multiple of the
    range are drawn again."""
    span = high - low + 1
    if span <= 0:
        raise ValueError("empty range")

    def f(b, k):
        limit = (1 << 64) - (1 << 64) % span
        out, more, at = np.zeros(0, dtype=U), k, b
        while len(out) < k:
            w = words(generator, seed, at, max(more, LANES))
            out = np.concatenate([out, w[w.astype(object) < limit] if limit < 1 << 64 else w])
            at, more = at + (1 << 40), k - len(out)
        return (out[:k] % U(span)).astype(np.int64) + low if span < 1 << 63 else out[:k].view(np.int64)

    return _table(spark, n, "long", f)


def ints_without_replacement(spark: SparkSession, low: int, high: int, count: int, seed=0) -> DataFrame:
    """count different values of low..high: those of least keyed hash."""
    if count > high - low + 1:
        raise ValueError("more values than the range has")
    return spark.range(low, high + 1).select(F.col("id").alias("value")).orderBy(F.xxhash64(F.lit(seed), "value"), "value").limit(count)


def _variate(f):
    """Table of a NumPy variate: each block has a Generator keyed by (seed, block)."""

    def make(spark, n, *params, seed=0):
        return _table(spark, n, "double", lambda b, k: f(np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), b])), k, *params))

    return make


def truncated(g, n, low, high):
    a, b = special.normal_cdf(np.array([low, high]))
    return np.clip(special.normal_quantile(a + (b - a) * g.random(n)), low, high)


VARIATES = {
    "uniform": lambda g, n, a, b: g.uniform(a, b, n),
    "normal": lambda g, n, mu, sigma: g.normal(mu, sigma, n),
    "cauchy": lambda g, n, at, scale: at + scale * g.standard_cauchy(n),
    "exponential": lambda g, n, rate: g.exponential(1 / rate, n),
    "gamma": lambda g, n, k, theta: g.gamma(k, theta, n),
    "beta": lambda g, n, a, b: g.beta(a, b, n),
    "chi_square": lambda g, n, k: g.chisquare(k, n),
    "fisher_f": lambda g, n, d1, d2: g.f(d1, d2, n),
    "log_normal": lambda g, n, mu, sigma: g.lognormal(mu, sigma, n),
    "student_t": lambda g, n, df: g.standard_t(df, n),
    "weibull": lambda g, n, scale, shape: scale * g.weibull(shape, n),
    "truncated_standard_normal": truncated,
    "lecun_normal": lambda g, n, sigma: sigma * truncated(g, n, -2.0, 2.0),
    "inverse_gamma": lambda g, n, a, b: 1 / g.gamma(a, 1 / b, n),
}


def variates(spark: SparkSession, name: str, n: int, *params: float, seed: int = 0) -> DataFrame:
    """id, value: n draws of a distribution."""
    return _variate(VARIATES[name])(spark, n, *params, seed=seed)


def unbounded(spark: SparkSession, name: str, *params: float, rows_per_second: int = 100, seed: int = 0) -> DataFrame:
    """A stream of draws: timestamp, id, value. Row id gets the same draw in any batch."""
    f = VARIATES[name]
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()

    @F.pandas_udf("double")
    def draw(ids: pd.Series) -> pd.Series:
        return pd.Series([float(f(np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), int(i)])), 1, *params)[0]) for i in ids])

    return rate.select("timestamp", F.col("value").alias("id"), draw("value").alias("value"))


def multivariate_normal(spark: SparkSession, mean: np.ndarray, cov: np.ndarray, n: int, seed: int = 0) -> DataFrame:
    """id and a vector: mean + L z, L the Cholesky factor of cov + 1e-7 I."""
    from ..operators.matrix import cholesky

    factor = cholesky(np.asarray(cov, dtype=float) + 1e-7 * np.eye(len(mean)))
    mu = np.asarray(mean, dtype=float)

    def f(b, k):
        z = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), b])).standard_normal((k, len(mu)))
        return list(mu + z @ factor.T)

    return _table(spark, n, "array<double>", f).withColumnRenamed("value", "sample")


def random_spd(n: int, seed: int = 0) -> np.ndarray:
    """Q^T |D| Q of a random orthogonal Q: symmetric, positive definite."""
    g = np.random.default_rng(seed)
    q, _ = np.linalg.qr(g.standard_normal((n, n)))
    a = q.T @ np.diag(np.abs(g.standard_normal(n)) + 1e-3) @ q
    return (a + a.T) / 2
