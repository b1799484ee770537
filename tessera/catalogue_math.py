"""Queries of distributions, mixers, transforms, curves and integrals."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .catalogue import query, round_list, rounded, rows, sql_list, table
from .functions import bits
from .functions import distributions as D
from .operators import fourier, interpolate, quadrature, series

# Distributions, on account balances scaled to useful ranges

GRID = "WITH g AS (SELECT c_custkey AS id, c_acctbal / 1000 AS x, (c_custkey % 997 + 0.5) / 998 AS p, CAST(c_custkey % 40 AS INT) AS k FROM customer) SELECT id, "


def grid(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (F.col("c_acctbal") / 1000).alias("x"), ((k % 997 + 0.5) / 998).alias("p"), (k % 40).cast("int").alias("k"))


BETA = lambda a, b: f"exp(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
PDFS = {
    "beta": (D.Beta(2.5, 3.5), f"CASE WHEN x > 0 AND x < 10 THEN pow(x / 10, 1.5) * pow(1 - x / 10, 2.5) / {BETA(2.5, 3.5)} ELSE 0 END"),
    "cauchy": (D.Cauchy(1, 2), "1 / (pi() * 2 * (1 + pow((x - 1) / 2, 2)))"),
    "chi_square": (D.ChiSquare(5), "CASE WHEN x > 0 THEN exp(1.5 * ln(x) - x / 2 - lgamma(2.5) - 2.5 * ln(2)) ELSE 0 END"),
    "exponential": (D.Exponential(0.7), "CASE WHEN x < 0 THEN 0 ELSE 0.7 * exp(-0.7 * x) END"),
    "fisher_f": (D.FisherF(4, 9), "CASE WHEN x > 0 THEN exp(lgamma(6.5) - lgamma(2) - lgamma(4.5) + 2 * ln(4 / 9) + ln(x) - 6.5 * ln(1 + x * 4 / 9)) ELSE 0 END"),
    "gamma": (D.Gamma(3, 1.5), "CASE WHEN x > 0 THEN exp(2 * ln(x) - x / 1.5 - lgamma(3) - 3 * ln(1.5)) ELSE 0 END"),
    "log_normal": (D.LogNormal(0.5, 0.8), "CASE WHEN x > 0 THEN exp(-0.5 * pow((ln(x) - 0.5) / 0.8, 2)) / (x * 0.8 * sqrt(2 * pi())) ELSE 0 END"),
    "normal": (D.Normal(4, 3), "exp(-0.5 * pow((x - 4) / 3, 2)) / (3 * sqrt(2 * pi()))"),
    "student_t": (D.StudentT(5), "exp(lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - 3 * ln(1 + x * x / 5))"),
    "uniform": (D.Uniform(1, 6), "CASE WHEN x BETWEEN 1 AND 6 THEN 0.2 ELSE 0 END"),
    "weibull": (D.Weibull(4, 1.5), "CASE WHEN x > 0 THEN 1.5 / 4 * pow(x / 4, 0.5) * exp(-pow(x / 4, 1.5)) ELSE 0 END"),
}


@query(GRID + ", ".join(f"round({e}, 8) AS {n}" for n, (_, e) in PDFS.items()) + " FROM g")
def densities(spark, sf_dir):
    return grid(spark, sf_dir).select("id", *[rounded(d.pdf(F.col("x") / 10 if n == "beta" else F.col("x")), 8).alias(n) for n, (d, _) in PDFS.items()])


@query(GRID + """round(0.5 + atan((x - 1) / 2) / pi(), 8) AS cauchy, round(CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-0.7 * x) END, 8) AS exponential, round(greatest(0, least(1, (x - 1) / 5)), 8) AS uniform, round(CASE WHEN x <= 0 THEN 0 ELSE 1 - exp(-pow(x / 4, 1.5)) END, 8) AS weibull FROM g""")
def cdfs_closed_form(spark, sf_dir):
    return grid(spark, sf_dir).select("id", *[rounded(PDFS[n][0].cdf(F.col("x")), 8).alias(n) for n in ("cauchy", "exponential", "uniform", "weibull")])


@query(GRID + """round(1 + 2 * tan(pi() * (p - 0.5)), 5) AS cauchy, round(-ln(1 - p) / 0.7, 7) AS exponential, round(1 + 5 * p, 7) AS uniform, round(4 * pow(-ln(1 - p), 1 / 1.5), 6) AS weibull FROM g""")
def quantiles_closed_form(spark, sf_dir):
    p = F.col("p")
    return grid(spark, sf_dir).select("id", *[rounded(PDFS[n][0].inverse_cdf(p), k).alias(n) for n, k in (("cauchy", 5), ("exponential", 7), ("uniform", 7), ("weibull", 6))])


SPECIAL = ("beta", "chi_square", "fisher_f", "gamma", "log_normal", "normal", "student_t")


@query(GRID + ", ".join(f"true AS {n}" for n in SPECIAL) + " FROM g")
def cdfs_and_quantiles(spark, sf_dir):
    """cdf(quantile(p)) = p to 1e-10 for distributions without closed forms."""
    p = F.col("p")
    return grid(spark, sf_dir).select("id", *[(F.abs(PDFS[n][0].cdf(PDFS[n][0].inverse_cdf(p)) - p) < 1e-10).alias(n) for n in SPECIAL])


@query("""SELECT id, round((SELECT sum(exp(-0.5 * pow((t - 4) / 3, 2)) / (3 * sqrt(2 * pi())) * 0.002) FROM (SELECT (range + 0.5) * 0.002 - 30 AS t FROM range(0, 30000)) WHERE t <= x), 3) AS normal,
  round((SELECT sum(CASE WHEN t > 0 THEN exp(2 * ln(t) - t / 1.5 - lgamma(3) - 3 * ln(1.5)) ELSE 0 END * 0.002) FROM (SELECT (range + 0.5) * 0.002 AS t FROM range(0, 15000)) WHERE t <= x), 3) AS gamma FROM (SELECT unnest(range(1, 10)) AS id, unnest(range(1, 10)) * 1.0 AS x)""")
def cdfs_by_sums(spark, sf_dir):
    """Special-function CDFs against sums of the density."""
    d = spark.range(1, 10).select("id", F.col("id").cast("double").alias("x"))
    return d.select("id", rounded(PDFS["normal"][0].cdf(F.col("x")), 3).alias("normal"), rounded(PDFS["gamma"][0].cdf(F.col("x")), 3).alias("gamma"))


CHOOSE = lambda n, k: f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"
PMFS = {
    "binomial": (D.Binomial(30, 0.3), f"CASE WHEN k <= 30 THEN exp({CHOOSE('30', 'least(k, 30)')} + k * ln(0.3) + (30 - k) * ln(0.7)) ELSE 0 END"),
    "discrete_uniform": (D.DiscreteUniform(3, 12), "CASE WHEN k BETWEEN 3 AND 12 THEN 0.1 ELSE 0 END"),
    "geometric": (D.Geometric(0.2), "0.2 * pow(0.8, k)"),
    "hypergeometric": (D.Hypergeometric(60, 20, 25), f"CASE WHEN k <= 20 THEN exp({CHOOSE('20', 'least(k, 20)')} + {CHOOSE('40', '(25 - least(k, 20))')} - {CHOOSE('60', '25')}) ELSE 0 END"),
    "negative_binomial": (D.NegativeBinomial(4, 0.35), "exp(lgamma(k + 4.0) - lgamma(k + 1.0) - lgamma(4) + 4 * ln(0.35) + k * ln(0.65))"),
    "poisson": (D.Poisson(7.5), "exp(k * ln(7.5) - 7.5 - lgamma(k + 1.0))"),
}
KS = "WITH k AS (SELECT unnest(range(0, 40)) AS k) "


@query(KS + "SELECT CAST(k AS BIGINT) AS k, " + ", ".join(f"round({e}, 9) AS {n}" for n, (_, e) in PMFS.items()) + " FROM k")
def masses(spark, sf_dir):
    k = F.col("k")
    return spark.range(40).toDF("k").select("k", *[rounded(d.pmf(k), 9).alias(n) for n, (d, _) in PMFS.items()])


@query(KS + "SELECT CAST(k AS BIGINT) AS k, " + ", ".join(f"round(sum({e}) OVER (ORDER BY k), 8) AS {n}" for n, (_, e) in PMFS.items()) + " FROM k")
def discrete_cdfs(spark, sf_dir):
    k = F.col("k")
    return spark.range(40).toDF("k").select("k", *[rounded(d.cdf(k), 8).alias(n) for n, (d, _) in PMFS.items()])


@query("WITH k AS (SELECT unnest(range(0, 400)) AS k), q AS (SELECT unnest(range(1, 20)) AS id), c AS (SELECT k, " + ", ".join(f"sum({e}) OVER (ORDER BY k) AS {n}" for n, (_, e) in PMFS.items()) + " FROM k) SELECT CAST(id AS BIGINT) AS id, " + ", ".join(f"CAST((SELECT min(k) FROM c WHERE {n} >= id / 20.0 - 1e-12) AS INT) AS {n}" for n in PMFS) + " FROM q")
def discrete_quantiles(spark, sf_dir):
    return spark.range(1, 20).select("id", *[d.quantile(F.col("id") / 20.0 - 1e-12).alias(n) for n, (d, _) in PMFS.items()])


MOMENTS = {
    "beta": (2.5 / 6, 2.5 * 3.5 / (36 * 7)), "chi_square": (5, 10), "exponential": (1 / 0.7, 1 / 0.49), "fisher_f": (9 / 7, 2 * 81 * 11 / (4 * 49 * 5)), "gamma": (4.5, 6.75),
    "log_normal": (math.exp(0.82), (math.exp(0.64) - 1) * math.exp(1.64)), "normal": (4, 9), "student_t": (0, 5 / 3), "uniform": (3.5, 25 / 12),
    "binomial": (9, 6.3), "discrete_uniform": (7.5, 99 / 12), "geometric": (4, 20), "hypergeometric": (25 / 3, 25 * (1 / 3) * (2 / 3) * 35 / 59), "negative_binomial": (4 * 0.65 / 0.35, 4 * 0.65 / 0.1225), "poisson": (7.5, 7.5),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', round({float(m)!r}::DOUBLE, 9), round({float(v)!r}::DOUBLE, 9))" for n, (m, v) in MOMENTS.items()) + ") t(name, mean, variance)")
def distribution_moments(spark, sf_dir):
    made = {n: d for n, (d, _) in {**PDFS, **PMFS}.items()}
    return rows(spark, [(n, float(made[n].mean()), float(made[n].variance())) for n in MOMENTS], "name string, mean double, variance double").withColumns({"mean": rounded(F.col("mean"), 9), "variance": rounded(F.col("variance"), 9)})


@query(GRID + "round(greatest(0, least(1, x / 5)) - greatest(0, least(1, (x - 1) / 5)), 8) AS probability FROM g")
def interval_probability(spark, sf_dir):
    return grid(spark, sf_dir).select("id", rounded(D.Uniform(0, 5).probability(F.col("x") - 1, F.col("x")), 8).alias("probability"))


# Mixers


def _mixer_sql() -> str:
    """SplitMix's finaliser in 128-bit arithmetic; the rest is checked in tests."""
    m = lambda v, s, f: f"((xor({v}, {v} >> {s})::UHUGEINT * {f}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    return m("v", 30, bits.STAFFORD_13A), m("w", 27, bits.STAFFORD_13B)


_M1, _M2 = _mixer_sql()


@query(f"""WITH a AS (SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS v FROM orders), b AS (SELECT o_orderkey, {_M1} AS w FROM a), c AS (SELECT o_orderkey, {_M2} AS u FROM b)
SELECT o_orderkey, CAST(CASE WHEN xor(u, u >> 31) >= 9223372036854775808 THEN xor(u, u >> 31)::HUGEINT - 18446744073709551616 ELSE xor(u, u >> 31)::HUGEINT END AS BIGINT) AS mixed FROM c""")
def mixer(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", bits.column("stafford_mix13")(F.col("o_orderkey")).alias("mixed"))


def _mixers_sql() -> str:
    """Every mixer step by step: ("x", shifts) xors v with v shifted, ("r", turns) with v
    turned, "c" xors a constant, "m" multiplies modulo 2^64."""
    b = bits
    rounds = {n: [("x", s1), ("m", f1), ("x", s2), ("m", f2), ("x", s3)] for n, s1, f1, s2, f2, s3 in (("stafford_mix13", 30, b.STAFFORD_13A, 27, b.STAFFORD_13B, 31), ("lea_mix64", 32, b.LEA_64, 32, b.LEA_64, 32), ("appleby_mix64", 33, b.APPLEBY_A, 33, b.APPLEBY_B, 33))}
    steps = rounds | {
        "rrmxmx": [("r", 49, 24), ("m", b.EVENSEN_A), ("x", 28), ("m", b.EVENSEN_A), ("x", 28)],
        "rrxmrrxmsx": [("r", 25, 50), ("m", b.EVENSEN_B), ("r", 24, 49), ("m", b.EVENSEN_A), ("x", 28)],
        "xnasam": [("c", b.ROOT_TWO), ("r", 25, 47), ("m", b.NASAM_A), ("x", 23, 51), ("m", b.NASAM_B), ("x", 23, 51)],
        "pelican": [("r", 23, 47), ("c", b.PELICAN_X), ("m", b.PELICAN_A), ("x", 43, 31, 23), ("m", b.PELICAN_B), ("x", 28)],
        "stafford_mix04": [("x", 33), ("m", b.STAFFORD_4A), ("x", 28), ("m", b.STAFFORD_4B)],
    }
    turn = lambda v, k: f"xor({v} >> {k}, (({v}::UHUGEINT * {2 ** (64 - k)}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"
    halves = lambda v: f"(xor({v}, {v} >> 16) * {b.LEA_32}::UBIGINT) % 4294967296::UBIGINT"
    last, outer, levels = dict.fromkeys(steps, "v") | {"lea_mix32": "l"}, [], []
    for at in range(max(map(len, steps.values()))):  # a table for each step: DuckDB would write an alias out anew wherever it stands
        level = {n: v for n, v in last.items() if v != "v"}
        for name, made in steps.items():
            v = last[name]
            if at < len(made):
                kind, *args = made[at]
                e = v
                for a in args:
                    e = f"(({v}::UHUGEINT * {a}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT" if kind == "m" else f"xor({e}, {v} >> {a})" if kind == "x" else f"xor({e}, {turn(v, a)})" if kind == "r" else f"xor({e}, {a}::UBIGINT)"
                level[name] = e
        level["lea_mix32"] = halves(last["lea_mix32"]) if at < 2 else f"xor({last['lea_mix32']}, {last['lea_mix32']} >> 16)" if at == 2 else last["lea_mix32"]
        columns = ", ".join(f"{e} AS {n}" for n, e in level.items())
        levels.append(f"s{at + 1} AS MATERIALIZED (SELECT o_orderkey, v, {columns} FROM s{at})")
        last = {n: n if n in level else "v" for n in last}
    signed = lambda v, bits_: f"CASE WHEN {v} >= {2 ** (bits_ - 1)} THEN ({v})::HUGEINT - {2 ** bits_} ELSE ({v})::HUGEINT END"
    for name in last:
        outer.append(f"CAST({signed('(stafford_mix04 >> 32)' if name == 'stafford_mix04' else name, 32)} AS INT) AS {name}" if name in b.FOLDS else f"CAST({signed(name, 64)} AS BIGINT) AS {name}")
    return f"WITH s0 AS MATERIALIZED (SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS v, CAST(o_orderkey AS UBIGINT) % 4294967296::UBIGINT AS l FROM orders), {', '.join(levels)} SELECT o_orderkey, {', '.join(outer)} FROM s{len(levels)}"


@query(_mixers_sql())
def mixers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[bits.column(n)(k).alias(n) for n in (*bits.MIXERS, *bits.FOLDS)])


# Transforms


def _signal(spark, sf_dir):
    d = table(spark, sf_dir, "events").where("event_id < 60").select(F.col("event_id").alias("pos"), F.col("value").alias("x"))
    return d


SIGNAL = "WITH s AS (SELECT event_id AS pos, value AS x FROM events WHERE event_id < 60), f AS (SELECT k, sum(x * cos(-2 * pi() * ((pos * k) % 60) / 60)) AS re, sum(x * sin(-2 * pi() * ((pos * k) % 60) / 60)) AS im FROM s, (SELECT unnest(range(0, 60)) AS k) GROUP BY k) "


@query(SIGNAL + "SELECT CAST(k AS INT) AS k, round(re, 5) + 0.0 AS re, round(im, 5) + 0.0 AS im, round(re * re + im * im, 3) AS power FROM f")
def dft(spark, sf_dir):
    f = fourier.dft(_signal(spark, sf_dir), "x", "pos", 60)
    return f.select("k", (rounded(F.col("re"), 5) + 0.0).alias("re"), (rounded(F.col("im"), 5) + 0.0).alias("im"), rounded(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 3).alias("power"))


@query("SELECT CAST(event_id AS INT) AS k, round(value, 5) + 0.0 AS re, true AS im_zero FROM events WHERE event_id < 60")
def dft_inverse(spark, sf_dir):
    f = fourier.dft(_signal(spark, sf_dir), "x", "pos", 60)
    b = fourier.dft(f.withColumnRenamed("k", "pos"), "re", "pos", 60, None, True, "im")
    return b.select("k", (rounded(F.col("re"), 5) + 0.0).alias("re"), (F.abs("im") < 1e-9).alias("im_zero"))


def _whole_signal(spark, sf_dir):
    """All events' values in the order of their ids, and their number."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("x"))
    return series.positions(e, ["event_id"]), e.count()


@query()
def dft_all(spark, sf_dir):
    """The transform of all events in n log n steps; the tests compare with NumPy."""
    d, n = _whole_signal(spark, sf_dir)
    f = fourier.series_fft(d, "x", "pos", n)
    return f.select("k", (rounded(F.col("re"), 5) + 0.0).alias("re"), (rounded(F.col("im"), 5) + 0.0).alias("im"), rounded(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 3).alias("power"))


@query()
def dft_inverse_all(spark, sf_dir):
    d, n = _whole_signal(spark, sf_dir)
    f = fourier.series_fft(d, "x", "pos", n)
    b = fourier.series_fft(f.withColumnRenamed("k", "pos"), "re", "pos", n, True, "im")
    return b.select("k", (rounded(F.col("re"), 5) + 0.0).alias("re"), (F.abs("im") < 1e-9).alias("im_zero"))


EM = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings WHERE vec_id < 100), u AS (SELECT vec_id, unnest(a) AS x, generate_subscripts(a, 1) - 1 AS p FROM v), f AS (SELECT vec_id, k, sum(x * cos(-2 * pi() * ((p * k) % 64) / 64)) AS re, sum(x * sin(-2 * pi() * ((p * k) % 64) / 64)) AS im FROM u, (SELECT unnest(range(0, 64)) AS k) GROUP BY ALL), l AS (SELECT vec_id, list(re ORDER BY k) AS re, list(im ORDER BY k) AS im, list(re * re + im * im ORDER BY k) AS pw FROM f GROUP BY vec_id) "


@query(EM + f"SELECT vec_id, {sql_list('pw', 4)} AS power, {sql_list('list_transform(pw, lambda x: x / 64)', 4)} AS scaled, {sql_list('list_concat(pw[33:64], pw[1:32])', 4)} AS shifted, true AS back, true AS unshifted FROM l")
def fft_power(spark, sf_dir):
    return _fft_power(table(spark, sf_dir, "embeddings").where("vec_id < 100"))


@query()
def fft_power_all(spark, sf_dir):
    """fft_power of all embeddings; the tests compare with NumPy."""
    return _fft_power(table(spark, sf_dir, "embeddings"))


def _fft_power(rows):
    a = F.transform("embedding", lambda x: x.cast("double"))
    d = rows.select("vec_id", a.alias("a")).withColumn("c", fourier.fft(F.col("a"))).withColumn("r", fourier.ifft(F.col("c")))
    p = fourier.power(F.col("c"))
    near = F.forall(F.zip_with("a", "r.re", lambda x, y: F.abs(x - y) < 1e-9), lambda t: t)
    return d.select("vec_id", round_list(p, 4).alias("power"), round_list(fourier.power_scaled(F.col("c")), 4).alias("scaled"), round_list(fourier.shift(p), 4).alias("shifted"), near.alias("back"), (fourier.unshift(fourier.shift(F.col("a"))) == F.col("a")).alias("unshifted"))


CX = "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), c AS (SELECT vec_id, a[1:16] AS r1, a[17:32] AS i1, a[33:48] AS r2, a[49:64] AS i2 FROM v), p AS (SELECT vec_id, list_transform(range(1, 17), lambda k: r1[k] * r2[k] - i1[k] * i2[k]) AS re, list_transform(range(1, 17), lambda k: r1[k] * i2[k] + i1[k] * r2[k]) AS im FROM c) "


@query(CX + f"SELECT vec_id, {sql_list('re')} AS re, {sql_list('im')} AS im, round(list_sum(re), 6) + 0.0 AS dot_re, round(list_sum(im), 6) + 0.0 AS dot_im FROM p")
def complex_products(spark, sf_dir):
    a = F.transform("embedding", lambda x: x.cast("double"))
    part = lambda k: F.slice(a, 16 * k + 1, 16)
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.struct(part(0).alias("re"), part(1).alias("im")).alias("x"), F.struct(part(2).alias("re"), part(3).alias("im")).alias("y"))
    p, s = fourier.complex_product(F.col("x"), F.col("y")), fourier.complex_dot(F.col("x"), F.col("y"))
    return d.select("vec_id", round_list(p["re"]).alias("re"), round_list(p["im"]).alias("im"), (rounded(s["re"]) + 0.0).alias("dot_re"), (rounded(s["im"]) + 0.0).alias("dot_im"))


# Curves and surfaces


def _knots(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_size").cast("double").alias("x")).agg(F.avg("p_retailprice").alias("y"))


def _points(spark, sf_dir):
    lo = _knots(spark, sf_dir).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return spark.range(400).crossJoin(F.broadcast(lo)).select("id", (F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("id") / 399.5)).alias("q"))


KRUGER = """WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, avg(p_retailprice) AS y FROM part GROUP BY 1), s AS (SELECT x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2, (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s FROM p WINDOW w AS (ORDER BY x)),
m AS (SELECT *, lag(s) OVER (ORDER BY x) AS b, CASE WHEN s IS NULL OR lag(s) OVER (ORDER BY x) IS NULL THEN NULL WHEN s * lag(s) OVER (ORDER BY x) <= 0 THEN 0 ELSE 2 / (1 / s + 1 / lag(s) OVER (ORDER BY x)) END AS m FROM s),
n AS (SELECT *, lead(m) OVER (ORDER BY x) AS m2 FROM m), h AS (SELECT x, x2, y, s, coalesce(m, 1.5 * s - m2 / 2) AS f, coalesce(m2, 1.5 * s - m / 2) AS l FROM n WHERE x2 IS NOT NULL),
seg AS (SELECT x, x2, y AS k0, f AS k1, (3 * s - 2 * f - l) / (x2 - x) AS k2, (f + l - 2 * s) / pow(x2 - x, 2) AS k3 FROM h),
q AS (SELECT range AS id, lo + (hi - lo) * (range / 399.5) AS q FROM range(400), (SELECT min(x) AS lo, max(x) AS hi FROM p)) """


@query(KRUGER + "SELECT id, round(k0 + (q - x) * (k1 + (q - x) * (k2 + (q - x) * k3)), 4) AS value, round(k1 + (q - x) * (2 * k2 + 3 * (q - x) * k3), 4) AS slope, round(2 * k2 + 6 * k3 * (q - x), 4) AS curvature FROM q ASOF JOIN seg ON q.q >= seg.x")
def kruger_spline(spark, sf_dir):
    seg, q = interpolate.kruger(_knots(spark, sf_dir), "x", "y"), _points(spark, sf_dir)
    out = interpolate.evaluate(seg, q, "q", 0, "value").select("id", rounded(F.col("value"), 4).alias("value"))
    for k, n in ((1, "slope"), (2, "curvature")):
        out = out.join(interpolate.evaluate(seg, q, "q", k, n).select("id", rounded(F.col(n), 4).alias(n)), "id")
    return out


@query(KRUGER + ", b AS (SELECT *, greatest(x, 5.5) - x AS t1, least(x2, 30.25) - x AS t2 FROM seg WHERE x2 > 5.5 AND x < 30.25) SELECT round(sum(k0 * (t2 - t1) + k1 * (t2 * t2 - t1 * t1) / 2 + k2 * (pow(t2, 3) - pow(t1, 3)) / 3 + k3 * (pow(t2, 4) - pow(t1, 4)) / 4), 3) AS forwards, round(-sum(k0 * (t2 - t1) + k1 * (t2 * t2 - t1 * t1) / 2 + k2 * (pow(t2, 3) - pow(t1, 3)) / 3 + k3 * (pow(t2, 4) - pow(t1, 4)) / 4), 3) AS backwards, (SELECT count(*) FROM seg) AS segments FROM b")
def spline_integral(spark, sf_dir):
    seg = interpolate.kruger(_knots(spark, sf_dir), "x", "y")
    a, b = interpolate.integrate(seg, 5.5, 30.25), interpolate.integrate(seg, 30.25, 5.5)
    return a.select(rounded(F.col("integral"), 3).alias("forwards")).crossJoin(b.select(rounded(F.col("integral"), 3).alias("backwards"))).crossJoin(interpolate.segment_count(seg))


@query()
def splines(spark, sf_dir):
    """The four schemes at the same points."""
    knots = _knots(spark, sf_dir).withColumn("g", F.lit(1))
    out = _points(spark, sf_dir)
    for s in interpolate.SCHEMES:
        out = interpolate.evaluate(interpolate.spline(knots, "x", "y", ["g"], s).drop("g"), out, "q", 0, s)
    return out


def _surface(spark):
    """x in 0..8, y in 0..5 by halves; z = sin(x) + x y / 7 rounded to 6 places."""
    i, j = spark.range(17).select(F.col("id").cast("int").alias("i")), spark.range(11).select(F.col("id").cast("int").alias("j"))
    return i.crossJoin(j).select("i", "j", (F.col("i") / 2.0).alias("x"), (F.col("j") / 2.0).alias("y"), F.round(F.sin(F.col("i") / 2.0) + F.col("i") * F.col("j") / 28.0, 6).alias("z"))


def _spots(spark):
    return spark.range(200).select("id", (F.col("id") * 0.0397).alias("px"), (F.col("id") % 50 * 0.0997).alias("py"))


BILINEAR = """WITH g AS (SELECT i, j, i / 2.0::DOUBLE AS x, j / 2.0::DOUBLE AS y, round(sin(i / 2.0::DOUBLE) + i * j / 28.0::DOUBLE, 6) AS z FROM (SELECT unnest(range(0, 17)) AS i), (SELECT unnest(range(0, 11)) AS j)),
q AS (SELECT range AS id, range * 0.0397::DOUBLE AS px, range % 50 * 0.0997::DOUBLE AS py FROM range(200)), c AS (SELECT id, px, py, CAST(floor(px * 2) AS INT) AS i, CAST(floor(py * 2) AS INT) AS j FROM q),
k AS (SELECT c.*, a.z AS z00, b.z AS z10, d.z AS z01, e.z AS z11, (px - a.x) * 2 AS u, (py - a.y) * 2 AS v FROM c JOIN g a USING (i, j) JOIN g b ON b.i = c.i + 1 AND b.j = c.j JOIN g d ON d.i = c.i AND d.j = c.j + 1 JOIN g e ON e.i = c.i + 1 AND e.j = c.j + 1) """


@query(BILINEAR + "SELECT id, round((1-u)*(1-v)*z00 + u*(1-v)*z10 + (1-u)*v*z01 + u*v*z11, 5) AS value, round(2 * ((1-v)*(z10-z00) + v*(z11-z01)), 5) AS dx, round(2 * ((1-u)*(z01-z00) + u*(z11-z10)), 5) AS dy FROM k")
def bilinear_surface(spark, sf_dir):
    cells, q = interpolate.bilinear_cells(_surface(spark)), _spots(spark)
    out = q.select("id")
    for n, dx, dy in (("value", 0, 0), ("dx", 1, 0), ("dy", 0, 1)):
        out = out.join(interpolate.surface_value(cells, q, "px", "py", dx, dy, n).select("id", rounded(F.col(n), 5).alias(n)), "id")
    return out


@query(BILINEAR.split("q AS")[0].rstrip().rstrip(",") + " SELECT round(sum((a.z + b.z + d.z + e.z) / 16), 4) AS integral FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j JOIN g d ON d.i = a.i AND d.j = a.j + 1 JOIN g e ON e.i = a.i + 1 AND e.j = a.j + 1")
def surface_integral(spark, sf_dir):
    return interpolate.surface_integral(interpolate.bilinear_cells(_surface(spark)), 0.0, 8.0, 0.0, 5.0).withColumn("integral", rounded(F.col("integral"), 4))


@query()
def cubic_surfaces(spark, sf_dir):
    """Tensor and successive splines of one grid at the same points."""
    x, y = np.arange(17) / 2, np.arange(11) / 2
    z = np.sin(x)[:, None] + x[:, None] * y[None, :] / 7
    out = interpolate.surface_value(interpolate.bicubic_cells(spark, x, y, z), _spots(spark), "px", "py", name="tensor")
    for s in interpolate.SCHEMES:
        out = interpolate.successive(out, "px", "py", x, y, z, s, f"successive_{s}")
    return out


# Integrals


_RULE = "(VALUES " + ", ".join(f"({x!r}::DOUBLE, {k!r}::DOUBLE, {g!r}::DOUBLE)" for x, k, g in quadrature.rule()) + ") r(t, k, g)"


@query(f"""SELECT round((SELECT sum(k * 1.5 * exp(-pow(1.5 + 1.5 * t, 2))) FROM {_RULE}), 10) AS one, round((SELECT sum(a.k * b.k * 0.5 * exp((0.5 + 0.5 * a.t) * (1 + b.t))) FROM {_RULE.replace('r(t', 'a(t')}, {_RULE.replace('r(t', 'b(t')}), 10) AS two,
  round((SELECT sum(a.k * b.k * c.k / 8 * (0.5 + 0.5 * a.t) * (0.5 + 0.5 * b.t) * sin(0.5 + 0.5 * c.t)) FROM {_RULE.replace('r(t', 'a(t')}, {_RULE.replace('r(t', 'b(t')}, {_RULE.replace('r(t', 'c(t')}), 10) AS three""")
def gauss_kronrod(spark, sf_dir):
    """One panel in one, two and three dimensions."""
    one = quadrature.gauss_kronrod(spark, lambda x: F.exp(-x * x), (0.0, 3.0)).value
    two = quadrature.gauss_kronrod(spark, lambda x, y: F.exp(x * y), (0.0, 1.0), (0.0, 2.0)).value
    three = quadrature.gauss_kronrod(spark, lambda x, y, z: x * y * F.sin(z), (0.0, 1.0), (0.0, 1.0), (0.0, 1.0)).value
    return rows(spark, [(one, two, three)], "one double, two double, three double").select(*[rounded(F.col(c), 10).alias(c) for c in ("one", "two", "three")])


@query("""SELECT * FROM (VALUES ('adaptive', round(2.0 / 3, 6)), ('adaptive_2d', round((exp(1) - 1) * (exp(1) - 1), 6)), ('clenshaw_curtis', round(sin(5) / 5, 6)), ('clenshaw_curtis_2d', 0.25), ('double_exponential', 10.0), ('double_exponential_infinite', round(sqrt(pi()), 6)), ('infinite', round(pi(), 6)), ('smart', round(exp(1) - 1, 6)), ('smart_peak', round(2 * atan(100) / 100 * 100 * 100, 6))) t(name, value)""")
def integrators(spark, sf_dir):
    q = quadrature
    made = {
        "adaptive": q.adaptive(spark, lambda x: F.sqrt(x), (0.0, 1.0), tolerance=1e-8), "adaptive_2d": q.adaptive(spark, lambda x, y: F.exp(x + y), (0.0, 1.0), (0.0, 1.0)),
        "clenshaw_curtis": q.clenshaw_curtis(spark, lambda x: F.cos(5 * x), (0.0, 1.0)), "clenshaw_curtis_2d": q.clenshaw_curtis(spark, lambda x, y: x * y, (0.0, 1.0), (0.0, 1.0)),
        "double_exponential": q.double_exponential(spark, lambda x: F.pow(x, -0.9), 0.0, 1.0, 1e-9), "double_exponential_infinite": q.double_exponential(spark, lambda x: F.exp(-x * x), -math.inf, math.inf),
        "infinite": q.infinite(spark, lambda x: 1 / (1 + x * x), (-math.inf, math.inf)), "smart": q.smart(spark, lambda x: F.exp(x), (0.0, 1.0)), "smart_peak": q.smart(spark, lambda x: 1 / (1e-4 + x * x), (-1.0, 1.0), tolerance=1e-9),
    }
    return rows(spark, [(n, r.value) for n, r in made.items()], "name string, value double").withColumn("value", rounded(F.col("value")))


