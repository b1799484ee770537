"""Queries of regression, reduction, solvers and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from .catalogue import query, rounded, rows, table
from .operators import matrix, reduce, regress, sketch, solve
from .plans.session import shared_dir
from .sources import random as rnd
from .streaming import accumulators


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(1.0).alias("one"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def ols_simple(spark, sf_dir):
    d = regress.simple_regression(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return d.withColumns({"slope": rounded(F.col("slope"), 4), "intercept": rounded(F.col("intercept"), 3), "r2": rounded(F.col("r2"))})


TWO = """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS u, covar_pop(l_discount, l_extendedprice) AS v, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, var_pop(l_extendedprice) AS yy, count(*) AS n FROM lineitem),
b AS (SELECT (c * u - b * v) / (a * c - b * b) AS b1, (a * v - b * u) / (a * c - b * b) AS b2, * FROM m) """


@query(TWO + "SELECT round(my - b1 * mx - b2 * mz, 2) AS intercept, round(b1, 4) AS quantity, round(b2, 2) AS discount, round((b1 * u + b2 * v) / yy, 6) AS r2, round(n * (yy - b1 * u - b2 * v) / (n - 3) / 1000, 0) AS sigma2, n FROM b")
def ols_two(spark, sf_dir):
    f = regress.ols(_items(spark, sf_dir), ["one", "l_quantity", "l_discount"], "l_extendedprice")
    d = rows(spark, [(*map(float, f.beta), f.r2, f.sigma2 / 1000, f.n)], "intercept double, quantity double, discount double, r2 double, sigma2 double, n long")
    return d.withColumns({c: rounded(F.col(c), k) for c, k in (("intercept", 2), ("quantity", 4), ("discount", 2), ("r2", 6), ("sigma2", 0))})


@query("WITH w AS (SELECT sum(l_quantity) AS w, sum(l_quantity * l_discount) / sum(l_quantity) AS mx, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS my FROM lineitem) SELECT round(max(my) - sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * pow(l_discount - mx, 2)) * max(mx), 2) AS intercept, round(sum(l_quantity * (l_discount - mx) * (l_extendedprice - my)) / sum(l_quantity * pow(l_discount - mx, 2)), 2) AS slope FROM lineitem, w")
def wls(spark, sf_dir):
    f = regress.ols(_items(spark, sf_dir), ["one", "l_discount"], "l_extendedprice", weight="l_quantity")
    return rows(spark, [tuple(map(float, f.beta))], "intercept double, slope double").withColumns({c: rounded(F.col(c), 2) for c in ("intercept", "slope")})


@query("SELECT round(stddev_pop(l_quantity) * covar_pop(l_quantity, l_extendedprice) * count(*) / stddev_pop(l_quantity) / (count(*) + 100.0) / stddev_pop(l_quantity) / stddev_pop(l_quantity), 4) AS slope, round(avg(l_extendedprice) - avg(l_quantity) * covar_pop(l_quantity, l_extendedprice) * count(*) / (count(*) + 100.0) / var_pop(l_quantity), 3) AS intercept, round(count(*) / (count(*) + 100.0), 8) AS effective_df FROM lineitem")
def ridge_one(spark, sf_dir):
    r = regress.ridge(_items(spark, sf_dir), ["l_quantity"], "l_extendedprice", 100.0)
    return rows(spark, [(float(r["beta"][0]), r["intercept"], r["effective_df"])], "slope double, intercept double, effective_df double").withColumns({c: rounded(F.col(c), k) for c, k in (("slope", 4), ("intercept", 3), ("effective_df", 8))})


FEATURES = ["l_quantity", "l_discount", "l_tax"]


@query("SELECT round(greatest(" + ", ".join(f"abs(covar_pop({c}, l_extendedprice) / stddev_pop({c}))" for c in FEATURES) + "), 2) AS lambda_max FROM lineitem")
def lasso_lambda_max(spark, sf_dir):
    return rows(spark, [(regress.lambda_max(_items(spark, sf_dir), FEATURES, "l_extendedprice"),)], "lambda_max double").withColumn("lambda_max", rounded(F.col("lambda_max"), 2))


@query()
def penalised_path(spark, sf_dir):
    grid, beta, at = regress.path(_items(spark, sf_dir), FEATURES, "l_extendedprice", 0.9, 20)
    return rows(spark, [(float(g), *map(float, b), float(a)) for g, b, a in zip(grid, beta, at, strict=True)], "penalty double, " + ", ".join(f"{c} double" for c in FEATURES) + ", intercept double")


@query()
def penalised_cv(spark, sf_dir):
    r = regress.cross_validate(_items(spark, sf_dir).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")), FEATURES, "l_extendedprice", "id", 1.0, 5, 1, 20)
    return rows(spark, [(float(p), float(m), float(s), r["lambda_min"], r["lambda_1se"]) for p, m, s in zip(r["penalties"], r["mse"], r["std_error"], strict=True)], "penalty double, mse double, std_error double, lambda_min double, lambda_1se double")


@query()
def bounded_regression(spark, sf_dir):
    d = _items(spark, sf_dir)
    a = regress.bounded(d, ["one", *FEATURES], "l_extendedprice", np.full(4, -500.0), np.full(4, 900.0))
    b = regress.non_negative(d, ["one", *FEATURES], "l_extendedprice")
    return rows(spark, [(n, *map(float, r["beta"]), r["rss"]) for n, r in (("bounded", a), ("non_negative", b))], "name string, one double, quantity double, discount double, tax double, rss double")


@query("WITH s AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, avg(l_tax) AS m2, stddev_samp(l_tax) AS s2 FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) AS l_quantity, round((l_tax - m2) / s2, 6) AS l_tax, round(l_quantity, 6) AS back FROM lineitem, s")
def standardization(spark, sf_dir):
    d = _items(spark, sf_dir)
    s = regress.Standardization.of(d, ["l_quantity", "l_tax"])
    z = s.transform(d.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"))
    both = s.inverse(z.withColumns({"zq": F.col("l_quantity"), "zt": F.col("l_tax")}))
    return both.select("l_orderkey", "l_linenumber", rounded(F.col("zq")).alias("l_quantity"), rounded(F.col("zt")).alias("l_tax"), rounded(F.col("l_quantity")).alias("back"))


WIDTH = 64


@query("SELECT 6 AS k, true AS ratio_falls, true AS agree, true AS white FROM (SELECT 1)")
def pca(spark, sf_dir):
    """Components by singular values, covariance and block iteration agree; whitened scores have variance 1."""
    e = table(spark, sf_dir, "embeddings")
    a = reduce.pca(e, "embedding", WIDTH, 6)
    mean, cov = reduce.covariance(e, "embedding", WIDTH)
    b = reduce.covariance_pca(cov, 6, mean)
    c = reduce.truncated_pca(e, "embedding", WIDTH, 2, oversampling=20, iterations=60, tolerance=1e-4)
    agree = np.allclose(a.variance, b.variance, rtol=1e-8) and np.allclose(np.abs((a.vectors * b.vectors).sum(0)), 1, atol=1e-6) and np.allclose(c.variance, a.variance[:2], rtol=1e-2)
    white = a.whiten(e, "embedding").agg(*[F.var_samp(F.col("scores")[i]).alias(f"v{i}") for i in range(6)]).first()
    return rows(spark, [(6, bool((np.diff(a.explained_ratio()) <= 1e-12).all()), bool(agree), bool(np.allclose(white, 1, atol=1e-6)))], "k int, ratio_falls boolean, agree boolean, white boolean")


@query()
def pca_scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return reduce.pca(e, "embedding", WIDTH, 3).transform(e.select("vec_id", "embedding"), "embedding").select("vec_id", *[rounded(F.col("scores")[i]).alias(f"s{i}") for i in range(3)])


@query()
def nmf(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("x"))
    w, h, _ = reduce.nmf(e, "vec_id", "x", WIDTH, 4, 20)
    return reduce.reconstruction_error(w, "x", h)


@query("SELECT true AS svd, true AS eigen, true AS cholesky, true AS inverse, true AS solve")
def factorisations(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    g = matrix.gram(e, "embedding", WIDTH)
    s, v = matrix.tall_svd(e, "embedding", WIDTH)
    w, u = matrix.symmetric_eigen(g)
    left = matrix.left_vectors(e.select("vec_id", "embedding"), "embedding", s[:3], v[:, :3])
    ortho = matrix.gram(left, "u", 3)
    a = rnd.random_spd(12, 3)
    low = matrix.cholesky(a)
    checks = (np.allclose(s**2, w, rtol=1e-8) and np.allclose(ortho, np.eye(3), atol=1e-8), np.allclose(u @ np.diag(w) @ u.T, g, atol=1e-8 * abs(g).max()), np.allclose(low @ low.T, a), np.allclose(matrix.inverse(a) @ a, np.eye(12), atol=1e-7), np.allclose(a @ matrix.solve(a, np.ones(12)), 1))
    return rows(spark, [tuple(map(bool, checks))], "svd boolean, eigen boolean, cholesky boolean, inverse boolean, solve boolean")


@query("SELECT round(sqrt(sum(CAST(x AS DOUBLE) * x)), 6) AS norm, 0.0::DOUBLE AS svd_reconstruction, 0.0::DOUBLE AS left_orthonormality, 0.0::DOUBLE AS right_orthonormality, 0.0::DOUBLE AS eigen_reconstruction, 0.0::DOUBLE AS eigen_residual FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def decomposition_errors(spark, sf_dir):
    """What a decomposition of all embeddings leaves, to nine digits, and their norm from it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    s, v = matrix.tall_svd(e, "embedding", WIDTH)
    left = matrix.left_vectors(e, "embedding", s, v)
    error = matrix.reconstruction_error(matrix.reconstructed(left, "u", s, v, "fitted"), "embedding", "fitted")
    g = matrix.gram(e, "embedding", WIDTH)
    w, u = matrix.symmetric_eigen(g)
    found = {"left_orthonormality": matrix.orthonormality_error(matrix.tall_qr(left, "u", WIDTH)), "right_orthonormality": matrix.orthonormality_error(v), "eigen_reconstruction": matrix.eigen_reconstruction_error(g, w, u), "eigen_residual": matrix.eigen_residual_error(g, w, u)}
    return error.select(rounded(F.lit(float(np.sqrt((s**2).sum())))).alias("norm"), rounded(F.col("error"), 9).alias("svd_reconstruction"), *[rounded(F.lit(x), 9).alias(n) for n, x in found.items()])


# Solvers


@query("SELECT l_returnflag, round(avg(l_quantity), 4) AS plain, round(avg(l_quantity), 4) AS sloped FROM lineitem GROUP BY 1")
def line_minimum(spark, sf_dir):
    """The point of least squared distance to a group's values, from its sums: without
    and with the derivative."""
    q = F.col("l_quantity")
    out = []
    for r in table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.avg(q).alias("m"), F.avg(q * q).alias("s")).collect():  # three flags
        f, slope = (lambda t, r=r: t * t - 2 * r.m * t + r.s), (lambda t, r=r: 2 * (t - r.m))
        around = solve.bracket(f, 0.0, 1.0)
        out.append((r.l_returnflag, *[float(solve.line_minimize(f, *around, slope=g).point[0]) for g in (None, slope)]))
    return rows(spark, out, "l_returnflag string, plain double, sloped double").select("l_returnflag", rounded(F.col("plain"), 4).alias("plain"), rounded(F.col("sloped"), 4).alias("sloped"))


@query("SELECT p_partkey, round(cbrt(p_retailprice), 8) AS root FROM part")
def roots_by_row(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rounded(solve.root_column(lambda x, p: x**3 - p, F.col("p_retailprice"), 0.0, 1000.0), 8).alias("root"))


@query()
def logistic_regression(spark, sf_dir):
    """L-BFGS and its orthant-wise form; value and gradient are one aggregation a step."""
    d = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), (F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_extendedprice") / 100_000).alias("p"), (F.col("l_linestatus") == "O").cast("double").alias("y"))
    f = solve.sum_objective(d, ["one", "q", "d", "p", "y"], solve.logistic_likelihood, 4)
    a = solve.lbfgs(f, np.zeros(4))
    b = solve.lbfgs(f, np.zeros(4), l1=20.0)
    return rows(spark, [(n, *map(float, r.point), float(r.value), r.why) for n, r in (("lbfgs", a), ("orthant_wise", b))], "name string, one double, quantity double, discount double, price double, value double, why string")


@query("SELECT * FROM (VALUES ('newton'), ('broyden'), ('levenberg_marquardt'), ('bounded_levenberg_marquardt'), ('conjugate_gradient'), ('nelder_mead'), ('projected_gradient'), ('simplex_gradient'), ('line')) t(name), (SELECT true AS ok)")
def solvers(spark, sf_dir):
    """Each solver on a problem with a known answer."""
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    rosen_g = lambda x: np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)])
    res = lambda x: np.array([1 - x[0], 10 * (x[1] - x[0] ** 2)])
    system = lambda x: np.array([x[0] ** 2 + x[1] ** 2 - 4, x[0] - x[1]])
    quad = lambda x: (float(((x - np.array([2.0, -1.0])) ** 2).sum()), 2 * (x - np.array([2.0, -1.0])))
    one = np.ones(2)
    near = lambda r, at, tol=1e-5: bool(np.allclose(r.point, at, atol=tol))
    made = {
        "newton": near(solve.newton(system, [1.0, 2.0]), np.sqrt(2) * one), "broyden": near(solve.broyden(system, [1.0, 2.0]), np.sqrt(2) * one),
        "levenberg_marquardt": near(solve.levenberg_marquardt(res, [-1.2, 1.0]), one), "bounded_levenberg_marquardt": near(solve.levenberg_marquardt(res, [-1.2, 1.0], None, [-2, -2], [0.5, 2]), [0.5, 0.25], 1e-3),
        "conjugate_gradient": near(solve.conjugate_gradient(rosen, [-1.2, 1.0], rosen_g, tolerance=1e-14, most=5000), one, 1e-3), "nelder_mead": near(solve.nelder_mead(rosen, [-1.2, 1.0]), one, 1e-4),
        "projected_gradient": near(solve.projected_gradient(quad, [0.0, 0.0], solve.box([0, 0], [1, 1])), [1, 0]), "simplex_gradient": near(solve.projected_gradient(quad, [0.5, 0.5], solve.simplex(1.0)), [1, 0]),
        "line": near(solve.line_minimize(lambda t: (t - 3) ** 2 + 1, *solve.bracket(lambda t: (t - 3) ** 2 + 1, 0.0, 1.0)), [3]),
    }
    return rows(spark, list(made.items()), "name string, ok boolean")


@query("WITH h AS (SELECT event_type, CAST(event_id % 97 AS DOUBLE) AS d, value AS v FROM events) SELECT event_type, round(regr_intercept(v, d), 3) AS a, round(regr_slope(v, d), 5) AS b FROM h GROUP BY 1")
def fit_by_group(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 97).cast("double").alias("d"), F.col("value").alias("v"))
    return solve.by_group(d, ["event_type"], ["d", "v"], solve.line_fit, ["a", "b"]).select("event_type", rounded(F.col("a"), 3).alias("a"), rounded(F.col("b"), 5).alias("b"))


# Streams


def _drained(stream, mode="complete"):
    """The stream's whole result as a written table: a memory table would hold it on the driver."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tessera-stream-{uuid.uuid4().hex}"

    def keep(batch, _):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(300):
            raise TimeoutError("the stream did not end")
    finally:
        q.stop()
    return spark.read.parquet(f"{path}/out")


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS average, round(coalesce(var_samp(value), 0), 1) AS variance FROM events GROUP BY ALL")
def streaming_statistics(spark, sf_dir):
    s = accumulators.file_stream(spark, sf_dir, "events.parquet")
    d = _drained(accumulators.windowed_statistics(s.withColumn("t", F.col("ts").cast("timestamp")), "t", "value", ["event_type"], "6 hours", "1 hour"))
    return d.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", rounded(F.col("total"), 4).alias("total"), "low", "high", rounded(F.col("average")).alias("average"), rounded(F.col("variance"), 1).alias("variance"))


@query("WITH e AS (SELECT event_type, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL '5 minutes' THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), s AS (SELECT *, sum(first) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT event_type, min(ts) AS start, count(value) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type, k")
def streaming_sessions(spark, sf_dir):
    s = accumulators.file_stream(spark, sf_dir, "events.parquet")
    d = _drained(accumulators.session_statistics(s.withColumn("t", F.col("ts").cast("timestamp")), "t", "value", ["event_type"], "5 minutes", "1 hour"), "complete")
    return d.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("total"), 4).alias("total"))


@query()
def streaming_medians(spark, sf_dir):
    s = accumulators.file_stream(spark, sf_dir, "events.parquet")
    d = _drained(accumulators.running_medians(s, "event_type", "value"), "update")
    return d.groupBy("key").agg(F.max_by(F.struct("n", "median"), "n").alias("m")).select("key", "m.*")


def _event_stream(spark, sf_dir):
    return accumulators.file_stream(spark, sf_dir, "events.parquet").withColumn("t", F.col("ts").cast("timestamp"))


@query("SELECT unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL '3 hours']) AS start, count(value) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def streaming_sliding(spark, sf_dir):
    d = _drained(accumulators.windowed_statistics(_event_stream(spark, sf_dir), "t", "value", [], "6 hours", "1 hour", "3 hours"))
    return d.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", rounded(F.col("total"), 4).alias("total"), "low", "high")


@query("WITH e AS (SELECT *, sqrt(abs(value)) AS r, sqrt(event_id % 97) AS d FROM events) SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(covar_samp(r, r), 6) AS r_r, round(covar_samp(r, d), 6) AS r_d, round(covar_samp(d, d), 6) AS d_d FROM e WHERE r IS NOT NULL AND d IS NOT NULL GROUP BY ALL")
def streaming_covariance(spark, sf_dir):
    """Of square roots: covariances of whole cents end in ties of the rounding."""
    s = _event_stream(spark, sf_dir).withColumns({"r": F.sqrt(F.abs("value")), "d": F.sqrt(F.col("event_id") % 97)})
    d = _drained(accumulators.windowed_covariance(s, "t", ["r", "d"], ["event_type"], "1 day", "1 hour"))
    found = [rounded(F.col("covariances")[i]["covariance"]).alias(n) for i, n in enumerate(("r_r", "r_d", "d_d"))]
    return d.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", *found)


@query("SELECT event_type, count(*) AS estimate FROM events GROUP BY 1")
def streaming_count_min(spark, sf_dir):
    """The windows' tables added up; five items of 2,000 columns don't meet in every row."""
    d = _drained(accumulators.windowed_count_min(_event_stream(spark, sf_dir), "t", "event_type", "1 day", "1 hour"))
    return sketch.count_min_estimate(sketch.count_min_merge(d.select("row", "col", "count")), table(spark, sf_dir, "events"), "event_type")


@query("SELECT event_type AS key, count(value) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def streaming_digests(spark, sf_dir):
    d = _drained(accumulators.running_digests(_event_stream(spark, sf_dir), "event_type", "value"), "update")
    last = d.groupBy("key").agg(F.max_by(F.struct("n", "centroids"), "n").alias("m")).select("key", "m.*")
    return last.select("key", "n", F.element_at("centroids", 1)["mean"].alias("low"), F.element_at("centroids", -1)["mean"].alias("high"))
