"""Streaming accumulators against their batch forms, late rows, and decomposition errors."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import matrix, sketch, solve
from tessera.streaming import accumulators


def at(hour, minute=0):
    return dt.datetime(2024, 3, 1, hour, minute, tzinfo=dt.timezone.utc)


@pytest.fixture
def files(spark, tmp_path):
    """A stream of one file a batch, in the order given."""

    def make(batches, schema):
        folder = tmp_path / "in"
        folder.mkdir()
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
            part = next(p for p in (tmp_path / f"b{k}").iterdir() if p.suffix == ".parquet")
            to = folder / f"{k}.parquet"
            part.rename(to)
            os.utime(to, (1_700_000_000 + k, 1_700_000_000 + k))
        return accumulators.file_stream(spark, str(folder), files_per_trigger=1)

    return make


def test_late_rows_are_dropped(files):
    """A batch drops what is behind the watermark with which the batch before it ran."""
    s = files([[(at(10), 1.0), (at(12), 2.0)], [(at(11, 30), 3.0), (at(16), 4.0)], [(at(8), 50.0), (at(20), 5.0)]], "t timestamp, x double")
    d = accumulators.drain(accumulators.windowed_statistics(s, "t", "x", [], "1 hour", "1 hour"), "late_rows", "append")
    assert sorted(r.total for r in d.collect()) == [1.0, 2.0, 3.0, 4.0]


def test_sliding_windows_overlap(files):
    s = files([[(at(10, 15), 1.0)], [(at(10, 45), 2.0)]], "t timestamp, x double")
    d = accumulators.drain(accumulators.windowed_statistics(s, "t", "x", [], "1 hour", "1 hour", "30 minutes"), "sliding")
    assert sorted((r.n, r.total) for r in d.collect()) == [(1, 1.0), (1, 2.0), (2, 3.0)]


def test_covariance_across_batches(files):
    x = np.random.default_rng(5).normal(size=(60, 2)) + [1e6, 3]
    rows = [(at(10, k), float(a), float(b)) for k, (a, b) in zip(range(60), x, strict=True)]
    s = files([rows[:25], [*rows[25:], (at(10), None, 9.0)]], "t timestamp, x double, y double")
    r = accumulators.drain(accumulators.windowed_covariance(s, "t", ["x", "y"], [], "1 hour", "1 hour"), "covariance").first()
    c = np.cov(x.T)
    assert r.n == 60 and [(p.i, p.j) for p in r.covariances] == [("x", "x"), ("x", "y"), ("y", "y")]
    assert np.allclose([p.covariance for p in r.covariances], [c[0, 0], c[0, 1], c[1, 1]], rtol=1e-7)


def test_count_min_equals_the_batch_table(spark, files):
    items = [f"user_{k % 40}" for k in range(300)] + ["heavy"] * 100
    s = files([[(at(10), i) for i in items[:170]], [(at(10), i) for i in items[170:]]], "t timestamp, item string")
    d = accumulators.drain(accumulators.windowed_count_min(s, "t", "item", "1 hour", "1 hour", 3, 50), "count_min")
    want = sketch.count_min(spark.createDataFrame([(i,) for i in items], "item string"), "item", 3, 50)
    plain = lambda t: sorted((r.row, r.col, r["count"]) for r in t.collect())
    assert plain(d) == plain(want)


def test_digest_across_batches(files):
    x = np.random.default_rng(7).exponential(2, 6000)
    rows = [("a", float(v)) for v in x] + [("b", 1.0), ("b", None), (None, 2.0)]
    s = files([rows[:2000], rows[2000:], [("c", float("nan"))]], "k string, x double")
    d = accumulators.drain(accumulators.running_digests(s, "k", "x", 100.0), "digests", "update")
    last = {r.key: r for r in d.groupBy("key").agg(F.max_by("n", "n").alias("n"), F.max_by("centroids", "n").alias("c")).withColumn("q", sketch.digest_median(F.col("c"))).collect()}
    assert {k: r.n for k, r in last.items()} == {"a": 6000, "b": 1, None: 1, "c": 0}
    assert abs(last["a"].q - np.median(x)) < 0.02 and len(last["a"].c) < 1000
    assert (last["a"].c[0].mean, last["a"].c[-1].mean) == (x.min(), x.max())


def test_decomposition_errors(spark):
    x = np.random.default_rng(3).normal(size=(200, 4))
    d = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k long, x array<double>").repartition(3)
    s, v = matrix.tall_svd(d, "x", 4)
    error = lambda k: matrix.reconstruction_error(matrix.reconstructed(matrix.left_vectors(d, "x", s[:k], v[:, :k]), "u", s[:k], v[:, :k], "f"), "x", "f").first().error
    assert error(4) < 1e-12 and abs(error(2) - np.sqrt((s[2:] ** 2).sum() / (s**2).sum())) < 1e-12
    assert matrix.reconstruction_error(d.where("k < 0").withColumn("f", F.col("x")), "x", "f").first().error == 0
    assert matrix.orthonormality_error(v) < 1e-12 and abs(matrix.orthonormality_error(2 * v) - 3) < 1e-12
    a = x.T @ x
    w, u = matrix.symmetric_eigen(a)
    assert matrix.eigen_residual_error(a, w, u) < 1e-12 and matrix.eigen_reconstruction_error(a, w, u) < 1e-12
    assert matrix.eigen_reconstruction_error(a, w * 1.1, u) == pytest.approx(0.1)


def test_float_products_are_rounded_once(spark):
    x = np.random.default_rng(4).normal(size=(50, 3)).astype(np.float32)
    m = matrix.single(matrix.from_rows(spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "k long, x array<float>"), "k", "x"))
    got = matrix.single(matrix.multiply(m, m, True))
    assert dict(got.dtypes)["v"] == "float"
    want = (x.astype(float).T @ x.astype(float)).astype(np.float32)
    assert all(abs(r.v - want[r.i, r.j]) <= np.spacing(abs(want[r.i, r.j])) for r in got.collect())


@pytest.mark.parametrize("f, slope, low, high, least", [
    (lambda t: (t - 3) ** 2, lambda t: 2 * (t - 3), 0.0, 10.0, 3.0), (lambda t: (t - 1) ** 4, lambda t: 4 * (t - 1) ** 3, -50.0, 9.0, 1.0),
    (np.exp, np.exp, -2.0, 5.0, -2.0), (lambda t: t - np.log(t), lambda t: 1 - 1 / t, 1e-6, 400.0, 1.0),
])
def test_line_with_slope(f, slope, low, high, least):
    r = solve.line_minimize(f, low, (low + high) / 2, high, slope=slope)
    assert abs(r.point[0] - least) < 1e-4 and r.value == f(r.point[0])


def test_watch_stops_the_climb():
    seen = []
    f = lambda w: (-float((w**4).sum()), -4 * w**3)
    r = solve.lbfgs(f, [3.0, -2.0], watch=lambda x, v, k: seen.append((k, v)) or k < 3)
    assert r.why == "stopped" and not r.converged and [k for k, _ in seen] == [1, 2, 3] and seen[-1][1] == r.value
