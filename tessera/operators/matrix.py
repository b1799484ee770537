"""Matrices as tables (i, j, v) of their entries, 0-based; and LAPACK-size helpers.

A product joins on the inner index and sums: both sides are dealt by that index,
and partial sums leave each task once for each (i, j) it met.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def identity(spark: SparkSession, n: int, value: float = 1.0, kind: str = "double") -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(value).cast(kind).alias("v"))


def from_rows(df: DataFrame, row: str, vector: str) -> DataFrame:
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(vector).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def to_rows(m: DataFrame) -> DataFrame:
    """i and its entries by j."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))


def entry(m: DataFrame, i: int, j: int) -> DataFrame:
    return m.where((F.col("i") == i) & (F.col("j") == j))


def set_entry(m: DataFrame, i: int, j: int, v: float) -> DataFrame:
    return m.withColumn("v", F.when((F.col("i") == i) & (F.col("j") == j), F.lit(v)).otherwise(F.col("v")))


def scale(m: DataFrame, alpha: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * alpha)


def absolute(m: DataFrame) -> DataFrame:
    return m.withColumn("v", F.abs("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def add(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Absent entries are 0."""
    return a.unionByName(b.withColumn("v", F.col("v") * sign)).groupBy("i", "j").agg(F.sum("v").alias("v"))


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b, -1)


def add_to_columns(a: DataFrame, vector: DataFrame) -> DataFrame:
    """vector (i, v) added to each column."""
    return a.join(vector.select("i", F.col("v").alias("__w")), "i").select("i", "j", (F.col("v") + F.col("__w")).alias("v"))


def multiply(a: DataFrame, b: DataFrame, trans_a: bool = False, trans_b: bool = False, alpha: float = 1.0) -> DataFrame:
    """alpha op(a) op(b)."""
    ai, ak = ("j", "i") if trans_a else ("i", "j")
    bk, bj = ("j", "i") if trans_b else ("i", "j")
    left = a.select(F.col(ai).alias("i"), F.col(ak).alias("__k"), F.col("v").cast("double").alias("__a"))
    right = b.select(F.col(bk).alias("__k"), F.col(bj).alias("j"), F.col("v").cast("double").alias("__b"))
    return left.join(right, "__k").groupBy("i", "j").agg((alpha * F.sum(F.col("__a") * F.col("__b"))).alias("v"))


def gemm(a: DataFrame, b: DataFrame, c: DataFrame, alpha: float = 1.0, beta: float = 0.0, trans_a: bool = False, trans_b: bool = False) -> DataFrame:
    """alpha op(a) op(b) + beta c."""
    product = multiply(a, b, trans_a, trans_b, alpha)
    return product if beta == 0 else add(product, scale(c, beta))


def trmm(t: DataFrame, b: DataFrame, left: bool = True, upper: bool = True, trans: bool = False, unit: bool = False, alpha: float = 1.0) -> DataFrame:
    """alpha op(T) B or alpha B op(T), with T triangular: entries on the other side
    aren't read; with unit the diagonal counts as ones."""
    part = t.where((F.col("i") < F.col("j")) if upper else (F.col("i") > F.col("j"))) if unit else t.where((F.col("i") <= F.col("j")) if upper else (F.col("i") >= F.col("j")))
    if unit:
        ends = t.agg(F.max(F.greatest("i", "j")).alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("i"))
        part = part.unionByName(ends.select("i", F.col("i").alias("j"), F.lit(1.0).alias("v")))
    return multiply(part, b, trans_a=trans, alpha=alpha) if left else multiply(b, part, trans_b=trans, alpha=alpha)


def approximately_equal(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """One row: whether no entries differ by more."""
    return minus(a, b).agg(F.coalesce(F.max(F.abs("v")) <= tolerance, F.lit(True)).alias("equal"))


def single(m: DataFrame) -> DataFrame:
    """Entries as 32-bit floats. Sums of products run in double and are rounded once,
    so single(gemm(single(a), ...)) is at least as exact as a float accumulation."""
    return m.withColumn("v", F.col("v").cast("float"))


def symmetry_error(a: DataFrame) -> DataFrame:
    return minus(a, transpose(a)).agg(F.max(F.abs("v")).alias("symmetry_error"))


def vectors(column, dimension: int) -> np.ndarray:
    """An Arrow list column as a matrix, without a Python object for each row."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if column.null_count or len(x) != len(column) * dimension:
        raise ValueError(f"every vector must have {dimension} entries")
    return x.reshape(-1, dimension)


def summed(df: DataFrame, columns: list[str], size: int, part) -> np.ndarray:
    """The sum over all rows of an array of so many numbers; part(batch) is an Arrow
    batch's share. Added up by position on the executors."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += part(b).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["p", "v"])

    out = np.zeros(size)
    for r in df.select(*columns).mapInArrow(run, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).collect():  # size rows
        out[r.p] = r.v
    return out


def gram(df: DataFrame, vector: str, dimension: int) -> np.ndarray:
    """Sum of x x^T over rows: partial products, one small matrix for each task."""

    def part(b):
        x = vectors(b.column(0), dimension)
        return x.T @ x

    return summed(df, [vector], dimension * dimension, part).reshape(dimension, dimension)


def tall_qr(df: DataFrame, vector: str, dimension: int) -> np.ndarray:
    """R of the rows' QR factorisation: each task's R, then R of those stacked in
    groups, so that no step holds more than a group of small triangles."""
    import pyarrow as pa

    def squeeze(x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(x, mode="r") if len(x) > dimension else x

    def first(batches):
        r, more = np.zeros((0, dimension)), []
        for b in batches:
            if b.num_rows:
                more.append(vectors(b.column(0), dimension))
            if sum(map(len, more)) > 50_000:
                r, more = squeeze(np.vstack([r, *more])), []
        r = squeeze(np.vstack([r, *more]))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, r.size + 1, dimension, dtype=np.int32), pa.array(r.ravel()))], names=[vector])

    kind = f"`{vector}` array<double>"
    rs = df.select(F.col(vector).cast("array<double>").alias(vector)).mapInArrow(first, kind)
    parts = rs.rdd.getNumPartitions()
    while parts > 16:
        parts = max(1, parts // 16)
        rs = rs.coalesce(parts).mapInArrow(first, kind)
    rows = [r[0] for r in rs.collect()]  # 16 triangles at most
    r = squeeze(np.array(rows, dtype=float).reshape(-1, dimension))
    sign = np.sign(np.diag(r[: min(r.shape)])) if len(r) else np.zeros(0)
    return r * np.where(sign == 0, 1, sign)[:, None] if len(r) == len(sign) else r


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower factor; not symmetric (1e-10) or not positive is an error."""
    if not np.allclose(a, a.T, rtol=0, atol=1e-10 * max(1.0, float(np.abs(a).max(initial=0)))):
        raise ValueError("not symmetric")
    return np.linalg.cholesky(a)


def fix_signs(v: np.ndarray) -> np.ndarray:
    """Columns with their largest entry positive."""
    if not v.size:
        return v
    top = np.abs(v).argmax(0)
    s = np.sign(v[top, np.arange(v.shape[1])])
    return v * np.where(s == 0, 1, s)


def symmetric_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues descending, and vectors as columns."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return w[::-1], fix_signs(v[:, ::-1])


def tall_svd(df: DataFrame, vector: str, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values descending and right vectors (columns) of the rows, through
    tall_qr: the accuracy of an SVD of the whole matrix, not of its Gram matrix."""
    _, s, vt = np.linalg.svd(tall_qr(df, vector, dimension))
    return s, fix_signs(vt[: len(s)].T)


def left_vectors(df: DataFrame, vector: str, s: np.ndarray, v: np.ndarray) -> DataFrame:
    """Adds u, a row of U = A V / s; the factors are literals of p x k numbers."""
    cols = [F.array(*[F.lit(float(x)) for x in v[:, k] / (s[k] if s[k] > 0 else np.inf)]) for k in range(len(s))]
    fold = lambda c: F.aggregate(F.zip_with(vector, c, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, z: t + z)
    return df.withColumn("u", F.array(*[fold(c) for c in cols]))


def reconstructed(df: DataFrame, u: str, s: np.ndarray, v: np.ndarray, name: str) -> DataFrame:
    """Adds name, the row u S V^T: with every factor the row that u was made from."""
    cols = [F.array(*[F.lit(float(x)) for x in v[j] * s]) for j in range(len(v))]
    fold = lambda c: F.aggregate(F.zip_with(u, c, lambda x, y: x * y), F.lit(0.0), lambda t, z: t + z)
    return df.withColumn(name, F.array(*[fold(c) for c in cols]))


def reconstruction_error(df: DataFrame, vector: str, fitted: str) -> DataFrame:
    """One row: the Frobenius norm of what is left, relative to the rows' own; 0 for no rows."""
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x)
    left = F.zip_with(vector, fitted, lambda x, y: x.cast("double") - y)
    sums = df.agg(F.sum(square(left)).alias("left"), F.sum(square(F.transform(vector, lambda x: x.cast("double")))).alias("all"))
    return sums.select(F.coalesce(F.sqrt(F.try_divide("left", "all")), F.lit(0.0)).alias("error"))


def orthonormality_error(q: np.ndarray) -> float:
    """Largest entry of |Q^T Q - I|. For a tall Q of rows, pass its triangle by tall_qr."""
    return float(np.abs(q.T @ q - np.eye(q.shape[1])).max(initial=0))


def eigen_reconstruct(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (v * w) @ v.T


def eigen_reconstruction_error(a: np.ndarray, w: np.ndarray, v: np.ndarray) -> float:
    """|A - V L V^T| relative to |A|, Frobenius."""
    size = np.linalg.norm(a)
    return float(np.linalg.norm(a - eigen_reconstruct(w, v)) / (size if size > 0 else 1.0))


def eigen_residual_error(a: np.ndarray, w: np.ndarray, v: np.ndarray) -> float:
    """|A V - V L| relative to |A|, Frobenius."""
    size = np.linalg.norm(a)
    return float(np.linalg.norm(a @ v - v * w) / (size if size > 0 else 1.0))


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse, verified: the residual of A A^-1 - I is bounded."""
    out = np.linalg.inv(a)
    if np.abs(a @ out - np.eye(len(a))).max(initial=0) > 1.5 * np.sqrt(np.finfo(float).eps):
        raise ArithmeticError("singular to working precision")
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square: LU. Otherwise least squares or least norm; rank deficiency is an error."""
    if a.shape[0] == a.shape[1]:
        return np.linalg.solve(a, b)
    x, _, rank, _ = np.linalg.lstsq(a, b, rcond=None)
    if rank < min(a.shape):
        raise ArithmeticError("rank deficient")
    return x
