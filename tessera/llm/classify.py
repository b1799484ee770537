"""What the two compression classifiers share: labelled samples, compressors,
logistic calibration."""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a classifier is fitted on at most, the same number of
#: each class if there are so many; they're chosen by a hash of the id.
SAMPLE_DOCS = 3000
#: Characters of a sampled document that training reads: a stretch at a hashed place.
#: Scoring reads whole texts.
SAMPLE_BYTES = 6000


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text modulo n; -1 for a null id, which is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(-1))


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, size: int = SAMPLE_DOCS) -> tuple[list[bytes], list[bytes]]:
    """Texts of label 1 and of label 0, of rows that aren't held out: at most size
    rows a class and SAMPLE_BYTES of each, whatever the input's size."""
    order = F.xxhash64(F.lit(label), F.col("doc_id"))
    out = []
    for value in (1, 0):
        ids = (
            labels.where((F.col(label) == value) & (bucket(F.col("doc_id"), modulus) != held))
            .select("doc_id").dropDuplicates().orderBy(order, "doc_id").limit(size)
        )
        # ids has at most size rows: a broadcast of a proven size.
        start = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(0)).cast("long") + 1)
        rows = (
            docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
            .select(F.col("doc_id"), F.substr("text", (start + 1).cast("int"), F.lit(SAMPLE_BYTES)).alias("t"))
            .groupBy("doc_id").agg(F.min("t").alias("t"))
        )
        out.append([r.t.encode() for r in sorted(rows.toLocalIterator(), key=lambda r: r.doc_id) if r.t])
    return out[0], out[1]


def shares(labels: DataFrame, label: str, modulus: int, held: int) -> float:
    """log(rows of label 1 / rows of label 0) among all labels that aren't held out."""
    n = dict(labels.where(bucket(F.col("doc_id"), modulus) != held).where(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int")).count().collect())
    return math.log((n.get(1, 0) + 0.5) / (n.get(0, 0) + 0.5))


def rebased(curve: tuple, now: float, sampled: tuple[int, int]) -> tuple:
    """The curve for other class shares than the sample's: now is their log ratio."""
    w, mean, scale = curve
    w = w.copy()
    w[0] += now - math.log((sampled[0] + 0.5) / (sampled[1] + 0.5))
    return w, mean, scale


def compressor(content: bytes, raw: bool = False, **params) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_AUTO
    made = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **params)
    held = zstandard.ZstdCompressionDict(content, dict_type=kind)
    held.precompute_compress(compression_params=made)
    return zstandard.ZstdCompressor(compression_params=made, dict_data=held)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (constant first), means and scales of the features, by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(z.shape[1])
    pen = ridge * len(x) * np.r_[0, np.ones(x.shape[1])]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen + 1e-9), z.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w, mean, scale


def probability(model: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    w, mean, scale = model
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean) / scale) @ w[1:], -30, 30)))
