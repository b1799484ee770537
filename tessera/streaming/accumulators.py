"""One-pass accumulators as streaming aggregations, with event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.sketch import RunningMedian, _cells, _digest
from ..operators.stats import double_statistics


def file_stream(spark: SparkSession, path: str, pattern: str = "*.parquet", files_per_trigger: int = 16) -> DataFrame:
    """A stream of Parquet files, a bounded number a batch."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_statistics(df: DataFrame, ts: str, x: str, keys: list[str], window: str, late: str, slide: str | None = None) -> DataFrame:
    """double_statistics by tumbling (or, with slide, sliding) event-time window; rows
    later than `late` behind the stream are dropped, and state is bounded by it."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    aggregates = [c.alias(n) for n, c in double_statistics(F.col(x).cast("double")).items()]
    return df.withWatermark(ts, late).groupBy(w.alias("window"), *keys).agg(*aggregates)


def session_statistics(df: DataFrame, ts: str, x: str, keys: list[str], gap: str, late: str) -> DataFrame:
    aggregates = [c.alias(n) for n, c in double_statistics(F.col(x).cast("double")).items()]
    return df.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates)


def windowed_covariance(df: DataFrame, ts: str, columns: list[str], keys: list[str], window: str, late: str) -> DataFrame:
    """window, keys, n and covariances array<struct<i, j, covariance>> for i <= j of the
    rows without a null; the state of a group is its sums."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    both = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias("covariance")) for a, b in pairs]
    whole = df.withWatermark(ts, late).dropna(subset=columns)
    return whole.groupBy(F.window(ts, window).alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"), F.array(*both).alias("covariances"))


def windowed_count_min(df: DataFrame, ts: str, item: str, window: str, late: str, depth: int = 5, width: int = 2000, seed: int = 0) -> DataFrame:
    """window, row, col, count: a count-min table for each window, depth x width counters
    of state at most. operators.sketch reads it, and tables of windows add up."""
    cells = df.withWatermark(ts, late).select(F.col(ts), F.inline(_cells(F.col(item), depth, width, seed)))
    return cells.groupBy(F.window(ts, window).alias("window"), "row", "col").agg(F.count(F.lit(1)).alias("count"))


def running_digests(df: DataFrame, key: str, x: str, compression: float = 50.0) -> DataFrame:
    """key, n and centroids after each batch, as t_digest gives them: some hundred
    centroids of state a key, whatever its rows. NaN and nulls are left out."""

    def update(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        means, weights = (np.array(v, dtype=float) for v in state.get) if state.exists else (np.zeros(0), np.zeros(0))
        for b in batches:
            v = b["x"].dropna().to_numpy(dtype=float)
            if len(v):
                means, weights = _digest(np.concatenate([means, v]), np.concatenate([weights, np.ones(len(v))]), compression)
        state.update((means.tolist(), weights.tolist()))
        yield pd.DataFrame({"key": [group[0]], "n": [int(weights.sum())], "means": [means.tolist()], "weights": [weights.tolist()]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"))
    kept = rows.groupBy("key").applyInPandasWithState(update, "key string, n long, means array<double>, weights array<double>", "means array<double>, weights array<double>", "update", GroupStateTimeout.NoTimeout)
    return kept.select("key", "n", F.arrays_zip(F.col("means").alias("mean"), F.col("weights").alias("weight")).alias("centroids"))


def running_medians(df: DataFrame, key: str, x: str) -> DataFrame:
    """key, n, median after each batch: five markers of state a key."""

    def update(group, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = RunningMedian()
        if state.exists:
            m.n, first, m.q, m.at = (v if isinstance(v, int) else list(v) for v in state.get)
            m.first = first
        for b in batches:
            for v in b["x"].dropna():
                m.accept(float(v))
        state.update((m.n, m.first, m.q, m.at))
        yield pd.DataFrame({"key": [str(group[0])], "n": [m.n], "median": [m.median()]})

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(x).cast("double").alias("x"))
    return rows.groupBy("key").applyInPandasWithState(update, "key string, n long, median double", "n long, first array<double>, q array<double>, at array<int>", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "complete", timeout_s: int = 120) -> DataFrame:
    """Runs a stream over what is there into a memory table, for checks and tests."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        if not q.awaitTermination(timeout_s):
            raise TimeoutError(name)
    finally:
        q.stop()
    return spark.table(name)
