"""Small tables of fixed size, made by all tasks and held by each.

Counts or bits by hash bucket are added up in RANGES ranges of the buckets, so that
no task holds more than a few of them and the driver gets one row a range, of a size
that the number of buckets alone decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGES = 64
#: Buckets of a bit table: 8 MB, whatever the number of keys.
KEY_BITS = 26


def in_ranges(parts: DataFrame, width: int, add: Callable[[np.ndarray, bytes, bytes], None], finish: Callable[[np.ndarray], np.ndarray], dtype) -> np.ndarray:
    """parts: rng, at (uint32 places of the range, as bytes), n (what belongs to them);
    their sum over all rows, one array of width places a range, in the ranges' order."""
    names = ["rng", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for r, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r not in held:
                    held[r] = np.zeros(width, dtype=dtype)
                add(held[r], at, n)
        for r, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([finish(x).tobytes()], pa.binary())], names=names)

    first = finish(np.zeros(width, dtype=dtype))
    out = np.zeros((RANGES, len(first)), dtype=first.dtype)
    for row in parts.repartition("rng").mapInArrow(run, "rng int, body binary").collect():  # RANGES rows of one size
        out[row.rng] = np.frombuffer(row.body, dtype=first.dtype)
    return out.reshape(-1)


def split(places: np.ndarray, counts: np.ndarray | None, width: int) -> pa.RecordBatch:
    """Sorted places (and their counts) as rows rng, at, n."""
    edges = np.searchsorted(places, np.arange(RANGES + 1) * width)
    used = [r for r in range(RANGES) if edges[r] < edges[r + 1]]
    cut = [slice(edges[r], edges[r + 1]) for r in used]
    at = [(places[c] - r * width).astype(np.uint32).tobytes() for r, c in zip(used, cut, strict=True)]
    n = [b"" if counts is None else counts[c].astype(np.int64).tobytes() for c in cut]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["rng", "at", "n"])


PARTS = "rng int, at binary, n binary"


def key_hash(*columns: Column) -> Column:
    """64 bits that stand for a key; nulls count as values."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def key_table(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for each of two places of each hash in column."""
    width = (1 << KEY_BITS) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield split(np.unique(np.concatenate(places(b.column(0).to_numpy()))), None, width)

    def add(x: np.ndarray, at: bytes, _: bytes) -> None:
        x[np.frombuffer(at, dtype=np.uint32)] = 1

    return in_ranges(keys.select(column).mapInArrow(run, PARTS), width, add, np.packbits, np.uint8)


def places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = h.view(np.uint64)
    return (u >> np.uint64(64 - KEY_BITS)).astype(np.int64), (u & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)


def maybe(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """False where a key is surely not in the table."""
    out = np.ones(len(h), dtype=bool)
    for at in places(h):
        out &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out
