"""Line deduplication by range-partitioned hashes.

Every line that may repeat becomes a row (128-bit hash of its key, document,
positions). Rows are dealt by ranges of (hash, document descending), so that a
line that a third of all documents share is spread over as many partitions as
its rows need, and sorted within. A stream over a partition sees a key's largest
document first and decides the rest as it goes. Only the first and the last key
of a partition can reach into another one: for these it passes on a count and
the largest document, two rows a partition, which settle what is pending.
The result is a compressed bitmap for each document that loses lines.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import LOWER, SPACE, as_bytes, fresh, map_text, small_batches
from .storage import written

TAIL = bytes(range(0x80, 0xC0))
#: What a null id counts as: the smallest.
NO_ID = -(1 << 63)
KEYS = T.StructType([T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("positions", T.BinaryType())])
KEY_ARROW = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("positions", pa.binary())])
DROP, PENDING, SUMMARY = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE).translate(LOWER)
    if len(key) < min_chars or not key.isascii() and len(key.translate(None, TAIL)) < min_chars:
        return None
    return key


def text_tag(text_col: str) -> F.Column:
    """Tells rows with the same id and different texts apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def line_keys(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each document and key, with the key's line numbers as int32."""
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text_tag(text_col).alias("tag"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs_, tags, places = [], [], [], []
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                found: dict[bytes, list[int]] = {}
                for n, line in enumerate(text.split(b"\n") if text else ()):
                    if (key := line_key(line, min_chars)) is not None:
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(n)
                if found:
                    hashes += found
                    docs_ += [doc] * len(found)
                    tags += [tag] * len(found)
                    places += [np.array(p, dtype="<i4").tobytes() for p in found.values()]
            h = np.frombuffer(b"".join(hashes), dtype=">i8").reshape(-1, 2).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(docs_, pa.int64()), pa.array(tags, pa.int64()), pa.array(places, pa.binary())], schema=KEY_ARROW)

    return small_batches(source).mapInArrow(run, KEYS)


class Stream:
    """Decides the rows of one sorted partition; memory holds a batch and the rows
    of at most min_docs - 1 documents."""

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.key: tuple[int, int] | None = None
        self.first_key = True
        self.largest = self.last = 0
        self.n = 0
        self.held: list[pa.RecordBatch] = []

    def batch(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        hi, lo, doc = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        begin = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
        end = np.r_[begin[1:], len(hi)]
        head = 0
        if self.key == (int(hi[0]), int(lo[0])):
            yield from self.more(b.slice(0, int(end[0])), doc[: end[0]])
            head = 1
        if head == len(begin):
            return
        if self.key is not None:
            yield from self.close()
        # The runs between end within this batch; the last may go on in the next.
        inner = slice(head, len(begin) - 1)
        if self.key is None and inner.stop > inner.start:
            yield from self.open(b, hi, lo, doc, int(begin[head]), int(end[head]))
            yield from self.close()
            inner = slice(head + 1, inner.stop)
        if inner.stop > inner.start:
            a, z = int(begin[inner.start]), int(end[inner.stop - 1])
            starts = begin[inner] - a
            new = np.r_[True, doc[a + 1 : z] != doc[a : z - 1]]
            new[starts] = True
            sizes = np.diff(np.r_[starts, z - a])
            counts = np.repeat(np.add.reduceat(new.astype(np.int64), starts), sizes)
            lose = (counts >= self.min_docs) & (doc[a:z] != np.repeat(doc[a:z][starts], sizes))
            if lose.any():
                yield self.rows(DROP, b.slice(a, z - a).filter(pa.array(lose)))
        yield from self.open(b, hi, lo, doc, int(begin[-1]), int(end[-1]))

    def open(self, b, hi, lo, doc, a: int, z: int) -> Iterator[pa.RecordBatch]:
        self.first_key = self.key is None
        self.key = int(hi[a]), int(lo[a])
        self.largest, self.last, self.n, self.held = int(doc[a]), None, 0, []
        yield from self.more(b.slice(a, z - a), doc[a:z])

    def more(self, b: pa.RecordBatch, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.n += int((doc[1:] != doc[:-1]).sum()) + (self.last is None or int(doc[0]) != self.last)
        self.last = int(doc[-1])
        if self.first_key:  # an earlier partition may hold a larger document
            yield self.rows(PENDING, b)
            return
        self.held.append(b)
        if self.n >= self.min_docs:
            yield from self.flush(DROP)

    def flush(self, kind: int) -> Iterator[pa.RecordBatch]:
        for b in self.held:
            lose = b.column(2).to_numpy(zero_copy_only=False) != self.largest
            if lose.any():
                yield self.rows(kind, b.filter(pa.array(lose)))
        self.held = []

    def close(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if last and not self.first_key:
            yield from self.flush(PENDING)
        if last or self.first_key:
            one = pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*self.key, self.largest, self.n)] + [pa.array([b""], pa.binary())], schema=KEY_ARROW)
            yield self.rows(SUMMARY, one)
        self.held = []

    @staticmethod
    def rows(kind: int, b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, kind, dtype=np.int32)), *b.columns], names=["kind", *KEYS.fieldNames()])


def lost_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """doc, tag and positions of the lines that go."""
    dealt = keys.repartitionByRange("hi", "lo", F.col("doc").desc()).sortWithinPartitions("hi", "lo", F.col("doc").desc())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(min_docs)
        for b in batches:
            yield from stream.batch(b)
        if stream.key is not None:
            yield from stream.close(last=True)

    found = written(dealt.mapInArrow(run, T.StructType([T.StructField("kind", T.IntegerType()), *KEYS.fields])))
    # At most two rows a partition, whatever the input: small enough to broadcast.
    ends = found.where(F.col("kind") == SUMMARY).groupBy("hi", "lo").agg(F.sum("tag").alias("n"), F.max("doc").alias("largest")).where(F.col("n") >= min_docs)
    settled = found.where(F.col("kind") == PENDING).join(F.broadcast(ends), ["hi", "lo"]).where(F.col("doc") != F.col("largest"))
    out = ["doc", "tag", "positions"]
    return found.where(F.col("kind") == DROP).select(*out).unionByName(settled.select(*out))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc, tag, keep): for each document that loses lines, a zlib-compressed
    bitmap of the lines that stay; lines beyond its end stay.

    A line's key is the line without ASCII white space at both ends, A-Z in lower
    case. A key of min_chars or more code points in min_docs or more documents
    stays only in the largest id that has it (all its lines there). Null and empty
    texts have one empty line, which stays. A null id counts as the smallest.
    Rows with the same id are one document; tag (a hash of the text) tells their
    texts apart. Other columns are ignored.
    """
    lost = lost_lines(line_keys(docs, min_chars, id_col, text_col), min_docs)
    grouped = lost.groupBy("doc", "tag").agg(F.collect_list("positions").alias("lists"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maps = []
            for lists in b.column(2).to_pylist():
                gone = np.unique(np.concatenate([np.frombuffer(x, dtype="<i4") for x in lists]))
                keep = np.ones((int(gone[-1]) // 8 + 1) * 8, dtype=bool)  # whole bytes
                keep[gone] = False
                maps.append(zlib.compress(np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(maps, pa.binary())], names=["doc", "tag", "keep"])

    return grouped.mapInArrow(pack, T.StructType([T.StructField("doc", T.LongType()), T.StructField("tag", T.LongType()), T.StructField("keep", T.BinaryType())]))


def kept_text(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes | None]:
    """Lines before, lines dropped, and what stays."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8))[: len(lines)].tolist()
    bits += [1] * (len(lines) - len(bits))
    out = [x for x, b in zip(lines, bits, strict=True) if b]
    return len(lines), len(lines) - len(out), b"\n".join(out)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_lines (before), n_dropped, kept_text and kept_sha256 (of the kept
    text's UTF-8 bytes; a null text's digest is that of no bytes).

    One shuffle of the texts by id; each partition's bitmaps are hashed in memory.
    """
    wanted = docs if keep is None else docs.select(*dict.fromkeys([*keep, id_col, text_col]))
    tag, doc, other, bits = (fresh(wanted, n) for n in ("__tag", "__doc", "__other", "__keep"))
    tagged = wanted.withColumn(tag, text_tag(text_col))
    right = bitmaps.select(F.col("doc").alias(doc), F.col("tag").alias(other), F.col("keep").alias(bits))
    joined = tagged.join(right.hint("shuffle_hash"), (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)) == F.col(doc)) & (F.col(tag) == F.col(other)), "left").drop(doc, other, tag)

    def make():
        def each(texts, keeps):
            rows = [kept_text(t, k) for t, k in zip(texts, keeps, strict=True)]
            out = pa.array([r[2] for r in rows], pa.binary()).cast(pa.string())
            return [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), out, pa.array([hashlib.sha256(r[2] or b"").hexdigest() for r in rows], pa.string())]

        return each

    fields = [("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("kept_text", T.StringType()), ("kept_sha256", T.StringType())]
    return map_text(joined, make, fields, text_col, keep, [bits])
