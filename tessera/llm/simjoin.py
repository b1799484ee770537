"""Set-similarity self-join of documents on word shingles, as connected components.

A grouped prefix join. Shingle hashes have one total order (rare classes first,
by a sketch of their counts, then by value); two sets that are similar enough
share a hash in their prefixes. Documents of equal sets are one node, nodes of
equal prefix and size one group, and only group prefixes are posted: as blocks of
whole lists for rare hashes, as rows for hot ones. Pairs of groups pass filters that
never lose a link (size, position, and a lower bound of the symmetric difference from
parity bits); only then are they expanded to pairs of members, which pass the same
bound, and what is left is verified on the whole texts.

So that copies of one text never make all their pairs, links are found in two
rounds. First each posting list proposes one leader to each of its groups; the
verified links make components. Then only pairs between different components
are candidates. The result is exact: a pair that shares a posting list is
verified, excluded by a safe bound, or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import LOWER, as_bytes, small_batches
from .components import connected_components
from .keybits import PARTS, RANGES, in_ranges, key_hash, key_table, maybe, split
from .storage import remove_tables, tables_now, written

#: What a null id counts as: the smallest.
NO_ID = -(1 << 63)
#: Buckets of the count sketch: a fixed size, whatever the input.
SKETCH_BITS = 22
#: A task reports buckets of at least TASK_COUNT; those of HOT_COUNT in all are hot.
TASK_COUNT, HOT_COUNT = 8, 32
#: Parity bits for each difference that a link may have: of all nodes, and of those that
#: have a partner by these; and the least number of them.
PARITY, PARITY_FINE, PARITY_LEAST = 3, 32, 64
#: Bytes of parity bits at most that go with each entry of a list, first and then with
#: those that have a partner: a long document has many entries. Lists of an entry's group
#: that go with it at most.
POSTED_BITS, POSTED_FINE, POSTED_LISTS = 256, 1024, 64
#: Bytes that a task holds of units before it hands them on.
UNIT_BYTES = 32 << 20
#: Rows of long parity bits in an Arrow batch.
LONG = 500
#: Postings of a block of whole lists, and of a task before it hands on its blocks.
BLOCK_POSTINGS, HELD_POSTINGS = 500_000, 1_000_000
#: Postings of one list that one task compares; longer lists are cut.
BLOCK = 4096
#: A leader is proposed to a group that shares this part of the prefix with it.
LEADER_SHARE = 0.3
WORDS_MAX = 300_000
#: Rows of numbers in an Arrow batch.
WIDE = 10_000

U = np.uint64


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_MAX:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_word_hashes = WordHashes()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all its words
    if there are fewer; none without words."""
    words = text.translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, dtype=U)
    ids = np.fromiter(map(_word_hashes.__getitem__, words), dtype=U, count=len(words))
    width = min(k, len(words))
    n = len(ids) - width + 1
    h = np.full(n, width, dtype=U)
    for j in range(width):
        h = mixed(h * U(0x9E3779B97F4A7C15) + ids[j : j + n])
    return np.unique(h)


def sketch_place(h: np.ndarray) -> np.ndarray:
    return (h >> U(64 - SKETCH_BITS)).astype(np.int64)


def hot_classes(docs: DataFrame, k: int) -> np.ndarray:
    """For each bucket of the sketch 0, or the binary order of its count if hot."""
    width = (1 << SKETCH_BITS) // RANGES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for b in batches:
            for text in as_bytes(b.column(0)):
                np.add.at(counts, sketch_place(shingles(text, k)), 1)
        at = np.flatnonzero(counts >= TASK_COUNT)
        yield split(at, counts[at], width)

    def add(x: np.ndarray, at: bytes, n: bytes) -> None:
        x[np.frombuffer(at, dtype=np.uint32)] += np.frombuffer(n, dtype=np.int64)

    def finish(x: np.ndarray) -> np.ndarray:
        return np.where(x >= HOT_COUNT, np.frexp(x.astype(np.float64))[1], 0).astype(np.uint8)

    return in_ranges(small_batches(docs.select("text")).mapInArrow(run, PARTS), width, add, finish, np.int64)


class Similarity:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def least(self, both):
        """Least intersection of two sets whose sizes add up to both."""
        return -(-self.num * both // (self.num + self.den))

    def apart(self, both):
        """Most differences of two sets whose sizes add up to both."""
        return both - 2 * self.least(both)


def parity(h: np.ndarray, like: Similarity, each: int = PARITY) -> bytes:
    """For each of 2^m cells whether an odd number of hashes falls in it: two sets
    differ by at least as many hashes as cells differ."""
    bits = max(PARITY_LEAST, 1 << (each * int(like.apart(2 * len(h)))).bit_length())
    odd = np.bincount((h & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lower bounds of the symmetric differences of pairs, from their parity bits; the
    finer one is folded."""
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)]).reshape(-1, 2)
    out = np.zeros(len(sizes), dtype=np.int64)
    for wa, wb in np.unique(sizes, axis=0):
        at = np.flatnonzero((sizes[:, 0] == wa) & (sizes[:, 1] == wb))
        w = min(wa, wb)
        x, y = (np.bitwise_xor.reduce(np.frombuffer(b"".join(s[r] for r in at), dtype=np.uint8).reshape(len(at), -1, w), axis=1) for s in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return out


def folded(nodes: DataFrame, most: int) -> DataFrame:
    """sid and bits of nodes, folded to so many bytes at most."""

    def fold(x: bytes) -> bytes:
        return x if len(x) <= most else np.bitwise_xor.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, most)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(fold, b.column(1).to_pylist()), pa.binary())], names=["sid", "bits"])

    return small_batches(nodes.select("sid", "bits")).mapInArrow(run, "sid long, bits binary")


def halves(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def doc_sets(docs: DataFrame, k: int, like: Similarity, classes: np.ndarray) -> DataFrame:
    """docs: doc, key, text. doc, key, n, digest of the set, prefix in the common order,
    how many of its hashes are rare, the prefix's digest, parity bits."""
    held = docs.sparkSession.sparkContext.broadcast(classes)
    names = ["doc", "key", "n", "hi", "lo", "prefix", "rare", "p_hi", "p_lo", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = held.value
        for b in batches:
            rows = []
            for text in as_bytes(b.column(2)):
                h = shingles(text, k)
                n = len(h)
                if n:
                    c = order[sketch_place(h)]
                    cold = h[c == 0]
                    p, rare = like.prefix(n), len(cold)
                    if len(cold) < p:
                        hot = h[c > 0]
                        cold = np.concatenate([cold, hot[np.lexsort((hot, c[c > 0]))]])
                    first = cold[:p].view(np.int64)
                    rows.append((n, *halves(h.tobytes()), first, min(rare, p), *halves(first.tobytes()), parity(h, like)))
                else:
                    rows.append((0, 0, 0, np.zeros(0, dtype=np.int64), 0, 0, 0, b""))
            cols = list(zip(*rows, strict=True)) or [()] * 8
            offsets = np.cumsum([0, *map(len, cols[3])])
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*cols[3], np.zeros(0, dtype=np.int64)]), pa.int64()))
            whole = lambda j: pa.array(cols[j], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cols[0], pa.int32()), whole(1), whole(2), tokens, pa.array(cols[4], pa.int32()), whole(5), whole(6), pa.array(cols[7], pa.binary())], names=names)

    schema = "doc long, key long, n int, hi long, lo long, prefix array<long>, rare int, p_hi long, p_lo long, bits binary"
    return small_batches(docs.select("doc", "key", "text")).mapInArrow(run, schema)


def wide(df: DataFrame, rows: int = WIDE) -> DataFrame:
    """df, whose rows of numbers are handed to Python in longer batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that bytes that seldom change lie together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpacked(raw: bytes, dtype, each: int = 1) -> np.ndarray:
    """What packed() got, as rows of so many numbers each."""
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(dtype).itemsize * each, -1).T).reshape(-1).view(dtype)


POSTED = "list long, gid long, n int, pos int, leader long"


def rare_postings(groups: DataFrame, blocks: int, like: Similarity) -> DataFrame:
    """groups: gid, n, weight, prefix (its rare hashes). Entries of the lists of two
    groups or more that have a partner near in size and position, with the list's leader:
    the group of most weight. A list lies in one of so many blocks; a rare hash is one of
    which no task saw TASK_COUNT, so its list is short."""
    names = ["block", "lists", "gids", "rest"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            lists, gids, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(lists)
            lists, gids, rest = lists[order], gids[order], rest[order]
            block = (lists >> U(32)) * U(blocks) >> U(32)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for at in range(0, len(cuts) - 1, 100):
                rows = [(int(block[i]), packed(np.diff(lists[i:j], prepend=U(0))), packed(gids[i:j]), packed(rest[i:j])) for i, j in zip(cuts[at : at + 100], cuts[at + 1 : at + 101], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

        for b in batches:
            gid, size, weight = (b.column(j).to_numpy() for j in range(3))
            offsets = b.column(3).offsets.to_numpy()
            lists = b.column(3).values.to_numpy()[offsets[0] : offsets[-1]].view(U)
            counts = np.diff(offsets)
            if len(lists):
                pos = np.arange(len(lists)) - np.repeat(offsets[:-1] - offsets[0], counts)
                rest = np.stack([np.repeat(size, counts), pos, np.repeat(weight, counts)], 1).astype(np.int32)
                held.append((lists, np.repeat(gid, counts), rest))
                n += len(lists)
                if n >= HELD_POSTINGS:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    def lists_of(held: list) -> Iterator[pa.RecordBatch]:
        lists = np.concatenate([np.cumsum(unpacked(x, U), dtype=U) for x, _, _ in held])
        gids = np.concatenate([unpacked(x, np.int64) for _, x, _ in held])
        rest = np.concatenate([unpacked(x, np.int32, 3).reshape(-1, 3) for _, _, x in held])
        _, inverse, counts = np.unique(lists, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        lists, gids, rest = lists[twice], gids[twice], rest[twice]
        order = np.lexsort((gids, -rest[:, 2], lists))
        _, first, inverse = np.unique(lists[order], return_index=True, return_inverse=True)
        leader = np.empty_like(gids)
        leader[order] = gids[order][first][inverse]
        order = np.lexsort((gids, rest[:, 0], lists))
        lists, gids, rest, leader = lists[order].view(np.int64), gids[order], rest[order], leader[order]
        zero = np.zeros(len(lists), dtype=np.int64)
        keep = np.zeros(len(lists), dtype=bool)
        for i, j in near_pairs((lists, zero), rest[:, 0].astype(np.int64), rest[:, 1].astype(np.int64), None, None, None, like):
            keep[i] = keep[j] = True
        t = pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (lists, gids, rest[:, 0], rest[:, 1], leader)], names=["list", "gid", "n", "pos", "leader"])
        for at in range(0, t.num_rows, WIDE):
            yield t.slice(at, WIDE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != block:
                    if held:
                        yield from lists_of(held)
                    block, held = row[0], []
                held.append(row[1:])
        if held:
            yield from lists_of(held)

    dealt = wide(groups.select("gid", "n", "weight", "prefix")).mapInArrow(pack, "block int, lists binary, gids binary, rest binary").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(gather, POSTED)


def hot_postings(groups: DataFrame) -> DataFrame:
    """groups: gid, n, weight, rare, prefix (its hot hashes). Entries of hot lists of two
    groups or more, as rare_postings() gives them."""
    posted = groups.select("gid", "n", "weight", "rare", F.posexplode("prefix").alias("at", "list"))
    lists = posted.groupBy("list").agg(F.count(F.lit(1)).alias("entries"), F.min(F.struct(-F.col("weight"), F.col("gid"))).alias("first")).where("entries > 1").select("list", F.col("first.gid").alias("leader"))
    return posted.join(lists, "list").select("list", "gid", "n", (F.col("rare") + F.col("at")).alias("pos"), "leader")


def texts_of(source: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid and text (compressed) of the nodes whose sid wanted names. source: doc, key,
    text. A bit table of fixed size lets only the wanted documents and few others into
    the join."""
    keyed = written(nodes.join(wanted, "sid", "left_semi").select("sid", F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), key_hash(F.col("first.doc"), F.col("first.key")).alias("h")))
    held = source.sparkSession.sparkContext.broadcast(key_table(keyed, "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, small = held.value, zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(maybe(table, b.column(2).to_numpy())))
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([small.compress(t) for t in as_bytes(b.column(3))], pa.binary())], names=["doc", "key", "body"])

    found = small_batches(source.where(F.col("text").isNotNull()).select("doc", "key", key_hash(F.col("doc"), F.col("key")).alias("h"), "text")).mapInArrow(run, "doc long, key long, body binary")
    return found.join(keyed.select("sid", "doc", "key"), ["doc", "key"]).groupBy("sid").agg(F.first("body").alias("body"))


def verified(pairs: DataFrame, texts: DataFrame, k: int, like: Similarity) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left = texts.select(F.col("sid").alias("a"), F.col("body").alias("x"))
    right = texts.select(F.col("sid").alias("b"), F.col("body").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor()
        for batch in batches:
            ok, before, u = [], None, None
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != before:
                    before, u = x, shingles(whole.decompress(x), k)
                both = np.sort(np.concatenate([u, shingles(whole.decompress(y), k)]))
                ok.append(int((both[1:] == both[:-1]).sum()) >= like.least(len(both)))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return small_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")).mapInArrow(run, "a long, b long")


def fine_parity(texts: DataFrame, k: int, like: Similarity) -> DataFrame:
    """sid, n and finer parity bits of nodes, from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = zstandard.ZstdDecompressor()
        for b in batches:
            sets = [shingles(whole.decompress(x), k) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int32()), pa.array([parity(h, like, PARITY_FINE) for h in sets], pa.binary())], names=["sid", "n", "bits"])

    return small_batches(texts.select("sid", "body")).mapInArrow(run, "sid long, n int, bits binary")


def near_enough(pairs: DataFrame, nodes: DataFrame, like: Similarity, rows: int = WIDE) -> DataFrame:
    """The pairs (a, b) of nodes that their sizes and parity bits don't exclude; so many go to Python at once."""
    side = lambda a: nodes.select(F.col("sid").alias(a), F.col("n").alias(f"n{a}"), F.col("bits").alias(f"bits{a}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                both = b.column(2).to_numpy().astype(np.int64) + b.column(3).to_numpy()
                ok = differences(b.column(4).to_pylist(), b.column(5).to_pylist()) <= like.apart(both)
                yield b.select([0, 1]).filter(pa.array(ok))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    fits = (F.least("na", "nb") * like.den >= F.greatest("na", "nb") * like.num)
    return wide(joined.where(fits), rows).mapInArrow(run, "a long, b long")


def units(batches: Iterator[pa.RecordBatch], least: int = 20_000, most: int = UNIT_BYTES) -> Iterator[pa.Table]:
    """Tables of whole units (list, block), of rows sorted by them: at least so many
    rows or bytes where there are as many, and one unit more at most."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        size += b.nbytes
        if n < least and size < most:
            continue
        t = pa.Table.from_batches(held)
        x, y = t["list"].to_numpy(), t["block"].to_numpy()
        cuts = np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        if len(cuts):
            cut = int(cuts[-1]) + 1
            yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            n -= cut
            size = sum(x.nbytes for x in held)
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(unit: tuple, n: np.ndarray, pos: np.ndarray, c1: np.ndarray | None, c2: np.ndarray | None, side: np.ndarray | None, like: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of pairs of a unit that size and position don't exclude, that
    aren't of one component only (c1 to c2) and whose sides may meet. Rows of a unit are
    sorted by size: pairs d rows apart are compared at once, for d = 1, 2, ... while any
    are near enough in size."""
    u0, u1 = unit
    i = np.arange(len(n))
    d = 0
    while len(i):
        d += 1
        i = i[i + d < len(n)]
        j = i + d
        live = (u0[i] == u0[j]) & (u1[i] == u1[j]) & (like.den * n[i] >= like.num * n[j])
        i = i[live]  # rows further on are larger still
        j = i + d
        most = np.minimum(pos[i], pos[j]) + 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1)
        ok = most >= like.least(n[i] + n[j])
        if c1 is not None:
            ok &= (c1[i] != c1[j]) | (c1[i] != c2[i]) | (c1[j] != c2[j])
            s, t = side[i], side[j]
            ok &= ((s >> 1 == -1) | (s >> 1 != t >> 1)) & ((s & 1 == 0) | (t & 1 == 0))
        if ok.any():
            yield i[ok], j[ok]


UNIT = ["list", "block", "side", "gid", "n", "pos", "c1", "c2", "bits"]


def open_pairs(t: pa.Table, like: Similarity) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of units' entries that no bound excludes. Groups of
    several members have no bits, and only sizes and positions bound them."""
    unit = (t["list"].to_numpy(), t["block"].to_numpy())
    n, pos, c1, c2, side = (t[c].to_numpy().astype(np.int64) for c in ("n", "pos", "c1", "c2", "side"))
    bits = t["bits"].to_pylist()
    for i, j in near_pairs(unit, n, pos, c1, c2, side, like):
        for at in range(0, len(i), 20_000):
            u, v = i[at : at + 20_000], j[at : at + 20_000]
            keep = np.array([bits[x] is None or bits[y] is None for x, y in zip(u, v, strict=True)])
            known = np.flatnonzero(~keep)
            if len(known):
                x, y = u[known], v[known]
                keep[known] = differences([bits[r] for r in x], [bits[r] for r in y]) <= like.apart(n[x] + n[y])
            yield u[keep], v[keep]


def with_partner(entries: DataFrame, like: Similarity) -> DataFrame:
    """The entries (UNIT) that have a partner, without their bits."""
    rows = wide(entries.repartition("list", "block").sortWithinPartitions("list", "block", "n", "gid").select(*UNIT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            keep = np.zeros(t.num_rows, dtype=bool)
            for i, j in open_pairs(t, like):
                keep[i] = keep[j] = True
            yield from t.select(UNIT[:-1]).filter(pa.array(keep)).to_batches(WIDE)

    return rows.mapInArrow(run, entries.select(*UNIT[:-1]).schema)


def least_common(x: tuple[frozenset, int | None], y: tuple[frozenset, int | None], here: int) -> int:
    """The least list of two groups that are both in the list here. x, y: the group's
    least lists, and the greatest of these if it has others. Where they have none in
    common up to there, it isn't known, and here is taken for it."""
    to = min((z for z in (x[1], y[1]) if z is not None), default=here)
    return min((z for z in x[0] & y[0] if z <= to), default=here)


def group_pairs(entries: DataFrame, like: Similarity) -> DataFrame:
    """entries (UNIT, lists: the least lists of the group, in_lists: how many it is in):
    pairs of groups (a, b) that no bound excludes, once each: a pair is taken in the least
    list that both are in. (Where a bound excludes it in one of their lists, it can't link.)
    Where that list isn't known, it is taken in several, and once in the end."""
    rows = wide(entries.repartition("list", "block").sortWithinPartitions("list", "block", "n", "gid").select(*UNIT, "lists", "in_lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in units(batches):
            gid, at = t["gid"].to_numpy(), t["list"].to_numpy()
            lists: dict[int, tuple[frozenset, int | None]] = {}
            for i, j in open_pairs(t, like):
                for r in np.unique(np.concatenate([i, j])):
                    if gid[r] not in lists:
                        own = t["lists"][int(r)].as_py()
                        lists[gid[r]] = frozenset(own), max(own) if t["in_lists"][int(r)].as_py() > len(own) else None
                least = np.fromiter((least_common(lists[x], lists[y], z) for x, y, z in zip(gid[i], gid[j], at[i], strict=True)), dtype=np.int64, count=len(i))
                mine = least == at[i]
                i, j = i[mine], j[mine]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(gid[i], gid[j])), pa.array(np.maximum(gid[i], gid[j]))], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def cut_lists(entries: DataFrame, like: Similarity) -> DataFrame:
    """Entries of long lists with the units of work they go to (UNIT without bits).

    A list is cut by size first: sizes of one range meet each other, and those of the
    range below come as visitors. What is still long is cut into blocks: entries of the
    unit's largest component, which need not meet each other, and the others; each
    block of others meets itself and all other blocks. Ranges of one component only are
    left out before any entry is doubled for the range that it visits."""
    ratio = float(np.log(like.den / like.num)) * (1 + 1e-9)  # two sizes that may link are never two ranges apart
    own = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    base = entries.withColumn("own", own)
    one = F.when(F.col("c1") == F.col("c2"), F.col("c1"))
    ranges = base.groupBy("list", "own", one.alias("c")).agg(F.count(F.lit(1)).alias("m"), F.min("c1").alias("c1"), F.max("c2").alias("c2"))
    visited = lambda d, v, by: d.withColumn("range", F.col("own") + by).withColumn("visits", F.lit(v))
    each = visited(ranges, 0, 0).unionByName(visited(ranges, 1, 1)).groupBy("list", "range", "c").agg(F.sum("m").alias("m"), F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.min("visits").alias("visits"))
    sums = (
        each.groupBy("list", "range")
        .agg(F.sum("m").alias("m"), F.max(F.struct(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0).alias("m"), F.col("c"))).alias("top"), F.min("c1").alias("c1"), F.max("c2").alias("c2"), F.min("visits").alias("visits"))
        .where((F.col("c1") != F.col("c2")) & (F.col("visits") == 0) & (F.col("m") > 1))
    )
    parts = lambda m: F.ceil(m / BLOCK).cast("int")
    short = F.col("m") <= BLOCK
    sums = sums.select("list", "range", F.when(short, F.lit(1)).otherwise(F.greatest(parts(F.col("m") - F.col("top.m")), F.lit(1))).alias("r"), F.when(short, F.lit(0)).otherwise(parts(F.col("top.m"))).alias("d"), F.col("top.c").alias("top"))
    wanted = sums.withColumn("visits", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("own", F.col("range") - F.col("visits"))
    sized = base.join(wanted, ["list", "own"])
    in_top = (F.col("d") > 0) & one.eqNullSafe(F.col("top")) & one.isNotNull()
    at = F.when(in_top, F.col("r") + F.pmod(F.xxhash64("gid"), F.greatest(F.col("d"), F.lit(1)))).otherwise(F.pmod(F.xxhash64("gid"), F.col("r"))).cast("int")
    dealt = sized.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(in_top, F.col("r")).otherwise(F.col("r") + F.col("d")) - 1)))
    lo, hi = F.least("at", "other"), F.greatest("at", "other")
    side = F.when(F.col("at") == F.col("other"), F.lit(-1)).when(F.col("at") == lo, F.lit(0)).otherwise(F.lit(1)) * 2 + F.col("visits")
    block = F.xxhash64("range", lo, hi)
    return dealt.withColumn("block", block).withColumn("side", side).select(*UNIT[:-1])


def listed(postings: DataFrame, groups: DataFrame, like: Similarity) -> DataFrame:
    """postings with what is known of their groups, in units of work (UNIT)."""
    known = lambda hot, *more: postings.where(hot).drop("n").join(groups.select("gid", "n", "c1", "c2", *more), "gid")
    rare = known("not hot", "bits").withColumn("block", F.lit(0).cast("long")).withColumn("side", F.lit(-2)).select(*UNIT)
    # Bits come last: a hot list has many entries, and most lists of near copies are of one component by now.
    hot = cut_lists(known("hot"), like).join(groups.select("gid", "bits"), "gid").select(*UNIT)
    return rare.unionByName(hot)


def member_pairs(groups_ab: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of members, of different components, of pairs of groups and of groups
    with several components."""
    side = lambda a: known.select(F.col("gid").alias(f"g{a}"), F.col("sid").alias(a), F.col("comp").alias(f"c{a}"))
    mixed_ = known.groupBy("gid").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 <> c2").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    wanted = groups_ab.select(F.col("a").alias("ga"), F.col("b").alias("gb")).unionByName(mixed_)
    pairs = wanted.join(side("a"), "ga").join(side("b"), "gb").where((F.col("ca") != F.col("cb")) & ((F.col("ga") != F.col("gb")) | (F.col("a") < F.col("b"))))
    return pairs.select(_low("a", "b").alias("a"), _high("a", "b").alias("b"))


def with_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, key and text of each row: the id (the least number if null) and a hash of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), key_hash(text).alias("key"), text.alias("text"))


def similar_sets(source: DataFrame, k: int, like: Similarity) -> tuple[DataFrame, DataFrame, DataFrame]:
    """source: doc, key, text. Rows (doc, key, n, hi, lo), nodes (hi, lo, sid, first: the
    least doc and key) and components (node, component) of the nodes with a link."""
    before = tables_now()
    made = written(doc_sets(source, k, like, hot_classes(source, k)))
    full = made.where(F.col("n") > 0)
    once = full.groupBy("hi", "lo").agg(F.min(F.struct("doc", "key")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("p_hi").alias("p_hi"), F.first("p_lo").alias("p_lo"), F.first("bits").alias("bits"))
    nodes = written(once.withColumn("sid", F.monotonically_increasing_id()))
    prefixes = full.groupBy("p_hi", "p_lo", "n").agg(F.first("rare").alias("rare"), F.first("prefix").alias("prefix"))
    by_prefix = nodes.groupBy("p_hi", "p_lo", "n").agg(F.min("sid").alias("gid"), F.count(F.lit(1)).alias("members"), F.sum("copies").alias("copies"))
    members = written(nodes.select("sid", "p_hi", "p_lo", "n").join(by_prefix, ["p_hi", "p_lo", "n"]).select("sid", "gid", "n"))
    weight = F.least(F.col("copies"), F.lit(1 << 30)).cast("int")
    groups = written(prefixes.join(by_prefix, ["p_hi", "p_lo", "n"]).select("gid", "n", weight.alias("weight"), "rare", "prefix"))
    blocks = max(1, (groups.agg(F.sum("rare").alias("m")).first().m or 0) // BLOCK_POSTINGS)
    cold = groups.select("gid", "n", "weight", F.slice("prefix", 1, F.col("rare")).alias("prefix"))
    hot = groups.where(F.size("prefix") > F.col("rare")).select("gid", "n", "weight", "rare", F.slice("prefix", F.col("rare") + 1, F.size("prefix")).alias("prefix"))
    postings = written(rare_postings(cold, blocks, like).withColumn("hot", F.lit(False)).unionByName(hot_postings(hot).withColumn("hot", F.lit(True))))

    # Round 1: members and their group's first node; groups and the lists' leaders.
    proposed = (
        postings.where(F.col("gid") != F.col("leader")).groupBy("gid", "leader").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        .where(F.col("c") >= LEADER_SHARE * (F.col("n") * (like.den - like.num) / like.den))
    )
    stars = members.where(F.col("sid") != F.col("gid")).select(F.col("gid").alias("a"), F.col("sid").alias("b")).unionByName(proposed.select(_low("gid", "leader").alias("a"), _high("gid", "leader").alias("b"))).distinct()
    stars = written(near_enough(stars, nodes, like))
    links = written(verified(stars, written(texts_of(source, nodes, _ends(stars))), k, like))
    labels = connected_components(links)

    # Round 2: what is left between components.
    known = written(members.join(labels.select(F.col("node").alias("sid"), F.col("component").alias("found")), "sid", "left").select("sid", "gid", "n", F.coalesce("found", "sid").alias("comp")))
    held = known.join(folded(nodes, POSTED_BITS), "sid").groupBy("gid").agg(F.first("n").alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("members"), F.first("bits").alias("bits"))
    held = written(held.select("gid", "n", "c1", "c2", F.when(F.col("members") == 1, F.col("bits")).alias("bits")))
    coarse = written(with_partner(listed(postings, held, like), like))
    mixed_groups = held.where("c1 <> c2").select("gid")
    texts = written(texts_of(source, nodes, known.join(coarse.select("gid").unionByName(mixed_groups).distinct(), "gid").select("sid")))
    fine = written(fine_parity(texts, k, like))
    alone = known.groupBy("gid").agg(F.count(F.lit(1)).alias("members")).where("members = 1").join(folded(fine, POSTED_FINE).select(F.col("sid").alias("gid"), "bits"), "gid").select("gid", "bits")
    lists = coarse.groupBy("gid").agg(F.sort_array(F.collect_set("list")).alias("all"))  # of one prefix
    lists = lists.select("gid", F.slice("all", 1, POSTED_LISTS).alias("lists"), F.size("all").alias("in_lists"))
    near = written(group_pairs(coarse.join(lists.join(alone, "gid", "left"), "gid"), like))
    pairs = written(near_enough(member_pairs(near, known), fine, like, LONG))
    more = verified(pairs, texts, k, like)
    final = connected_components(links.unionByName(more))
    remove_tables(before, keep=[made, nodes, final])
    return made.select("doc", "key", "n", "hi", "lo"), nodes.select("hi", "lo", "sid", "first"), final


def same_ids(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the nodes of one id that has several texts."""
    often = made.where((F.col("n") > 0) & (F.col("doc") != NO_ID)).groupBy("doc").agg(F.min("hi").alias("a"), F.max("hi").alias("b"), F.min("lo").alias("c"), F.max("lo").alias("d")).where("a <> b or c <> d").select("doc")
    each = made.where("n > 0").select("doc", "hi", "lo").join(often, "doc").join(nodes, ["hi", "lo"]).select("doc", "sid").distinct()
    return each.join(each.groupBy("doc").agg(F.min("sid").alias("a")), "doc").where("a <> sid").select("a", F.col("sid").alias("b"))


def similar_documents(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs.

    Two documents link if den * (shared shingles) >= num * (shingles of both), on
    the sets of k-word shingles of the whole texts, A-Z in lower case; component_id
    is the smallest id reachable by links. Null, empty and blank texts have no
    shingles and link with nothing. A null id counts as the smallest and is given
    back as null; it links nothing by itself. Rows that share another id are one document,
    and so linked, whatever their texts. Hashes have 64 bits: sets are compared by them.
    """
    made, nodes, links = similar_sets(with_rows(docs, id_col, text_col), k, Similarity(num, den))
    again = written(same_ids(made, nodes))
    if again.count():
        links = connected_components(links.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(again))
    label = F.coalesce("component", "sid").alias("label")
    labelled = nodes.join(links.withColumnRenamed("node", "sid"), "sid", "left").select("hi", "lo", "first.doc", label)
    least = labelled.groupBy("label").agg(F.min("doc").alias("component"))
    classes = labelled.drop("doc").join(least, "label").select("hi", "lo", "component")
    out = made.join(classes, ["hi", "lo"], "left")
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(shown("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, shown("component")).otherwise(shown("doc")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without those whose text another row's text stands for.

    Of the rows that links connect (by their texts, see similar_documents; a shared or
    null id connects nothing) the one of the smallest id stays, a null id being the
    smallest, and of several such texts the one of the least hash. Rows alike in id and
    text are one document: one of them stays. Rows without words all stay but for those.
    """
    like = Similarity(num, den)
    made, nodes, links = similar_sets(with_rows(docs, id_col, text_col), k, like)
    label = F.coalesce("component", "sid").alias("label")
    labelled = nodes.join(links.withColumnRenamed("node", "sid"), "sid", "left").select("hi", "lo", "first", label)
    stays = labelled.groupBy("label").agg(F.min("first").alias("stays"))
    chosen = labelled.drop("first").join(stays, "label").select("hi", "lo", "stays")
    rows = made.join(chosen, ["hi", "lo"], "left")
    goes = written(rows.where((F.col("n") > 0) & (F.struct("doc", "key") != F.col("stays"))).select("doc", "key", key_hash(F.col("doc"), F.col("key")).alias("h")).distinct())
    often = written(made.groupBy("doc", "key").count().where("count > 1").select("doc", "key", key_hash(F.col("doc"), F.col("key")).alias("h")))
    names = docs.columns
    place = [f"c{j}" for j in range(len(names))]
    own = docs.toDF(*place)
    doc, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    keyed = own.select(*place, F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID)).alias("doc"), key_hash(F.col(text).cast("string")).alias("key"))
    held = docs.sparkSession.sparkContext.broadcast(key_table(goes.unionByName(often), "h"))

    @F.pandas_udf("boolean")
    def in_table(h):
        return h.__class__(maybe(held.value, h.to_numpy()))

    small_batches(docs)
    asked = keyed.withColumn("perhaps", in_table(key_hash(F.col("doc"), F.col("key"))))
    surely = asked.where("not perhaps").select(*place)
    rest = asked.where("perhaps").join(goes.select("doc", "key"), ["doc", "key"], "left_anti").dropDuplicates(["doc", "key"]).select(*place)
    return surely.unionByName(rest).toDF(*names)


def _low(a: str, b: str) -> Column:
    return F.least(a, b)


def _high(a: str, b: str) -> Column:
    return F.greatest(a, b)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
