"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every normalised benchmark item over word numbers. Each
document's words run through it; the matching length at a word tells which
windows end there. Words are numbered by a table of the benchmark's words, and
a fixed-size bit table of word 4-grams skips the stretches of a text in which no
window can lie, so that the automaton walks only the rest. The skip never
hides a match: each window's 4-grams are in the table.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import LOWER, as_bytes, fresh, map_text, small_batches, without
from .storage import checkpoint_dir, written

#: Bytes of benchmark text in one automaton; a larger benchmark has several.
BLOCK_BYTES = 1 << 20
#: Automata (about 12 MB each) that a pass over the documents carries; beyond,
#: there are more passes, with a checkpoint of the documents between them.
PASS_BLOCKS = 16

#: ASCII letters and digits and all bytes of non-ASCII characters are words'.
WORD_BYTES = bytes(c for c in range(256) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128)
TO_WORDS = bytes(LOWER[c] if c in WORD_BYTES else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

GRAM_BITS = 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences.

    next: a dict for each state; link, length: suffix links and longest lengths.
    windows[s]: items with a window whose text belongs to state s.
    short[s]: (length, item) of items shorter than a window that end in s.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.windows: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        number = self.vocabulary
        rows = [(item, [number.setdefault(w, len(number) + 1) for w in words]) for item, words in items if words]
        self.least = min([window, *(len(r) for _, r in rows)])
        self.gram = min(4, self.least)
        self.table = np.zeros(1 << GRAM_BITS, dtype=bool)
        for _, row in rows:
            last = 0
            for w in row:
                last = self._add(last, w)
            self.table[self.grams(np.array(row, dtype=np.uint64))] = True
        for item, row in rows:
            self._mark(item, row)
        self.up = self._nearest_short()
        self._freeze()

    def _freeze(self) -> None:
        """Arrays instead of dicts, for a small broadcast."""
        edges = sorted((s << 32 | w, to) for s, row in enumerate(self.next) for w, to in row.items())
        self.edge = np.array([k for k, _ in edges], dtype=np.int64)
        self.target = np.array([to for _, to in edges], dtype=np.int32)
        self.names = sorted({i for row in self.windows.values() for i in row})
        number = {n: k for k, n in enumerate(self.names)}
        held = sorted(self.windows)
        self.held = np.array(held, dtype=np.int64)
        self.held_at = np.cumsum([0, *(len(self.windows[s]) for s in held)])
        self.held_items = np.array([number[i] for s in held for i in sorted(self.windows[s])], dtype=np.int32)
        self.link, self.length, self.up = (np.array(x, dtype=np.int32) for x in (self.link, self.length, self.up))
        del self.next, self.windows

    def items_at(self, state: int) -> list[str]:
        k = int(np.searchsorted(self.held, state))
        return [self.names[i] for i in self.held_items[self.held_at[k] : self.held_at[k + 1]]]

    def walk(self, state: int, size: int, w: int) -> tuple[int, int]:
        """step() over the arrays."""
        edge, last = self.edge, len(self.edge)
        while True:
            key = state << 32 | w
            k = int(edge.searchsorted(key))
            if k < last and edge[k] == key:
                return int(self.target[k]), size + 1
            if not state:
                return 0, 0
            state = int(self.link[state])
            size = int(self.length[state])

    def _add(self, last: int, w: int) -> int:
        """Appends w after state last; an existing transition is reused or split."""
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        new = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def _mark(self, item: str, row: list[int]) -> None:
        state, size = 0, 0
        for w in row:
            state, size = self.step(state, size, w)
            if size >= self.window:
                self.windows.setdefault(self.holder(state, self.window), set()).add(item)
        if len(row) < self.window:
            self.short.setdefault(self.holder(state, len(row)), []).append((len(row), item))

    def _nearest_short(self) -> list[int]:
        up = [-1] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            parent = self.link[s]
            up[s] = s if s in self.short else (up[parent] if parent >= 0 else -1)
        return up

    def holder(self, state: int, size: int) -> int:
        """The state of the suffix of that size of a match that ends in state."""
        while self.length[self.link[state]] >= size:
            state = int(self.link[state])
        return state

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            size = self.length[state]
        to = nxt[state].get(w)
        return (to, size + 1) if to is not None else (0, 0)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        """Places in the bit table of all runs of self.gram words."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(self.gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)

    def stretches(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words outside which no window can lie."""
        hit = self.table[self.grams(ids)]
        if not hit.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.least - self.gram + 1
        return [(int(a), int(b) + self.gram - 1) for a, b in zip(begin[long], end[long], strict=True)]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges inside windows, and the items these belong to."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for begin, end in self.stretches(ids):
            state, size = 0, 0
            for i, w in enumerate(ids[begin:end].tolist(), begin):
                state, size = self.walk(state, size, w)
                reach = 0
                if size >= self.window:
                    found.update(self.items_at(self.holder(state, self.window)))
                    reach = self.window
                s = int(self.up[state]) if size else -1
                while s > 0:
                    for n, item in self.short.get(s, ()):
                        if s != state or n <= size:
                            found.add(item)
                            reach = max(reach, n)
                    s = int(self.up[self.link[s]])
                if reach:
                    a = i + 1 - reach
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i + 1))
        return spans, found


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the bytes from each span's first to its last word."""
    at = [m.span() for m in WORD.finditer(text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def automata(benchmark: DataFrame, window: int, text_col: str, id_col: str, block_bytes: int) -> DataFrame:
    """block and machine: the automata of the items, pickled, of about block_bytes of text
    each (a block has at least one item). Tasks make them; the items are dealt by a hash
    of id and text, and repeated items fall together."""
    items = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")).alias("size")).first().size or 0
    blocks = -(-size // block_bytes) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pickle.dumps(Automaton(held, window))], pa.binary())], names=["block", "machine"])

        for b in batches:
            for at, item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
                if at != block:
                    if held:
                        yield made()
                    block, held = at, []
                held.append((item, words_of(text)))
        if held:
            yield made()

    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks).cast("long")))
    return written(small_batches(dealt.repartition("block").sortWithinPartitions("block", "item").select("block", "item", "text")).mapInArrow(run, "block long, machine binary"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_span: int = 0,
    max_coverage: float = 1.0,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """docs with n_words, n_hit, items (sorted as strings), spans and clean_text.

    A window is `window` consecutive words of an item, or all words of a shorter
    item. spans are the merged ranges [begin, end) of words inside occurrences;
    clean_text lacks the spans of more than max_span words and, if all spans together
    cover more than max_coverage of the document's words, every span (null stays null).
    Null and empty texts have no words. Null item ids are called "null"; repeated
    items count once. An empty benchmark hits nothing. Documents aren't shuffled.
    """
    spark = docs.sparkSession
    made = automata(benchmark, window, item_text_col, item_col, block_bytes)
    numbers = sorted(r.block for r in made.select("block").collect())
    passes = [numbers[i : i + PASS_BLOCKS] for i in range(0, len(numbers), PASS_BLOCKS)] or [[]]
    before: list[str] = []
    carried = list(dict.fromkeys([*(keep or docs.columns), text_col]))
    for k, held in enumerate(passes):
        shared = [spark.sparkContext.broadcast(bytes(r.machine)) for r in made.where(F.col("block").isin(held)).orderBy("block").toLocalIterator()]
        if k + 1 < len(passes):
            names = [fresh(docs, f"__spans{k}"), fresh(docs, f"__items{k}")]
            fields = list(zip(names, (SPANS, ITEMS), strict=True))
            checkpoint_dir(spark)
            docs = map_text(docs, _scanner(shared), fields, text_col, [*carried, *before]).checkpoint()
            for s in shared:
                s.destroy()
            before += names
    fields = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", ITEMS), ("spans", SPANS), ("clean_text", T.StringType())]
    return map_text(docs, _finisher(shared, max_span, max_coverage), fields, text_col, keep or without(docs, [*(n for n, _ in fields), *before]), before)


SPANS = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))
ITEMS = T.ArrayType(T.StringType())
ARROW_SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def _scan_all(machines: list[Automaton], words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for m in machines:
        got, named = m.scan(words)
        spans += got
        items |= named
    return spans, items


def _scanner(shared):
    def make():
        machines = [pickle.loads(s.value) for s in shared]

        def each(texts):
            got = [_scan_all(machines, words_of(t) if t else []) for t in texts]
            return [pa.array([[{"begin": a, "end": b} for a, b in s] for s, _ in got], ARROW_SPANS), pa.array([sorted(i) for _, i in got], pa.list_(pa.string()))]

        return each

    return make


def _finisher(shared, max_span, max_coverage):
    def make():
        machines = [pickle.loads(s.value) for s in shared]

        def each(texts, *before):
            cols: list[list] = [[], [], [], [], []]
            for row, t in enumerate(texts):
                words = words_of(t) if t else []
                spans, items = _scan_all(machines, words)
                for k in range(0, len(before), 2):
                    spans = spans + [(s["begin"], s["end"]) for s in before[k][row]]
                    items |= set(before[k + 1][row])
                spans = merged(spans)
                hit = sum(b - a for a, b in spans)
                drop = [s for s in spans if s[1] - s[0] > max_span or hit > max_coverage * len(words)]
                clean = cut_spans(t, drop) if drop else t
                for c, v in zip(cols, (len(words), hit, sorted(items), [{"begin": a, "end": b} for a, b in spans], clean), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), ARROW_SPANS, pa.binary())
            out = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            out[-1] = out[-1].cast(pa.string())
            return out

        return each

    return make


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)
