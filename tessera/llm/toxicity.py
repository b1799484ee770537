"""Toxicity by compression distance.

Two zstandard dictionaries hold the same sample of ordinary text; the toxic one
also holds the word beginnings that mark toxic text. A window that the toxic dictionary shortens by more bytes
than the calibrated least counts as toxic; a logistic curve over the windows of
a text gives its score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import LOWER, map_text
from .classify import compressor, fit_logistic, probability, rebased, sample, shares

WINDOW = 128
OVERLAP = 16
#: Chance that any word beginning is taken for a mark that isn't one (Bonferroni).
MARK_ERROR = 1e-4
#: The ordinary text in both dictionaries: beginnings of so many bytes, of so many texts, at most so many bytes.
BASE_STRETCH = 400
BASE_TEXTS = 160
BASE_BYTES = 24_000
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PARAMS = {"window_log": 16, "hash_log": 15, "chain_log": 15, "search_log": 3, "min_match": 5, "target_length": 64, "strategy": zstandard.STRATEGY_GREEDY}
TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


@dataclass
class ToxicModel:
    toxic: bytes | None
    ordinary: bytes | None
    least: int
    curve: tuple | None
    prior: float

    def machine(self):
        return None if self.toxic is None else (compressor(self.toxic, True, **PARAMS), compressor(self.ordinary, True, **PARAMS))

    def score(self, machine, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if machine is not None:
            gains = [window_gains(machine, t) for t in texts]
            full = [i for i, g in enumerate(gains) if len(g)]
            if full:
                out[full] = probability(self.curve, np.array([features(gains[i], self.least) for i in full]))
        return out


def normal(text: bytes | None) -> bytes:
    return b" ".join(text.translate(TO_WORDS).split()) if text else b""


def window_gains(machine, text: bytes | None) -> np.ndarray:
    """Bytes by which the toxic dictionary shortens each window, of words with
    single spaces; a text without words has no windows."""
    t = normal(text)
    toxic, ordinary = machine[0].compress, machine[1].compress
    if t:
        t = b" " + t + b" "
    step = WINDOW - OVERLAP
    return np.array([len(ordinary(p)) - len(toxic(p)) for p in (t[i : i + WINDOW] for i in range(0, max(1, len(t) - OVERLAP), step) if t)])


def features(gains: np.ndarray, least: int) -> list[float]:
    hits = int((gains >= least).sum())
    return [hits / len(gains), float(np.clip(gains, 0, 10).mean()), min(float(gains.max()), 12.0), math.log1p(hits)]


def contexts(texts: list[bytes]) -> tuple[Counter, int]:
    """For each word beginning the number of different (word before, word) pairs
    it has, and the number of all pairs. Copies of a text add nothing."""
    pairs = set()
    for t in texts:
        words = t.translate(TO_WORDS).split()
        pairs.update(zip([b"", *words], words, strict=False))
    n: Counter = Counter()
    for _, w in pairs:
        w = b" " + w
        n.update(w[:m] for m in range(4, min(len(w), 10) + 1))
        n[w + b" "] += 1
    return n, len(pairs)


def marks(a: list[bytes], b: list[bytes]) -> list[bytes]:
    """Word beginnings far more frequent in a than in b, by different contexts,
    strongest first, none part of another: all for which the likelihood ratio test
    of equal shares fails, so what is rare against the strongest isn't left out."""
    (n, n_all), (m, m_all) = contexts(a), contexts(b)
    tried = [g for g, x in n.items() if x >= 4]
    found = []
    for g in tried:
        x, z = n[g], m[g]
        if (x + 0.5) / (n_all + 1) > 4 * (z + 0.5) / (m_all + 1):
            both = (x + z) / (n_all + m_all)
            ratio = 2 * (x * math.log(x / n_all / both) + (z * math.log(z / m_all / both) if z else 0.0))
            if math.erfc(math.sqrt(max(ratio, 0.0) / 2)) / 2 * len(tried) < MARK_ERROR:
                found.append((-ratio, g))
    longer: dict[bytes, list[bytes]] = {}
    for g in n:
        longer.setdefault(g[:-1], []).append(g)
        if g.endswith(b" "):
            longer.setdefault(g[:-2], []).append(g)
    out: list[bytes] = []
    for _, g in sorted(found):
        x, grown = n[g], g
        while more := [h for h in longer.get(grown, ()) if n[h] >= 0.8 * x]:  # as long as nearly all its words go on so
            grown = max(more, key=lambda h: (n[h], h))
        if not any(g in o or o in g or grown in o or o in grown for o in out):
            out.append(grown)
    return out


def fit(toxic: list[bytes], ordinary: list[bytes]) -> ToxicModel:
    """Half of each class makes the dictionaries, the other half the threshold and
    the curve; then the dictionaries are made again of all."""
    n = len(toxic) + len(ordinary)
    if len(toxic) < 4 or len(ordinary) < 4:
        return ToxicModel(None, None, 3, None, (len(toxic) + 1) / (n + 2))

    def made(t, o):
        base = b" ".join(normal(x[:BASE_STRETCH]) for x in o[:BASE_TEXTS])[:BASE_BYTES]
        return base + b" " + b"".join(g + b"." for g in reversed(marks(t, o))), base

    model = ToxicModel(*made(toxic[::2], ordinary[::2]), 3, None, 0.0)
    machine = model.machine()
    rest = [*toxic[1::2], *ordinary[1::2]]
    gains = [window_gains(machine, t) for t in rest]
    y = np.r_[np.ones(len(toxic[1::2])), np.zeros(len(ordinary[1::2]))]
    full = [i for i, g in enumerate(gains) if len(g)]
    best = None
    for least in (2, 3, 4, 5):
        x = np.array([features(gains[i], least) for i in full])
        curve = fit_logistic(x, y[full])
        p = np.clip(probability(curve, x), 1e-6, 1 - 1e-6)
        loss = -(y[full] * np.log(p) + (1 - y[full]) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, least, curve
    _, model.least, model.curve = best
    model.toxic, model.ordinary = made(toxic, ordinary)
    model.prior = float(y.mean())
    return model


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fitted on bounded samples of the rows that aren't held out (see classify),
    then rebased to the classes' shares among all of their labels."""
    one, zero = sample(docs, labels, "toxic", 5, 0)
    model = fit(one, zero)
    now = shares(labels, "toxic", 5, 0)
    if model.curve is not None:
        model.curve = rebased(model.curve, now, (len(one), len(zero)))
    model.prior = 1 / (1 + math.exp(-now))
    return model


def score_toxicity(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Texts that are null, empty or without words get the training rows' share of
    toxic ones. Texts are read whole; equal texts get equal scores; columns
    called score or predicted are replaced. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own: ToxicModel = pickle.loads(held.value)
        machine = own.machine()

        def each(texts):
            s = own.score(machine, texts)
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return each

    return map_text(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], text_col, keep)
