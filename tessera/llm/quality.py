"""Quality classifier by compression.

One zstandard dictionary is trained on text labelled good and one on text
labelled bad. A text is compressed with each, window by window; the difference
of the two compressed sizes, normalised by length, is the main evidence. A
logistic curve, fitted on training rows, turns it into a calibrated score.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_text
from .classify import compressor, fit_logistic, probability, rebased, sample, shares

WINDOW = 1024
SEGMENT = 256
DICTIONARY_BYTES = 1 << 16


@dataclass
class QualityModel:
    """Dictionaries and calibration; None dictionaries give the prior to all."""

    good: bytes | None
    bad: bytes | None
    curve: tuple | None
    prior: float

    def machine(self):
        if self.good is None:
            return None
        return compressor(self.good, compression_level=1), compressor(self.bad, compression_level=1)

    def score(self, machine, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        full = [i for i, t in enumerate(texts) if t]
        if machine is not None and full:
            out[full] = probability(self.curve, np.array([features(machine, texts[i]) for i in full]))
        return out


def features(machine, text: bytes) -> tuple[float, float, float]:
    """Normalised compressed-size difference over the whole text and in the worst
    window, and the compressed size itself (endless repetition compresses well
    with either dictionary)."""
    good, bad = machine[0].compress, machine[1].compress
    total = least = 0
    worst = 1.0
    for i in range(0, len(text), WINDOW):
        piece = text[i : i + WINDOW]
        g, b = len(good(piece)), len(bad(piece))
        total += b - g
        least += min(b, g)
        if len(piece) > 64 or len(text) <= 64:
            worst = min(worst, (b - g) / len(piece))
    n = len(text)
    return total / n, worst, min(1.0, least / n) * min(1.0, n / WINDOW)


def segments(texts: list[bytes]) -> list[bytes]:
    """The whole of the sampled stretches, in pieces."""
    return [t[i : i + SEGMENT] for t in texts for i in range(0, len(t), SEGMENT)]


def dictionary(texts: list[bytes]) -> bytes:
    parts = segments(texts)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=1).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b"".join(parts)[:DICTIONARY_BYTES] or b"\n" * 8


def fit(good: list[bytes], bad: list[bytes]) -> QualityModel:
    """Half of each class makes the dictionaries, the other half the curve, so
    that the curve sees texts as new to the dictionaries as later ones are."""
    if len(good) < 4 or len(bad) < 4:
        n = len(good) + len(bad)
        return QualityModel(None, None, None, (len(good) + 1) / (n + 2))
    model = QualityModel(dictionary(good[::2]), dictionary(bad[::2]), None, 0.0)
    machine = model.machine()
    x = np.array([features(machine, t) for t in [*good[1::2], *bad[1::2]]])
    y = np.r_[np.ones(len(good[1::2])), np.zeros(len(bad[1::2]))]
    model.curve = fit_logistic(x, y)
    model.prior = len(good) / (len(good) + len(bad))
    return model


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fitted on bounded samples of the rows that aren't held out (see classify),
    then rebased to the classes' shares among all of their labels."""
    one, zero = sample(docs, labels, "quality", 4, 2)
    model = fit(one, zero)
    now = shares(labels, "quality", 4, 2)
    if model.curve is not None:
        model.curve = rebased(model.curve, now, (len(one), len(zero)))
    model.prior = 1 / (1 + math.exp(-now))
    return model


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts get the training rows' share of good ones. Long texts
    are read whole, window by window. Equal texts get equal scores. A column
    called score or predicted is replaced. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own: QualityModel = pickle.loads(held.value)
        machine = own.machine()

        def each(texts):
            s = own.score(machine, texts)
            return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]

        return each

    return map_text(docs, make, [("score", T.DoubleType()), ("predicted", T.IntegerType())], text_col, keep)
