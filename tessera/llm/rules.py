"""Quality rules with risk-controlled thresholds.

Every rule rejects a document whose statistic goes beyond a cutoff. The cutoffs of all
rules form one ladder, from the mildest to the strictest, fixed before any label is seen.
Labelled documents, of which nothing else is fitted, choose the step: in each stratum (by
number of words) steps are tried in order, and the last one is taken for which, and for
all before it, the exact binomial test rejects "all rules together reject more than
max_false of the good documents". Trying in that fixed order needs no correction; the
level is divided by the number of strata (Bonferroni). Strata with too few labels to
certify anything are pooled with their neighbours first, by their numbers alone. A pool
that is still too small gets no step, and its rules reject none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import SPACE, map_text
from .storage import checkpoint_dir

SYMBOLS = b"#*$%&|<>"
#: Bytes that don't begin a character.
TAIL = bytes(range(0x80, 0xC0))
UPPER = bytes(range(65, 91))

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("n_upper", T.LongType()), ("n_lines", T.LongType())]

#: Upper edges of the strata's word counts; the last stratum has no edge.
STRATA = (200, 1000)

#: Cutoffs of each rule, from the mildest to the strictest; fixed before any label is seen.
CUTOFFS = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02),
    "dup_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1),
    "repeat_share": (0.48, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15),
    "word_length": (40.0, 30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0),
}
MAX_FALSE = 0.05
LEVEL = 0.05
LABEL_PARTS = 32


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int, int]:
    """The FIELDS of one text."""
    if not text:
        return 0, 0, 0, 0, 0, 0, 0
    words = text.split()
    chars = len(text.translate(None, SPACE + TAIL))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    upper = len(text) - len(text.translate(None, UPPER))
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip(SPACE)]
    return len(words), chars, symbols, len(full) - len(set(full)), repeated_words(words), upper, len(full)


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n + 2)
    k = len(number)
    if k < 1 << 21:
        codes = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:  # pairs get numbers first, so that codes fit 63 bits
        pairs = np.unique(ids[:-1] * k + ids[1:], return_inverse=True)[1]
        codes = pairs[:-1].astype(np.int64) * k + ids[2:]
    _, at, times = np.unique(codes, return_inverse=True, return_counts=True)
    twice = times[at] > 1
    if not twice.any():
        return 0
    hit = np.zeros(n + 2, dtype=bool)
    for j in range(3):
        hit[j : n + j] |= twice
    return int(hit.sum())


def count_rules(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with FIELDS of the whole text; null and empty texts have zeros. No shuffle."""

    def make():
        def each(texts):
            rows = list(zip(*map(text_counts, texts), strict=True))
            return [pa.array(c, pa.int64()) for c in rows]

        return each

    return map_text(docs, make, FIELDS, text_col, keep)


def statistic(rule: str) -> Column:
    over, of = {"symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "word_length": ("word_chars", "n_words")}[rule]
    return F.coalesce(F.try_divide(F.col(over).cast("double"), F.col(of)), F.lit(0.0))


def stratum() -> Column:
    out = F.lit(len(STRATA))
    for k, edge in reversed(list(enumerate(STRATA))):
        out = F.when(F.col("n_words") < edge, k).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p): the regularised incomplete beta function
    I(1-p; n-k, k+1), by Lentz's continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


#: Steps of the ladder; a rule with fewer cutoffs stays at its last.
STEPS = max(map(len, CUTOFFS.values()))


def cutoff(rule: str, step: int) -> float:
    return CUTOFFS[rule][min(step, len(CUTOFFS[rule]) - 1)]


def least_labels(max_false: float, level: float) -> int:
    """Good documents without which no step can be certified, though none is rejected."""
    return math.ceil(math.log(level / (len(STRATA) + 1)) / math.log1p(-max_false))


def pools(numbers: list[int], least: int) -> list[list[int]]:
    """Neighbouring strata together until each pool has so many labels, if there are."""
    out: list[list[int]] = [[]]
    for s, _ in enumerate(numbers):
        if sum(numbers[x] for x in out[-1]) >= least:
            out.append([])
        out[-1].append(s)
    if len(out) > 1 and sum(numbers[x] for x in out[-1]) < least:
        last = out.pop()
        out[-1] += last
    return out


def choose_steps(counts: dict[int, tuple[int, list[int]]], max_false: float = MAX_FALSE, level: float = LEVEL) -> dict[int, int]:
    """counts: for each stratum the number of good documents, and of those that each step
    rejects. The certified step of each stratum that has one."""
    strata = range(len(STRATA) + 1)
    full = [counts.get(s, (0, [0] * STEPS)) for s in strata]
    out = {}
    for pool in pools([n for n, _ in full], least_labels(max_false, level)):
        n = sum(full[s][0] for s in pool)
        for step in range(STEPS):
            k = sum(full[s][1][step] for s in pool)
            if n == 0 or binomial_tail(k, n, max_false) > level / len(strata):
                break
            out |= dict.fromkeys(pool, step)
    return out


def rejected(step: int) -> Column:
    bad = F.lit(False)
    for r in CUTOFFS:
        bad = bad | (statistic(r) > cutoff(r, step))
    return bad


def false_rejections(counted: DataFrame, labels: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Of the good documents that the base rules keep, by stratum. The join is on ids and
    counts, not texts; its result has a row for each stratum."""
    good = labels.where(F.col("quality") == 1).select("doc_id").dropDuplicates()
    each = [F.count_if(F.col(f"step{k}")) for k in range(STEPS)]
    rows = (
        counted.where(~base_failed()).join(good, "doc_id")
        .select(stratum().alias("stratum"), *[rejected(k).alias(f"step{k}") for k in range(STEPS)])
        .groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*each).alias("rejected")).collect()
    )
    return {r.stratum: (r.n, list(r.rejected)) for r in rows}


def verdict(steps: dict[int, int]) -> Column:
    """True if no rule rejects at the step of the document's stratum."""
    bad = F.lit(False)
    for s, step in sorted(steps.items()):
        bad = bad | ((stratum() == s) & rejected(step))
    return ~bad


def apply_rules(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_false: float = MAX_FALSE, level: float = LEVEL, keep: list[str] | None = None) -> DataFrame:
    """docs with FIELDS, base_failed and kept.

    base_failed: fewer than 50 words, or over half of the words in repeated 3-word
    windows. kept: not base_failed and no rule rejects at the certified step.
    Null and empty texts fail. Null ids match no label. Without labels no step is
    certified. Repeated label rows count once. The counts are written once to the
    shared checkpoint folder, since thresholds and verdicts both read them.
    """
    checkpoint_dir(docs.sparkSession)
    counted = count_rules(docs, text_col, keep).checkpoint()
    steps = choose_steps(false_rejections(counted, labels), max_false, level)
    return counted.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(steps))
