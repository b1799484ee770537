"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton over the vocabulary names all pieces that end at each
character of a word; dynamic programming keeps, for each position, the best
score and the number of pieces on the best path. Ties go as in the tokenizer: a
later candidate replaces the best only if its score is greater, and candidates
come by their start, so the longest piece wins. Characters that no one-character
piece covers may be unknown at the least score less 10; unknown characters that
follow each other count as one piece, if fuse_unknown. White space splits a text
into words, each of which begins with the mark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_text

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words whose counts a worker remembers, and the longest such word.
CACHE_WORDS, CACHE_CHARS = 800_000, 48


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    fuse_unknown: bool = True


def sentencepiece_vocabulary(path: str) -> Vocabulary:
    """Pieces and scores of a public sentencepiece model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    return Vocabulary([(model.id_to_piece(i), model.get_score(i)) for i in ids])


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.machine = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.machine.add_word(piece, (len(piece), float(score)))
        if not len(self.machine):
            self.machine.add_word("\0" * 99, (99, -1e300))
        self.machine.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.fuse = vocabulary.fuse_unknown
        self.cache: dict[str, tuple[int, int]] = {}
        self.old: dict[str, tuple[int, int]] = {}

    def word(self, word: str) -> tuple[int, int]:
        """Pieces and unknown pieces of mark + word."""
        known = self.cache.get(word)
        if known is not None:
            return known
        got = self.old.get(word) or self._viterbi(MARK + word)
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS // 2:
                self.old, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def _viterbi(self, s: str) -> tuple[int, int]:
        """The automaton names pieces by their last character and, of those, the
        longest first, which is the order in which starts come."""
        n = len(s)
        score, pieces, unknown, odd = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        end, best, at, single = 1, None, 0, False
        for last, (size, gain) in self.machine.iter(s):
            while end <= last:
                if single:
                    score[end], pieces[end], unknown[end] = best, pieces[at] + 1, unknown[at]
                else:
                    self._close(end, best, at, score, pieces, unknown, odd)
                end += 1
                best, single = None, False
            total = score[end - size] + gain
            if best is None or total > best:
                best, at = total, end - size
            if size == 1:
                single = True
        while end <= n:
            if single:
                score[end], pieces[end], unknown[end] = best, pieces[at] + 1, unknown[at]
            else:
                self._close(end, best, at, score, pieces, unknown, odd)
            end += 1
            best, single = None, False
        return pieces[n], unknown[n]

    def _close(self, end, best, at, score, pieces, unknown, odd) -> None:
        """A position that no one-character piece ends: its character may be unknown."""
        if best is not None and score[end - 1] + self.unknown <= best:
            score[end], pieces[end], unknown[end] = best, pieces[at] + 1, unknown[at]
            return
        joined = self.fuse and odd[end - 1]
        score[end], odd[end] = score[end - 1] + self.unknown, True
        pieces[end] = pieces[end - 1] + (not joined)
        unknown[end] = unknown[end - 1] + (not joined)

    def text(self, text: str) -> tuple[int, int, int]:
        n = total = odd = 0
        word = self.word
        for w in text.split():
            p, u = word(w)
            n += 1
            total += p
            odd += u
        return n, total, odd


_counters: dict[bytes, Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, n_tokens and n_unknown of the whole text.

    Null and empty texts have zeros; words are what Unicode white space parts.
    Time is linear in the text's length; a worker remembers the counts of at most
    CACHE_WORDS short words, whatever the input. No shuffle.
    """
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(vocabulary))

    def make():
        if held.value not in _counters:  # lives as long as the worker
            _counters.clear()
            _counters[held.value] = Counter(pickle.loads(held.value))
        counter = _counters[held.value]

        def each(texts: Iterable[bytes | None]):
            rows = [counter.text(t.decode()) if t else (0, 0, 0) for t in texts]
            return [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]

        return each

    return map_text(docs, make, [("n_words", T.LongType()), ("n_tokens", T.LongType()), ("n_unknown", T.LongType())], text_col, keep)
