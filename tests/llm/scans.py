"""Brute force that several tests share."""

import hashlib

from tessera.llm.decontam import words_of


def reference_scan(texts: list[bytes | None], items: list[tuple[str, bytes | None]], window: int) -> list[tuple[int, int, str]]:
    """What decontaminate() has to find, by comparing all places: for tests."""
    want: dict[tuple, set[str]] = {}
    for item, t in items:
        w = words_of(t or b"")
        for i in range(max(1, len(w) - window + 1) if w else 0):
            want.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(k) for k in want}
    out = []
    for t in texts:
        w = words_of(t or b"")
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (names := want.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= names
        out.append((len(w), len(hit), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out
