"""Normalised words of texts as 64-bit numbers, and running hashes over them."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from doccensus.llm.shared import normal_words

MAX_WORDS = 500_000
_RATIO = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of each number spread over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordNumbers:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self._known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words, known = normal_words(text), self._known
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            if len(known) > MAX_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little")
            return np.array([known[w] for w in words], dtype=np.uint64)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words; a shorter text is one run of what it has."""
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    k = min(k, len(words))
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _RATIO + words[i : len(words) - k + 1 + i])
    return out
