"""Shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher."""
    x = x ^ (x >> np.uint64(30))
    x = x * _B
    x = x ^ (x >> np.uint64(27))
    x = x * _C
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words: A-Z count as a-z, words are what ASCII white space (bytes 32 and 9 to 13) separates."""
    found = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def runs_of(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for each run of ``words`` words in order; fewer words are one run, none give none."""
    if not len(hashes):
        return hashes
    n = min(words, len(hashes))
    runs = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        runs = mixed((runs ^ hashes[k : k + len(runs)]) * _A + np.uint64(k))
    return runs


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of ``words`` words of a text."""
    return np.unique(runs_of(word_hashes(text), words))
