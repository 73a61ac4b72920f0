"""Word shingles as 64-bit hashes, and MinHash coordinates over them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Rising distinct hashes of all runs of ``width`` words, in lower case; a shorter text is one run.

    A null text, or one without a word, has the empty set.
    """
    words = WORD.findall((text or "").lower())
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = len(words) - width + 1
    total = np.zeros(runs, np.uint64)
    for k in range(width):
        total = total * _MIX + h[k : k + runs]
    return np.unique(mixed(total))


def coordinates(shingles: np.ndarray, count: int, seed: int = 1) -> np.ndarray:
    """``count`` MinHash values: two sets agree in each with the probability of their Jaccard similarity."""
    salts = mixed(np.arange(1, count + 1, dtype=np.uint64) * _MIX + np.uint64(seed))
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for part in range(0, len(shingles), 2048):
        x = (shingles[None, part : part + 2048] ^ salts[:, None]) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(low, x.min(1), out=low)
    return low
