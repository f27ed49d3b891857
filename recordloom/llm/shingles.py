"""Word shingles of texts in numpy, hashed to 64 bits.

A word is a run of bytes that aren't ASCII white space, A-Z lower-cased; its hash is
polynomial over its UTF-8 bytes, from one running sum over the text. A shingle's hash
mixes those of its words in order.
"""

from __future__ import annotations

import numpy as np

WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(2024)
_BYTE = _rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = _rng.integers(1 << 63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones((2, 1), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _powers
    if _powers.shape[1] < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full((2, size), 1, dtype=np.uint64)
        steps[0, 1:], steps[1, 1:] = _BASE, _INVERSE
        _powers = np.cumprod(steps, axis=1, dtype=np.uint64)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """The hash of each word, in order."""
    raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    powers = _power(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * powers[0, : len(raw)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * powers[1, starts])


def sequence_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The hash of each run of ``n`` words; with fewer words, of the whole sequence."""
    n = min(n, len(words))
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        h += words[i : len(words) - n + 1 + i] * _PLACE[i]
    return mix(h)


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(sequence_hashes(word_hashes(text)))
