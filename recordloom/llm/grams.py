"""Code points and hashed character n-grams of texts in numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(1_000_003)


@cache
def _fold(letters_only: bool) -> np.ndarray:
    """A code for each code point of the basic plane: 32 (space) unless it is in a word."""
    keep = str.isalpha if letters_only else str.isalnum
    return np.array([c if keep(chr(c)) else 32 for c in range(0x10000)], dtype=np.uint32)


def codes(text: str, letters_only: bool = False) -> np.ndarray:
    """The code points of the lower-cased text between spaces; what is outside of words is a space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = np.where(raw < 0x10000, _fold(letters_only)[np.minimum(raw, 0xFFFF)], raw)
    if letters_only and (high := raw >= 0x10000).any():
        signs, at = np.unique(raw[high], return_inverse=True)
        out[high] = np.array([c if chr(c).isalpha() else 32 for c in signs.tolist()], dtype=np.uint32)[at]
    return out


def hashes(c: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The hash of each window of ``n`` codes, below 2**bits."""
    if len(c) < n:
        return np.empty(0, dtype=np.int64)
    h = np.full(len(c) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        h = h * _STEP + c[i : len(c) - n + 1 + i].astype(np.uint64)
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def inside_words(c: np.ndarray, n: int) -> np.ndarray:
    """Which windows of ``n`` codes have no space but at their ends, and a word's code in between."""
    if len(c) < n:
        return np.empty(0, dtype=bool)
    spaces = np.concatenate([[0], np.cumsum(c == 32)])
    starts = np.arange(len(c) - n + 1)
    return spaces[starts + n - 1] == spaces[starts + 1]


def distinct(ids: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The distinct ids. ``last`` is a work table that needn't be cleared."""
    at = np.arange(len(ids), dtype=last.dtype)
    last[ids] = at
    return ids[last[ids] == at]
