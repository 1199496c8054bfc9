"""Words of a text and their hashes, whole arrays at a time.

A word is a run of bytes other than blank and the five control characters from tab to carriage return;
in UTF-8 these bytes never occur inside a longer character. Hashes are 64-bit: prefix sums of
byte values times powers of an odd number, so a word, or a run of words, costs one subtraction.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20260101)
_BYTES = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Odd numbers below 2^64 (any will do) and their inverses.
BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]


class Powers:
    """Powers of a base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self._grow(1 << 12)

    def _grow(self, n: int) -> None:
        self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (self.base, self.inverse))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):
            self._grow(2 * len(values))
        return np.append(np.uint64(0), np.cumsum(values * self.up[:len(values)]))

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_POWERS = [Powers(b) for b in BASES]


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end) of every word of the text; ``lower`` folds A-Z only."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[raw], [True])).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    prefix = _POWERS[0].prefix((_LOWER if lower else _BYTES)[raw])
    return _POWERS[0].spans(prefix, start, end), start, end


def run_hashes(words: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """The hash of every run of ``length`` words, by its first word."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    at = np.arange(len(words) - length + 1)
    p = _POWERS[which]
    return p.spans(p.prefix(words), at, at + length)


def shingles(data: bytes, size: int = 2) -> np.ndarray:
    """Distinct hashed ``size``-word shingles in lower case, sorted; fewer words count as one shingle."""
    words = word_hashes(data, lower=True)[0]
    if len(words) == 0:
        return words
    return np.unique(run_hashes(words, min(size, len(words))))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For every window of ``width`` values the place of the first least one."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        a, b = best[:-step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        span += step
    return best
