"""Vectorised 64-bit hashes of stretches of bytes or symbols, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n; kept for the next call."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits: the finaliser of a public 64-bit mixer."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hashed:
    """Hashes of any stretch of one sequence, equal for equal content."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The mixed hash of symbols[start:end], length included."""
        raw = (self.sums[end] - self.sums[start]) * self.up[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """The mixed hash of each window of ``width`` symbols."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n - width + 1]) * self.up[:n - width + 1])


#: Longer words are hashed one by one.
LONG_WORD = 1 << 12


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch raw[start:end] of bytes, by mixing in eight bytes
    at a time: unlike a polynomial modulo a power of two it has no pairs of
    patterned words that always collide."""
    size = (end - start).astype(np.int64)
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(BASE))
    bytes8 = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(8, np.uint8)], 8)
    rows = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    done = 0
    while len(rows):
        chunk = bytes8[start[rows] + done].view("<u8")[:, 0]
        short = np.minimum(size[rows] - done, 8).astype(np.uint64)
        chunk &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * short)
        h[rows] = mix((h[rows] ^ chunk) * np.uint64(0x9FB21C651E98DF25) + np.uint64(done + 1))
        done += 8
        rows = rows[size[rows] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = np.frombuffer(blake2b(raw[start[i]:end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return h
