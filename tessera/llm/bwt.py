"""Long common prefixes of a block of byte segments, from its Burrows-Wheeler
transform, in numpy.

``repeated_starts`` finds, for every start in the block that has ``least``
bytes of its segment ahead, whether those bytes start at another place too.
Intervals of rows that share a prefix are expanded breadth-first, one byte
backward at a time: the intervals of length l + 1 come from those of length l,
so that boundaries between rows are found in order of increasing common
prefix.  The expansion stops at the minimum length; rows that no boundary
parts by then have that much in common.
"""

from __future__ import annotations

import numpy as np

from .fm_index import WaveletMatrix

#: Intervals up to this size are expanded row by row, larger ones in the wavelet matrix.
SMALL = 64
PACKED = 7  # symbols of nine bits in a first sort key


def bounded_order(text: np.ndarray, room: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows in suffix order, rank of each) with suffixes compared on their
    first ``depth`` symbols.  ``text``: symbols from 1, a 0 ends each segment;
    ``room``: what is left of the segment at each place."""
    n = len(text)
    padded = np.r_[text, np.zeros(PACKED, text.dtype)].astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(PACKED):
        key = (key << 9) | np.where(room > k, padded[k:n + k], 0)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    k = PACKED
    while k < depth:
        ordered = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = ordered[1:] == ordered[:-1]
        places = np.flatnonzero(same[:n] | same[1:])
        tied = order[places]
        open_ = room[tied] > k  # ties that have ended stay ties
        if not open_.any():
            break
        second = np.zeros(len(tied), np.int64)
        second[open_] = rank[tied[open_] + k] + 1
        key = rank[tied] * (n + 1) + second
        by = np.argsort(key, kind="stable")
        tied, key = tied[by], key[by]
        order[places] = tied
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        rank[tied] = np.repeat(places[starts], np.diff(np.r_[starts, len(tied)]))
        k *= 2
    return order, rank


class _Expansion:
    def __init__(self, bwt: np.ndarray):
        n = self.n = len(bwt)
        self.bwt = bwt
        by_symbol = np.argsort(bwt.astype(np.int16), kind="stable")
        self.last_to_first = np.empty(n, np.int64)
        self.last_to_first[by_symbol] = np.arange(n)
        self.before = np.r_[0, np.cumsum(np.bincount(bwt, minlength=257))]
        self.wavelet = WaveletMatrix(bwt.astype(np.int32), 9)
        self.mark = np.full(n + 2, -1, np.int64)
        self.marked = 0

    def small(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All one-byte extensions of intervals, by their rows."""
        size = high - low
        owner = np.repeat(np.arange(len(low)), size)
        rows = np.arange(size.sum()) + np.repeat(low - np.r_[0, np.cumsum(size)[:-1]], size)
        inner = self.bwt[rows] > 0
        rows, owner = rows[inner], owner[inner] + self.marked
        self.marked += len(low)
        to = self.last_to_first[rows]
        mark = self.mark
        # an extension's rows lie next to each other, within their symbol's rows
        mark[to + 1] = owner
        symbol = self.bwt[rows]
        begins = (mark[to] != owner) | (to == self.before[symbol])
        ends = (mark[to + 2] != owner) | (to + 1 == self.before[symbol + 1])
        return np.sort(to[begins]), np.sort(to[ends]) + 1

    def large(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same by a walk down the wavelet matrix: each interval splits
        into the symbols it holds."""
        w = self.wavelet
        a, b, prefix, first = low.copy(), high.copy(), np.zeros(len(low), np.int64), low.copy()
        base = np.zeros(len(low), np.int64)
        for ones, zeros in zip(w.ones, w.zeros, strict=True):
            a1, b1, f1 = ones[a], ones[b], ones[base]
            a = np.concatenate([a - a1, zeros + a1])
            b = np.concatenate([b - b1, zeros + b1])
            base = np.concatenate([base - f1, zeros + f1])
            prefix = np.concatenate([prefix * 2, prefix * 2 + 1])
            some = a < b
            a, b, base, prefix = a[some], b[some], base[some], prefix[some]
        some = prefix > 0
        a, b, base, prefix = a[some], b[some], base[some], prefix[some]
        return self.before[prefix] + a - base, self.before[prefix] + b - base


def boundaries(bwt: np.ndarray, least: int) -> np.ndarray:
    """found[i]: whether rows i - 1 and i have fewer than ``least`` symbols in common."""
    n = len(bwt)
    expansion = _Expansion(bwt)
    found = np.zeros(n + 1, bool)
    found[0] = found[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(least):
        big = high - low > SMALL
        parts = [f(low[which], high[which]) for f, which in ((expansion.small, ~big), (expansion.large, big))
                 if which.any()]
        if not parts:
            break
        low, high = (np.concatenate(p) for p in zip(*parts, strict=True))
        new = ~found[low] | ~found[high]
        found[low] = found[high] = True
        low, high = low[new], high[new]
    return found


def repeated_starts(segments: list[bytes], least: int) -> list[np.ndarray]:
    """Per segment: for each of its first len - least + 1 starts, whether the
    ``least`` bytes there start at another place of the block too."""
    sizes = np.array([len(s) for s in segments], np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    ends = np.cumsum(sizes + 1)
    text[ends - 1] = 0
    room = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))  # 0 at a segment's end
    order, _ = bounded_order(text, room, least + 1)
    found = boundaries(text[order - 1], least)
    shared = ~found[:-1] | ~found[1:]  # with the row before, or the one after
    at = np.empty(len(text), bool)
    at[order] = shared
    starts = ends - sizes - 1
    return [at[a:a + max(0, size - least + 1)] for a, size in zip(starts, sizes, strict=True)]
