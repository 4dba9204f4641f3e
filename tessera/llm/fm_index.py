"""An FM-index over one shard of integer symbols, in numpy.

``FMIndex`` holds the Burrows-Wheeler transform of a symbol sequence in a
wavelet matrix, answers many backward searches at once and locates matches
from sampled suffix positions.
"""

from __future__ import annotations

import numpy as np

SAMPLE_EVERY = 8


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling.  ``ranks``: non-negative integers;
    suffixes end at the end of the array.  After each round only the suffixes
    that are still tied are sorted again."""
    n = len(ranks)
    rank = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    # the rank of a suffix is the first place of its group of ties
    ordered = rank[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if n else np.zeros(0, np.int64)
    rank[order] = np.repeat(first, np.diff(np.r_[first, n]))
    k = 1
    while True:
        ordered = rank[order]
        same = np.zeros(n + 1, bool)
        same[1:n] = ordered[1:] == ordered[:-1]
        places = np.flatnonzero(same[:n] | same[1:])  # slots of tied suffixes
        if not len(places):
            return order
        tied = order[places]
        beyond = tied + k
        second = np.full(len(tied), -1, np.int64)
        inside = beyond < n
        second[inside] = rank[beyond[inside]]
        head = rank[tied]
        key = head * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        tied, key, head = tied[by], key[by], head[by]
        order[places] = tied
        new = np.r_[True, key[1:] != key[:-1]]
        starts = np.flatnonzero(new)
        rank[tied] = np.repeat(places[starts], np.diff(np.r_[starts, len(tied)]))
        k *= 2


class WaveletMatrix:
    """Rank over integer symbols below 2 ** bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.n = bits, len(symbols)
        self.ones, self.zeros, current = [], [], symbols
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(place), place
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            bit = ((symbol >> level) & 1).astype(bool)
            a, b = ones[low], ones[high]
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low


class FMIndex:
    """Index of ``symbols`` (> 0), cut into runs at ``starts``: no match
    crosses from one run into the next."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, alphabet: int):
        n, runs = len(symbols), len(starts)
        ends = np.r_[starts[1:], n]
        # each run is followed by its own separator, smaller than all symbols
        self.source = np.insert(np.arange(n, dtype=np.int64), ends, -1)
        text = np.insert(symbols.astype(np.int64), ends, 0)
        separator = text == 0
        ranked = text + runs
        ranked[separator] = np.arange(runs)
        self.order = order = suffix_order(ranked)
        self.bwt = text[order - 1]  # order 0 wraps to the last separator
        self.wavelet = WaveletMatrix(self.bwt, max(1, int(alphabet).bit_length()))
        counts = np.bincount(text, minlength=alphabet + 1)
        self.before = np.r_[0, np.cumsum(counts)]
        first = np.zeros(len(text), bool)
        first[0:1] = True
        first[1:] = separator[:-1]
        # sampled: every eighth place, and run starts so that no walk crosses a separator
        sampled = first | (np.arange(len(text)) % SAMPLE_EVERY == 0)
        self.sampled = sampled[order]
        self.sampled_rank = np.r_[0, np.cumsum(self.sampled)]
        self.samples = order[self.sampled]
        del self.order

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range [low, high) of each pattern, a row of ``patterns``."""
        m = len(patterns)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.bwt), np.int64)
        alive = np.arange(m)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low[alive] = self.before[c] + self.wavelet.rank(c, low[alive])
            high[alive] = self.before[c] + self.wavelet.rank(c, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Index into ``symbols`` of the suffix in each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        found = np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            at = rows[todo]
            done = self.sampled[at]
            hit = todo[done]
            found[hit] = self.samples[self.sampled_rank[at[done]]] + steps[hit]
            todo, at = todo[~done], at[~done]
            c = self.bwt[at]
            rows[todo] = self.before[c] + self.wavelet.rank(c, at)
            steps[todo] += 1
        return self.source[found]
