"""A compressed full-text index over numbers: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

#: Suffixes are ordered by so many symbols; patterns must be shorter.
DEPTH = 128


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes, in order of their first ``DEPTH`` symbols (prefix doubling)."""
    n = len(text)
    rank, order, k = text.astype(np.int64), np.argsort(text), 1
    while k < DEPTH:
        later = np.zeros(n, np.int64)
        later[: max(0, n - k)] = rank[k:] + 1
        key = rank * (int(later.max(initial=0)) + 1) + later
        order = np.argsort(key)
        step = np.r_[False, key[order][1:] != key[order][:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if n and rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class WaveletMatrix:
    """Packed bits per level with running counts: how often a symbol stands before a position."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, (size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        rows = symbols.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (rows >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(packed))].astype(np.int64))
            self.zeros.append(len(bit) - int(bit.sum()))
            rows = np.concatenate([rows[bit == 0], rows[bit == 1]])
        self.first = self._walk(np.arange(size), np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = self.bits[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.ones[k][word] + np.bitwise_count(below)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._walk(symbol, at) - self.first[symbol]


class FMIndex:
    """Index of one shard; ``owner`` gives each position's document, of which intervals tell the least."""

    def __init__(self, text: np.ndarray, size: int, owner: np.ndarray):
        order = suffix_order(text)
        self.before = np.r_[0, np.cumsum(np.bincount(text, minlength=size))].astype(np.int64)
        self.wavelet = WaveletMatrix(text[order - 1], size)
        self.n = len(text)
        # least owner of each run of 1, 2, 4, ... positions, as numbers in order of the owners
        self.owners, number = np.unique(owner, return_inverse=True)
        rows = [number[order].astype(np.int32)]
        width = 1
        while 2 * width <= self.n:
            low = rows[-1].copy()
            low[:-width] = np.minimum(low[:-width], low[width:])
            rows.append(low)
            width *= 2
        self.least = np.concatenate(rows)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the patterns with one more symbol in front."""
        both = self.wavelet.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        start = self.before[symbol]
        return start + both[: len(symbol)], start + both[len(symbol):]

    def owner_min(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least owner in each interval; the largest number for an empty one."""
        size = np.maximum(hi - lo, 1)
        level = np.frexp(size.astype(np.float64))[1] - 1
        row = level * self.n
        low = np.minimum(self.least[row + np.minimum(lo, self.n - 1)], self.least[row + np.maximum(hi - (1 << level), 0)])
        return np.where(hi > lo, self.owners[low], np.iinfo(np.int64).max)


def matched_windows(index: FMIndex, text: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray,
                    window: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pattern, first window, last window) matched by a smaller owner, by matching statistics.

    Patterns are text[start:start + length]. Each is read backward from its end
    as long as a smaller owner has what was read. A match that is long enough
    gives an interval of windows; the next end is the last one whose window
    takes in the symbol that broke the match.
    """
    found = []
    at = np.arange(len(start))
    end = length.copy()  # one past the last symbol of the match being read
    lane = at[end >= window]
    position = end[lane].copy()
    lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), index.n)
    while len(lane):
        lo, hi = index.extend(text[start[lane] + position - 1], lo, hi)
        good = index.owner_min(lo, hi) < owner[lane]
        position = np.where(good, position - 1, position)
        over = ~good | (position == 0)
        if over.any():
            done = np.flatnonzero(over)
            match = end[lane[done]] - position[done]
            hit = match >= window
            if hit.any():
                found.append((lane[done][hit], position[done][hit], (end[lane[done]] - window)[hit]))
            # the symbol before `position` broke it: later windows that hold it end here at the latest
            broke = position[done] - 1
            end[lane[done]] = np.where(broke < 0, 0, np.minimum(end[lane[done]] - 1, broke + window))
            position[done], lo[done], hi[done] = end[lane[done]], 0, index.n
            live = np.ones(len(lane), bool)
            live[done] = end[lane[done]] >= window
            lane, position, lo, hi = lane[live], position[live], lo[live], hi[live]
    return found
