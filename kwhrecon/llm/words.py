"""Hashes of words and word sequences of a text, as arrays."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte, byte after) of the words: runs without space and the controls 9 to 13."""
    b = np.frombuffer(raw, np.uint8)
    inside = np.ones(len(b) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.flatnonzero(np.diff(inside))
    return b, edge[0::2], edge[1::2]


def word_hashes(raw: bytes, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; ``lower`` folds A-Z first."""
    b, first, after = word_bounds(raw.translate(_LOWER) if lower else raw)
    if not len(first):
        return np.zeros(0, np.uint64)
    size = after - first
    # eight bytes at a time: short words need one or two steps whatever their number
    padded = np.concatenate([b, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left = np.arange(len(first))
    at = 0
    while len(left):
        part = np.ascontiguousarray(eight[first[left] + at]).view(np.uint64).ravel()
        rest = size[left] - at
        short = rest < 8
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(rest, 8)).astype(np.uint64) * np.uint64(8))
        h[left] = mix((h[left] ^ (part & keep)) + np.uint64(0xD6E8FEB86659FD93))
        left = left[~short & (rest > 8)]
        at += 8
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n values."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
    return mix(out)
