"""A keyed permutation of [0, n): Feistel rounds on the next power of two, walked along cycles."""

from __future__ import annotations

import numpy as np

from ridgeflow.llm.hashing import mixed

ROUNDS = 6


def permuted(index: np.ndarray, n: np.ndarray | int, key: np.ndarray | int) -> np.ndarray:
    """Image of each index under the permutation of [0, n) that the key picks.

    ``n`` and ``key`` may differ by element. The Feistel network permutes [0, 4**k), the
    smallest such range that holds n; an image outside [0, n) is permuted again until it
    falls inside, which keeps the map one to one (at most four walks on average)."""
    index = np.asarray(index, np.uint64)
    n = np.broadcast_to(np.asarray(n, np.uint64), index.shape)
    key = np.broadcast_to(np.asarray(key, np.uint64), index.shape)
    bits = np.zeros(index.shape, np.uint64)
    for b in range(1, 32):  # half the bits, at least one
        bits = np.where((bits == 0) & ((np.uint64(1) << np.uint64(2 * b)) >= n), np.uint64(b), bits)
    out = index.copy()
    left = np.arange(len(index))
    while len(left):
        half = bits[left]
        mask = (np.uint64(1) << half) - np.uint64(1)
        high, low = out[left] >> half, out[left] & mask
        for turn in range(ROUNDS):
            high, low = low, high ^ (mixed(low ^ key[left], turn + 1) & mask)
        out[left] = (high << half) | low
        left = left[out[left] >= n[left]]
    return out.astype(np.int64)
