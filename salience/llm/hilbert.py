"""Keys of points along a Hilbert curve, and few coordinates for many-dimensional vectors."""

from __future__ import annotations

import numpy as np


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the curve of points with whole coordinates below 2**bits; dims * bits must stay below 64.

    The published transpose method: undo excess rotations from the highest bit down, Gray-encode, interleave.
    """
    x = np.ascontiguousarray(cells.T).astype(np.uint64)
    dims = len(x)
    one = np.uint64(1)
    top = one << np.uint64(bits - 1)
    q = top
    while q > one:
        below = q - one
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint64)
    q = top
    while q > one:
        flips ^= np.where((x[dims - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= flips
    key = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << one) | ((x[i] >> np.uint64(bit)) & one)
    return key.astype(np.int64)


def even(values: np.ndarray) -> np.ndarray:
    """Normal numbers to even ones in [0, 1), by the logistic form of their distribution."""
    return 1.0 / (1.0 + np.exp(-1.702 * np.clip(values, -20, 20)))


def directions(dims: int, few: int, seed: int) -> np.ndarray:
    """``few`` orthogonal unit directions (as columns), the same on every machine."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, min(few, dims))))[0]
