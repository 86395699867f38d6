"""Counting many distinct hashes over a corpus without a row for each.

Blocks of rows ask for their distinct keys: one packed row per block and range of hashes, with the block's own counts. A
range adds up the counts of all blocks and answers each. So a key is shuffled once per block that has it, packed, however
often it occurs there; that is also what keeps a frequent key from being hot. The number of ranges grows with the keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ASKED = "part int, block long, keys binary, counts binary"
SHARED = "block long, keys binary, counts binary"


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, so that the shuffle's compression finds the empty planes."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def ranges(keys: np.ndarray, bits: int, width: int = 64) -> list[tuple[int, int, int]]:
    """(part, first, end) of the parts that sorted keys below 2**width fall into, by their highest bits."""
    if not bits:
        return [(0, 0, len(keys))] if len(keys) else []
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(width - bits))
    return [(i, lo, hi) for i, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(keys)])) if lo < hi]


def shared_keys(asked: pa.Table) -> pa.Table:
    """Of the asks of one part: for each block its keys with a total count over 1, and those totals."""
    lists = [unpacked_keys(k) for k in asked["keys"].to_pylist()]
    counts = np.concatenate([unpacked(c) for c in asked["counts"].to_pylist()])
    keys, place = np.unique(np.concatenate(lists), return_inverse=True)
    totals = np.bincount(place, weights=counts, minlength=len(keys)).astype(np.uint64)
    mine = totals[place]
    blocks, out_keys, out_counts, at = [], [], [], 0
    for block, own in zip(asked["block"].to_pylist(), lists):
        total = mine[at:at + len(own)]
        at += len(own)
        many = total > 1
        if many.any():
            blocks.append(block), out_keys.append(packed_keys(own[many])), out_counts.append(packed(total[many]))
    return pa.table([pa.array(blocks, pa.int64()), pa.array(out_keys, pa.binary()), pa.array(out_counts, pa.binary())], names=["block", "keys", "counts"])
