"""Arrow batches cut by the bytes of their texts, so that a task's memory follows bytes and not rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from salience.llm.words import column_bytes

BYTES = 4 << 20
ROWS = 4096


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = BYTES, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and ``most`` bytes of text, but of one row at least."""
    _, offsets = column_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def tidy() -> None:
    """Gives memory that earlier work of a reused Python worker has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
