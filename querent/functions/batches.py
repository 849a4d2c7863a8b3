"""Arrow batches in slices of bounded size, and memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of input that are turned into Python objects at once.
SLICE_BYTES = 2 << 20
#: Bytes of rows that are handed on together.
TOGETHER = 4 << 20


def memory_returned() -> None:
    """Gives freed memory back to the system: workers are kept for later tasks, and an executor's memory is shared by all of them."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``limit`` bytes, or one row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def together(rows: Iterator, size: Callable, joined: Callable) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches of about TOGETHER bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > TOGETHER or len(held) == 1000:
            yield joined(held)
            held, total = [], 0
    if held:
        yield joined(held)
