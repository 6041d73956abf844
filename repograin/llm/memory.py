"""Memory of Python workers, which Spark keeps from task to task and from stage to stage."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand freed memory back to the system: Arrow's pool, then the C allocator's where it can (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Run) -> Run:
    """``run``, for ``mapInArrow``, with freed memory given back at the end of a task, failed ones too.

    Without it a worker holds on to its largest task's arrays while later stages run in the same process.
    """

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
