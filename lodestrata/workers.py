"""Python workers that don't keep the memory they once needed."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

#: Blocks of at least so many bytes go back to the system when they are freed, and don't stay with a Python worker.
RETURNED_BYTES = 1 << 17
#: The largest blocks that can stay (glibc takes no more), and free bytes that stay at the end of the heap.
KEPT_BYTES, FREE_BYTES = 1 << 25, 1 << 27


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function in a worker that gives freed memory back (where the C library has mallopt)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
        if mallopt:
            mallopt(-3, RETURNED_BYTES)  # M_MMAP_THRESHOLD
        yield from function(batches)

    return run


@contextmanager
def steady() -> Iterator[None]:
    """Inside, freed memory stays with the worker, so that arrays that come again and again aren't mapped anew; it goes back at the end."""
    libc = ctypes.CDLL(None)
    if not hasattr(libc, "mallopt"):
        yield
        return
    libc.mallopt(-1, FREE_BYTES)  # M_TRIM_THRESHOLD
    libc.mallopt(-3, KEPT_BYTES)
    try:
        yield
    finally:
        libc.mallopt(-1, RETURNED_BYTES)
        libc.mallopt(-3, RETURNED_BYTES)
        libc.malloc_trim(0)
