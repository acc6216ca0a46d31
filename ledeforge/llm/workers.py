"""Memory of Python workers, which live on from task to task."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's way to give free memory back, where it has one."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Returns free memory to the system; allocators otherwise keep what the largest task took."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


def tidy(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that gives free memory back when its task is done."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from step(batches)
        finally:
            give_back()

    return run
