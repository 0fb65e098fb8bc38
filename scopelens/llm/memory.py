"""Giving memory back at the end of a task.

Python workers outlive their tasks, and what a stage took stays with them: caches, freed blocks the allocator
keeps, and Arrow's pool. A job of many stages would pay for the largest of all.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

_clearers: list[Callable[[], None]] = []


def forgets(clear: Callable[[], None]) -> None:
    """Has a module's caches cleared when a task ends that ``tidy`` watches."""
    _clearers.append(clear)


def released() -> None:
    for clear in _clearers:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        return


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives memory back after the last one, or when the task is ended."""

    def worked(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            released()

    return worked
