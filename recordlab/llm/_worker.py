"""What a Python worker keeps from task to task, and what it gives back: a worker outlives tasks, stages and operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once a worker and kept until tasks of a :func:`lean` operator run there."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget() -> None:
    _kept.clear()


try:
    _malloc_trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _malloc_trim = None


def give_back() -> None:
    """Returns freed memory to the system, which Arrow and the C library else hold for the worker's later tasks."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; after each, memory goes back."""
    for batch in batches:
        yield batch
        del batch
        give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that first forgets what other operators kept, and gives memory back after each batch."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from run(giving_back(batches))
        give_back()

    return inner
