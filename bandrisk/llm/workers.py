"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return free memory of this process to the system, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(function: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over the batches of a task that gives free memory back when the task is done."""

    @wraps(function)
    def run(*args, **options):
        yield from function(*args, **options)
        give_back()

    return run
