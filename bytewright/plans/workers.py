"""What Python workers hold between tasks: one worker serves the stages of many queries."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_kept: dict[Hashable, object] = {}


def trimmed() -> None:
    """Gives freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept(key: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, kept for further tasks until one asks for another key: a worker holds one cache at a time."""
    if key not in _kept:
        _kept.clear()
        trimmed()
        _kept[key] = make()
    return _kept[key]


def alone(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` in a worker that holds no cache then, nor freed memory afterwards."""

    def clean(batches: Iterator) -> Iterator:
        _kept.clear()
        trimmed()
        yield from run(batches)
        trimmed()

    return clean
