"""Caches that a Python worker keeps between tasks, and gives back when tasks of another kind begin.

Spark uses a worker process again for later stages, so what one operator has cached would otherwise stay beside the arrays of the next.
"""

import ctypes
import ctypes.util
from collections.abc import Callable
from functools import cache

import pyarrow as pa

_caches: dict[str, Callable[[], None]] = {}


def keep(name: str, free: Callable[[], None]) -> None:
    """Note a cache of this process and how to free it."""
    _caches[name] = free


@cache
def _trimmer() -> Callable[[int], int] | None:
    """glibc hands freed memory back only when asked; other systems have nothing to ask."""
    library = ctypes.util.find_library("c")
    return getattr(ctypes.CDLL(library), "malloc_trim", None) if library else None


def only(name: str = "") -> None:
    """Free all caches but ``name``, and what earlier tasks have left; called where a task begins."""
    for other in [n for n in _caches if n != name]:
        _caches.pop(other)()
    pa.default_memory_pool().release_unused()
    trim = _trimmer()
    if trim:
        trim(0)
