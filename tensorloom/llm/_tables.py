"""Tables that a Python worker keeps between tasks, for one operator at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

_held: dict[str, Callable[[], None]] = {}
_last: list[str] = []


def trim() -> None:
    """Give freed memory back to the system: a worker lives on between tasks, and what it once needed counts as its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass


def enter(name: str, release: Callable[[], None] | None = None) -> None:
    """An operator starts in this worker: other operators' tables are emptied; ``release`` empties its own one day."""
    for other in [k for k in _held if k != name]:
        _held.pop(other)()
    if release:
        _held[name] = release
    if _last != [name]:
        _last[:] = [name]
        trim()
