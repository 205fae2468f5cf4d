"""What a Python worker remembers between tasks.

Workers are used again by later tasks, of other operators too. So a worker holds one
remembered value at a time, whoever asks for another drops it, and what grows is bounded in
bytes.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

# Bytes of a dictionary entry besides its key and value.
ENTRY = 160
# Bytes that one dictionary of short strings may take.
LIMIT = 24 << 20

_HELD: dict[Hashable, Any] = {}


def _drop() -> None:
    """Give memory back to the system: what is dropped holds cycles, and its pieces are small."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library


def held(key: Hashable, build: Callable[[], Any]) -> Any:
    """The value under ``key``, built if the worker holds another."""
    if key not in _HELD:
        _drop()
        _HELD[key] = build()
    return _HELD[key]


def release() -> None:
    """Drop what the worker holds; called where a task of another operator begins."""
    _drop()


class Remembered:
    """Values of strings, in two generations: the older one goes when the younger one is full."""

    def __init__(self, limit: int = LIMIT):
        self.limit, self.size = limit // 2, 0
        self.young: dict = {}
        self.old: dict = {}

    def update(self, wanted: set, compute: Callable[[list], list[bytes]]) -> None:
        """Make ``young`` hold all of ``wanted``, computing those in neither generation."""
        new = wanted.difference(self.young)
        room = sum(map(len, new)) * 2 + ENTRY * len(new)
        if self.size + room > self.limit:
            self.young, self.old, self.size = {}, self.young, 0
            new = wanted
            room = sum(map(len, new)) * 2 + ENTRY * len(new)
        self.size += room
        met = new & self.old.keys()
        self.young.update(zip(met, map(self.old.__getitem__, met), strict=True))
        if fresh := list(new - met):
            self.young.update(zip(fresh, compute(fresh), strict=True))
