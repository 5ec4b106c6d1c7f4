"""What Python workers keep between batches and tasks: the memory of one operator at a time, bounded in bytes.

Spark reuses Python workers, so what an operator remembers in a module would stay when a later operator's tasks run in
the same process. Here a worker holds one owner's memory; the first call for another owner drops it and gives it back.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable
from typing import TypeVar

from .common import release_memory

T = TypeVar("T")
BYTES = 24 << 20
_held: dict[str, tuple[Hashable, object]] = {}
_owner: list[str | None] = [None]


def kept(owner: str, name: str, make: Callable[[], T], version: Hashable = None) -> T:
    """What ``make`` builds, remembered under ``name`` as long as no other owner calls; anew for another ``version``."""
    if _owner[0] != owner:
        forget()
        _owner[0] = owner
    if name not in _held or _held[name][0] != version:
        _held.pop(name, None)
        _held[name] = version, make()
    return _held[name][1]


def forget() -> None:
    """Drop all that is kept."""
    if _held:
        _held.clear()
        release_memory()
    _owner[0] = None


class Memo(dict):
    """Remembers ``make(key)`` in about ``limit`` bytes.

    Two generations of half that size: a key that is still in use moves from the older to the newer one, and when the newer is full
    the older is dropped. So common keys stay, and what is remembered never exceeds the limit by more than one entry.
    """

    ENTRY = 110  # a dict's share of an entry, with its empty places

    def __init__(self, make: Callable[[Hashable], object], limit: int = BYTES):
        super().__init__()
        self.make, self.half, self.size, self.older = make, limit // 2, 0, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        self.size += sys.getsizeof(key) + sys.getsizeof(value) + self.ENTRY
        if self.size > self.half:
            self.older, self.size = dict(self), 0
            self.clear()
        self[key] = value
