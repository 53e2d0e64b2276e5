"""A memo bounded by bytes."""

from __future__ import annotations

from collections.abc import Callable
from sys import getsizeof
from typing import Any

#: Bytes that a memo holds, about.
BYTES = 12 << 20
#: Longest key that is remembered.
LONGEST = 64
#: Bytes of an entry besides its key and value, about.
ENTRY = 100


class Memo(dict):
    """What ``make`` gave for a key.

    Entries fill a young half; when that is full it becomes the old half, and
    what was old and not asked for meanwhile is forgotten.
    """

    def __init__(self, make: Callable[[Any], Any], most: int = BYTES):
        super().__init__()
        self.make, self.half = make, most // 2
        self.room, self.old = self.half, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            if self.room <= 0:
                self.old = dict(self)
                self.clear()
                self.room = self.half
            self[key] = value
            self.room -= ENTRY + getsizeof(key) + getsizeof(value)
        return value
