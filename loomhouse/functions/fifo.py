"""A bounded dict that lets the oldest entry go."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any


class FIFODict:
    """At most `size` entries; a new key beyond that evicts the one that was added first.

    A key that is set again keeps its place.  `finalizer(key, value)` is called for what is evicted.
    """

    def __init__(self, size: int, finalizer: Callable[[Any, Any], Any] | None = None):
        if size < 1:
            raise ValueError("the size must be positive")
        self.size, self.finalizer = size, finalizer
        self._held: dict[Any, Any] = {}

    def add(self, key: Any, value: Any) -> None:
        if key not in self._held and len(self._held) >= self.size:
            oldest = next(iter(self._held))
            gone = self._held.pop(oldest)
            if self.finalizer is not None:
                self.finalizer(oldest, gone)
        self._held[key] = value

    __setitem__ = add

    def get(self, key: Any, default: Any = None) -> Any:
        return self._held.get(key, default)

    def __getitem__(self, key: Any) -> Any:
        return self._held[key]

    def __delitem__(self, key: Any) -> None:
        del self._held[key]

    def __contains__(self, key: Any) -> bool:
        return key in self._held

    def __iter__(self) -> Iterator[Any]:
        return iter(self._held)

    def __len__(self) -> int:
        return len(self._held)

    def __str__(self) -> str:
        return str(self._held)

    def clear(self) -> None:
        self._held.clear()
