"""A bounded two-generation cache, and white-space units of a text."""

from __future__ import annotations

from collections.abc import Callable


class Cache(dict):
    """make(key) once a key, as long as it is remembered: after `most` new keys those not used since are forgotten."""

    def __init__(self, make: Callable, most: int = 200_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(key) < 200:  # long keys would make the bound on entries no bound on memory
            self[key] = value
        return value
