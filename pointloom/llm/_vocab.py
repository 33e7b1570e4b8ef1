"""Public vocabulary files as bytes, and two-generation caches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from pathlib import Path

from ._io import process_cache


def read_file(path: str) -> bytes:
    return Path(path).read_bytes()


class Memo(dict):
    """make(key) for each key, kept for about 2 * limit keys at most: when full, the older half goes."""

    def __init__(self, make: Callable, limit: int = 300_000):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def shared(kind: str, data: bytes, make: Callable[[bytes], object]):
    """make(data), once for each Python process and file content."""
    return process_cache(f"{kind}:{hashlib.md5(data).hexdigest()}", lambda: make(data))
