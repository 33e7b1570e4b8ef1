"""Words of whole texts as 64-bit hashes, computed on the bytes of a batch at once.

A word is a maximal run of characters other than U+0020 and U+0009-U+000D, so byte-wise work on UTF-8 is exact.
"""

from __future__ import annotations

import numpy as np
import xxhash

SEGMENT = 1 << 18
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """Hashes words by a polynomial over random byte codes; words above LONG_WORD bytes by xxh3."""

    def __init__(self, lower: bool = False):
        code = np.arange(256)
        if lower:
            code[65:91] += 32
        self.lower = lower
        self.codes = mix((code.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        self.space = np.zeros(256, bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        n = SEGMENT + 1
        self.powers = self._powers(_BASE, n)
        self.inverse = self._powers(pow(_BASE, -1, 1 << 64), n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _one(self, word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word.lower() if self.lower else word)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (byte offsets) and hashes of the words of data."""
        buf = np.frombuffer(data, np.uint8)
        gap = self.space[buf]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
        starts, ends = edges[0::2], edges[1::2]
        hashes = np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            low = starts[at]
            upto = int(np.searchsorted(ends, low + SEGMENT, "right"))
            if upto <= at:  # one word longer than a segment
                hashes[at] = self._one(data[starts[at] : ends[at]])
                at += 1
                continue
            high = ends[upto - 1]
            total = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.codes[buf[low:high]] * self.powers[: high - low], out=total[1:])
            s, e = starts[at:upto] - low, ends[at:upto] - low
            hashes[at:upto] = (total[e] - total[s]) * self.inverse[s] + (e - s).astype(np.uint64)
            at = upto
        hashes = mix(hashes)
        for i in np.flatnonzero(ends - starts > LONG_WORD):
            hashes[i] = self._one(data[starts[i] : ends[i]])
        return starts, ends, hashes

    def texts(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts in a row, and bounds: text i has hashes[bounds[i]:bounds[i+1]]. None has no words."""
        parts = [b"" if t is None else t.encode() if isinstance(t, str) else t for t in texts]
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        begins = np.concatenate(([0], np.cumsum(sizes)))
        starts, _, hashes = self(b"\n".join(parts))
        return hashes, np.searchsorted(starts, begins, "left")


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (also across text bounds)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x2545F4914F6CDD1D, np.uint64)
    for j in range(k):
        out = (out ^ hashes[j : j + n]) * np.uint64(_BASE)
        out ^= out >> np.uint64(32)
    return mix(out)


def chunks(texts: list, limit: int = 2 << 20):
    """Index ranges of texts with about limit characters each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def small(batches, rows: int = 1000):
    """Record batches in parts of so many rows at most, so that what a part is turned into stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
