"""Numbers for words, the same in every process."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np


class _Numbers(dict[str, int]):
    """Numbers of the words of this process; they are only kept to save time, so it starts anew when it is large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        b = w.encode()
        h = self[w] = (zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)) or 1
        return h


_SEEN = _Numbers()


def numbers(words: Iterable[str], count: int = -1) -> np.ndarray:
    """A 64-bit number for each word; none is 0."""
    return np.fromiter(map(_SEEN.__getitem__, words), dtype=np.uint64, count=count)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Other 64-bit numbers for 64-bit numbers, without collisions."""
    with np.errstate(over="ignore"):
        x = x ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
