"""Position-independent 64-bit hashes of spans of bytes, all at once in numpy."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LETTERS = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64) | np.uint64(1)


class Powers:
    """Powers of the multiplier and of its inverse, kept and grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) >= n:
            return
        n = max(n, 2 * len(self.up))
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            setattr(self, name, np.multiply.accumulate(p))


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the word (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``p`` with ``span_hashes`` of any slice in two look-ups; ``data`` is uint8."""
    _POWERS.upto(len(data) + 1)
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _POWERS.up[:len(data)], out=p[1:])
    return p


def span_hashes(p: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices [start, end): equal bytes hash alike wherever they stand."""
    return mix((p[ends] - p[starts]) * _POWERS.down[starts])
