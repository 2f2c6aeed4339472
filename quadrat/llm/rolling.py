"""Hashes of all strings of one width in arrays, and anchors' helpers; for operator 10."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

#: Window starts that are worked on at once; arrays of 8 bytes each.
CHUNK = 1 << 19
PLACE = np.uint64((1 << 21) - 1)

_rng = np.random.default_rng(20240229)
BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = int(_rng.integers(2**62, 2**63)) | 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Mixed so that all bits count."""
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` codes (a power of two) at each position."""
    power, n = _BASE, 1
    while n < width:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power % (1 << 64), 2 * n
    return mixed(h)


def least(key: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    return np.minimum(key[: len(key) - (width - n)], key[width - n :])


def pieces(texts: Sequence, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(text, first window start, window starts) in lots of at most ``CHUNK`` starts; long texts are divided."""
    lot, room = [], CHUNK
    for i, text in enumerate(texts):
        at, n = 0, len(text) - length + 1
        while at < n:
            take = min(n - at, room)
            lot.append((i, at, take))
            at, room = at + take, room - take - length
            if room <= length:
                yield lot
                lot, room = [], CHUNK
    if lot:
        yield lot


def row_key(doc: int | None, text: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(b"%r:" % doc + text)
    a, b = x >> 64, x & ((1 << 64) - 1)
    return (a - (1 << 64) if a >> 63 else a), (b - (1 << 64) if b >> 63 else b)
