"""Compressed bitmaps: sorted 16-bit arrays for sparse containers, packed bits for dense ones."""

from __future__ import annotations

import numpy as np

_ARRAY_LIMIT = 4096
_SPAN = 1 << 16


class Bitmap:
    """A set of integers, held by container of 65,536; a container is an array of uint16 or 8 KB of bits."""

    __slots__ = ("containers",)

    def __init__(self, containers: dict[int, np.ndarray] | None = None):
        self.containers = containers or {}

    @classmethod
    def of(cls, values: np.ndarray) -> "Bitmap":
        values = np.unique(values.astype(np.int64))
        high = values >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(part[0] >> 16): _pack((part & 0xFFFF).astype(np.uint16)) for part in np.split(values, cuts) if len(part)})

    def and_not(self, other: "Bitmap") -> "Bitmap":
        out = {}
        for key, a in self.containers.items():
            b = other.containers.get(key)
            if b is None:
                out[key] = a
                continue
            if a.dtype == np.uint16 and b.dtype == np.uint16:
                left = a[~np.isin(a, b, assume_unique=True)]
            elif a.dtype == np.uint16:
                left = a[(b[a >> 3] >> (a & 7).astype(np.uint8)) & 1 == 0]
            else:
                left = _values(a & ~_bits(b))
            if len(left):
                out[key] = _pack(left)
        return Bitmap(out)

    def decode(self) -> np.ndarray:
        parts = [_values(c).astype(np.int64) + key * _SPAN for key, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def __len__(self) -> int:
        return sum(len(_values(c)) for c in self.containers.values())


def _bits(c: np.ndarray) -> np.ndarray:
    if c.dtype == np.uint8:
        return c
    flags = np.zeros(_SPAN, bool)
    flags[c] = True
    return np.packbits(flags, bitorder="little")


def _values(c: np.ndarray) -> np.ndarray:
    return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c, bitorder="little")).astype(np.uint16)


def _pack(values: np.ndarray) -> np.ndarray:
    return values if len(values) <= _ARRAY_LIMIT else _bits(values)
