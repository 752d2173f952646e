"""Compact blocks of numbers for exchanges: byte planes, delta coding, and zstd."""

from __future__ import annotations

import numpy as np
import zstandard

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX2
    return x ^ (x >> np.uint64(33))


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Any fixed-width numbers; ascending unsigned ones are delta coded first."""
    if ascending and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(b: bytes, dtype, ascending: bool = False) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(width, -1).T
    x = np.ascontiguousarray(raw).view(dtype).reshape(-1)
    return np.cumsum(x, dtype=dtype) if ascending else x
