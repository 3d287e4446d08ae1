"""Arrays of integers as bytes, in the fewest bytes a number that hold them all: how blocks of rows travel."""

from __future__ import annotations

import numpy as np

_KINDS = [np.dtype(f"<i{size}") for size in (1, 2, 4, 8)]


def pack(numbers: np.ndarray) -> bytes:
    """The numbers in row order; the first byte says how many bytes each takes."""
    low, high = (int(numbers.min()), int(numbers.max())) if numbers.size else (0, 0)
    kind = next(k for k in _KINDS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def unpack(data: bytes) -> np.ndarray:
    """One-dimensional and read-only, in the kind :func:`pack` has chosen."""
    return np.frombuffer(data, f"<i{data[0]}", offset=1)
