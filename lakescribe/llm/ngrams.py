"""Hashed byte n-grams with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Of a text that is longer, the n-grams are taken in parts, so arrays stay small.
PART = 1 << 20


def parts(data: bytes, longest: int) -> Iterator[np.ndarray]:
    """data in parts that overlap by longest - 1 bytes, so no n-gram is lost and only those shorter than longest repeat."""
    whole = np.frombuffer(data, np.uint8)
    for k in range(0, max(len(whole), 1), PART):
        yield whole[k : k + PART + longest - 1]


def hashed(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each size the hashes, of so many bits, of all n-grams of data."""
    h = data.astype(np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > 1:
            if len(data) < n:
                return
            h = h[:-1] * np.uint32(0x01000193) + data[n - 1 :]
        if n in sizes:
            mixed = (h ^ (h >> np.uint32(15)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x2C1B3C6D)
            yield (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - bits)
