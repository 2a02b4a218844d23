"""Hashed byte n-grams of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Texts are taken in pieces of so many bytes, overlapping by n - 1, to bound memory.
PIECE = 1 << 20


def hashed(codes: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Yield arrays of n-gram hashes below 2 ** bits for each size (4 at most) and piece."""
    for start in range(0, max(1, len(codes)), PIECE):
        piece = codes[start : start + PIECE + max(sizes) - 1].astype(np.uint32)
        value = piece
        for n in range(1, max(sizes) + 1):
            if n > 1:
                value = (value[:-1] << np.uint32(8)) | piece[n - 1 :]
            if n in sizes:
                mixed = (value ^ np.uint32(0x9E3779B9 * n & 0xFFFFFFFF)) * np.uint32(2654435761)
                mixed ^= mixed >> np.uint32(15)
                yield (mixed * np.uint32(2246822519)) >> np.uint32(32 - bits)


def codes_of(text: str, mapping: np.ndarray | None = None) -> np.ndarray:
    codes = np.frombuffer(text.encode(), np.uint8)
    return codes if mapping is None else mapping[codes]
