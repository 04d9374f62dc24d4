"""Elias-Fano coding of a non-decreasing sequence, in numpy.

A value's low bits are stored as they are; its high part is a gap in a bit vector, in unary.
With 32-bit ranks every 512 bits of that vector, select finds any value by one binary search and
one look at 64 bytes, in about 2 + log2(universe / n) bits a value."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<QQBI"  # values, least value, low bits, bytes of the high vector
_BLOCK = 64


def encode(values: np.ndarray) -> bytes:
    """values: integers in non-decreasing order, less than 2**32 values."""
    n = len(values)
    if not n:
        return struct.pack(_HEAD, 0, 0, 0, 0)
    base = int(values[0])
    v = (np.asarray(values, np.int64).view(np.uint64) - np.uint64(base % 2**64))
    width = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
    high = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    size = -(-(int(high[-1]) + 1) // (8 * _BLOCK)) * _BLOCK
    bits = np.zeros(size * 8, np.uint8)
    bits[high] = 1
    vector = np.packbits(bits)
    ranks = np.concatenate([[0], np.cumsum(bits.reshape(-1, 8 * _BLOCK).sum(axis=1, dtype=np.int64))])[:-1].astype("<u4")
    low = np.zeros(0, np.uint8)
    if width:
        rest = v & np.uint64((1 << width) - 1)
        low = np.packbits(((rest[:, None] >> np.arange(width - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel())
    return struct.pack(_HEAD, n, base % 2**64, width, size) + vector.tobytes() + ranks.tobytes() + low.tobytes()


class EliasFano:
    """Values by their place, from the bytes of encode()."""

    def __init__(self, data: bytes):
        self.n, self.base, self.width, size = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        self.vector = np.frombuffer(data, np.uint8, size, at)
        self.ranks = np.frombuffer(data, "<u4", size // _BLOCK, at + size)
        at += size + 4 * (size // _BLOCK)
        self.low = np.frombuffer(data, np.uint8, -(-self.n * self.width // 8), at)

    def __len__(self) -> int:
        return self.n

    def select(self, places: np.ndarray) -> np.ndarray:
        """The values at `places` (each from 0 to n - 1)."""
        places = np.asarray(places, np.int64)
        out = np.zeros(len(places), np.uint64)
        for s in range(0, len(places), 1 << 14):
            p = places[s:s + (1 << 14)]
            block = np.searchsorted(self.ranks, p, "right") - 1
            bits = np.unpackbits(self.vector.reshape(-1, _BLOCK)[block], axis=1)
            nth = (p - self.ranks[block].astype(np.int64) + 1)[:, None]
            within = (np.cumsum(bits, axis=1, dtype=np.int32) >= nth).argmax(axis=1)
            high = (block * 8 * _BLOCK + within - p).astype(np.uint64)
            low = np.zeros(len(p), np.uint64)
            for b in range(self.width):
                at = p * self.width + b
                low = (low << np.uint64(1)) | ((self.low[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(np.uint64)
            out[s:s + len(p)] = ((high << np.uint64(self.width)) | low) + np.uint64(self.base)
        return out.view(np.int64)
