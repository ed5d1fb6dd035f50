"""Elias-Fano code of a non-decreasing sequence, with a sampled select structure.

n values up to u take n * l low bits (l = floor(log2(u / n))) plus at most 3 n bits
of unary high parts.  ``select`` finds the i-th set bit of the high part from a
sample of every ``EVERY``-th one, so a value is read without a table of offsets.
"""

from __future__ import annotations

import numpy as np

EVERY = 256
_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)
_HEAD = 4


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if width == 0 or len(values) == 0:
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    """Four int64 (n, low width, bytes of low part, bytes of high part), then low bits, high bits, uint32 select samples."""
    v = np.asarray(values, np.uint64)
    if len(v) and (np.diff(v.astype(np.int64)) < 0).any():
        raise ValueError("values must not decrease")
    n, u = len(v), int(v[-1]) + 1 if len(v) else 0
    width = max(0, (u // n).bit_length() - 1) if n else 0
    low = b"".join(_pack_bits(v[i : i + 65536] & np.uint64((1 << width) - 1), width) for i in range(0, n, 65536))
    at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
    bits[at] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    return np.array([n, width, len(low), len(high)], "<i8").tobytes() + low + high + at[::EVERY].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, blob: bytes):
        self.n, self.width, low, high = (int(x) for x in np.frombuffer(blob, "<i8", _HEAD))
        self.low = np.frombuffer(blob, np.uint8, low, 8 * _HEAD)
        self.high = np.frombuffer(blob, np.uint8, high, 8 * _HEAD + low)
        self.sample = np.frombuffer(blob, "<u4", -1, 8 * _HEAD + low + high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the i-th set bit (from 0) of the high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.sample[i // EVERY]), i % EVERY
        if left == 0:
            return at
        byte = at // 8
        left += int(_BITS[int(self.high[byte]) & ((1 << at % 8) - 1)])  # set bits before the sample in its byte
        while True:
            step = self.high[byte : byte + 64]
            total = np.cumsum(_BITS[step])
            k = int(np.searchsorted(total, left + 1))
            if k < len(step):
                left -= int(total[k - 1]) if k else 0
                return 8 * (byte + k) + int(np.flatnonzero(np.unpackbits(step[k : k + 1], bitorder="little"))[left])
            left -= int(total[-1])
            byte += len(step)

    def __getitem__(self, i: int) -> int:
        high = self.select(i) - i
        if self.width == 0:
            return high
        first = i * self.width
        part = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8].tobytes(), "little") >> first % 8
        return high << self.width | part & ((1 << self.width) - 1)

    def block(self, k: int) -> np.ndarray:
        """Values k * EVERY to (k + 1) * EVERY - 1 (or to the end), by the select sample of the first of them."""
        lo, hi = k * EVERY, min((k + 1) * EVERY, self.n)
        if not 0 <= lo < hi:
            raise IndexError(k)
        at = int(self.sample[k])
        stop = int(self.sample[k + 1]) // 8 + 1 if hi < self.n else len(self.high)
        found = np.flatnonzero(np.unpackbits(self.high[at // 8 : stop], bitorder="little")) + at // 8 * 8
        found = found[np.searchsorted(found, at) :][: hi - lo]
        out = (found - np.arange(lo, hi)) << self.width
        if self.width:
            first = lo * self.width  # EVERY values end on a byte
            bits = np.unpackbits(self.low[first // 8 : (hi * self.width + 7) // 8], bitorder="little")[: (hi - lo) * self.width]
            out += bits.reshape(hi - lo, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return out

    def all(self) -> np.ndarray:
        """All values; a scan, without select."""
        if self.n == 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)) << self.width
        if self.width:
            step = 65536 // 8 * 8
            for i in range(0, self.n, step):
                m = min(step, self.n - i)
                bits = np.unpackbits(self.low[i * self.width // 8 : (i + m) * self.width // 8 + 1], bitorder="little")[: m * self.width]
                out[i : i + m] += bits.reshape(m, self.width).astype(np.int64) @ (1 << np.arange(self.width, dtype=np.int64))
        return out
