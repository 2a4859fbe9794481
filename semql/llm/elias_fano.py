"""Elias-Fano coding of non-decreasing sequences, with sampled select.

Each of n values below u is split at bit l = floor(log2(u / n)). The low parts lie in an array of l
bits each; the high parts are counted in unary, a one for every value and a zero for every step of
the high part. Value i is then ((place of the i-th one) - i) << l plus its low part. Places of every
``EVERY``-th one are kept as 32-bit numbers, so a lookup scans few words: 2 + l bits a value in all,
and no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 512
_HEAD = struct.Struct("<QQB7x")


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other, lowest bit first."""
    if not width or not len(values):
        return b""
    bits = np.unpackbits(np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def _unpack(data: bytes, width: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` values of ``width`` bits, after ``skip`` bits."""
    if not width or not n:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=skip + n * width, bitorder="little")[skip:].reshape(n, width)
    whole = np.zeros((n, 64), np.uint8)
    whole[:, :width] = bits
    return np.packbits(whole, axis=1, bitorder="little").view("<u8").reshape(-1)


def encode(values: np.ndarray) -> bytes:
    """Header (count, universe, low bits), select samples, high bits, low bits."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    if n > 1 and (values[1:] < values[:-1]).any():
        raise ValueError("the values must not decrease")
    low = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
    ones = (values >> np.uint64(low)) + np.arange(n, dtype=np.uint64)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones.astype(np.int64)] = 1
    return _HEAD.pack(n, top, low) + ones[::EVERY].astype("<u4").tobytes() + np.packbits(high, bitorder="little").tobytes() + _pack(values, low)


class Reader:
    """Reads a sequence that ``encode`` wrote, whole or by position."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low = _HEAD.unpack_from(data)
        at, samples = _HEAD.size, -(-self.n // EVERY)
        self.samples = np.frombuffer(data, "<u4", samples, at)
        at += 4 * samples
        self.n_high = (self.top >> self.low) + self.n if self.n else 0
        size = -(-self.n_high // 8)
        self.high, self.lows = np.frombuffer(data, np.uint8, size, at), data[at + size :]

    def values(self, begin: int, end: int) -> np.ndarray:
        """Values ``begin`` to ``end - 1``: the ones from the sample before, and the low parts beside them."""
        if begin >= end:
            return np.zeros(0, np.uint64)
        near, last = begin // EVERY, -(-end // EVERY)
        at, stop = int(self.samples[near]), int(self.samples[last]) if last < len(self.samples) else self.n_high
        bits = np.unpackbits(self.high[at // 8 : -(-stop // 8)], bitorder="little")[at % 8 :][: stop - at]
        ones = (np.flatnonzero(bits) + at)[begin - near * EVERY : end - near * EVERY].astype(np.uint64) - np.arange(begin, end, dtype=np.uint64)
        first, bit = begin * self.low // 8, begin * self.low % 8
        return (ones << np.uint64(self.low)) | _unpack(self.lows[first:], self.low, end - begin, bit)

    def all(self) -> np.ndarray:
        return self.values(0, self.n)

    def select(self, i: int) -> int:
        """Value ``i``, from the nearest sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.values(i, i + 1)[0])

    def first_at_least(self, value: int) -> int:
        """The position of the first value that isn't smaller, by binary search over ``select``."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.select(mid) < value else (low, mid)
        return low
