"""Elias-Fano sequences in numpy: monotone 64-bit integers with vectorised successor search, kept in one byte string."""

from __future__ import annotations

import numpy as np

_POP = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: _ZERO[b, k]: place of the k-th zero bit of byte b, from the lowest.
_ZERO = np.array([[*(i for i in range(8) if not b >> i & 1), *[8] * 8][:8] for b in range(256)], np.uint8)


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of each value, one after the other, in bytes (8 spare bytes follow)."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    out = []
    for at in range(0, len(values), 1 << 16):  # 1 << 16 values of any width end at a byte
        part = values[at:at + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    return np.concatenate([*out, np.zeros(8, np.uint8)])


def get_bits(data: np.ndarray, index: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros(len(index), np.uint64)
    at = index.astype(np.int64) * width
    byte = at >> 3
    word = np.zeros(len(index), np.uint64)
    for k in range((width + 14) >> 3 if width <= 57 else 8):
        word |= data[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return (word >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)


class EliasFano:
    """``low``: packed low bits; ``high``: unary high bits; ``zeros``: zero bits before each 64-bit word of ``high``."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.width, self.low, self.high, self.zeros = n, width, low, high, zeros

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """From ascending values below 2 ** 62."""
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = min(57, max(0, (top // max(n, 1)).bit_length() - 1))
        buckets = (values >> np.uint64(width)).astype(np.int64)
        size = n + (int(buckets[-1]) if n else 0) + 1
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[buckets + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little")
        per_word = 64 - _POP[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)
        zeros = np.concatenate([[0], np.cumsum(per_word)]).astype(np.uint32 if size < 1 << 32 else np.uint64)
        return cls(n, width, pack_bits(values & np.uint64((1 << width) - 1), width), high, zeros)

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.zeros]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])

    def _zero_place(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero bit (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        left = k - self.zeros[word].astype(np.int64)
        bytes_ = self.high[word[:, None] * 8 + np.arange(8)]
        free = np.cumsum(8 - _POP[bytes_], axis=1, dtype=np.int64)
        byte = (free <= left[:, None]).sum(axis=1)
        left -= np.where(byte > 0, free[np.arange(len(k)), np.maximum(byte - 1, 0)], 0)
        return word * 64 + byte * 8 + _ZERO[bytes_[np.arange(len(k)), np.minimum(byte, 7)], left]

    def at(self, index: np.ndarray) -> np.ndarray:
        """The elements at ``index``: high bits from the place of the index-th one bit, low bits as they are."""
        ones = 64 * np.arange(len(self.zeros)) - self.zeros.astype(np.int64)
        word = np.searchsorted(ones, index, "right") - 1
        left = index - ones[word]
        bytes_ = ~self.high[word[:, None] * 8 + np.arange(8)]
        held = np.cumsum(8 - _POP[bytes_], axis=1, dtype=np.int64)
        byte = (held <= left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, held[np.arange(len(index)), np.maximum(byte - 1, 0)], 0)
        place = word * 64 + byte * 8 + _ZERO[bytes_[np.arange(len(index)), np.minimum(byte, 7)], left]
        return (place - index) << self.width | get_bits(self.low, index, self.width).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1: the first element of at least x, found in the bucket of its high bits."""
        out = np.full(len(x), -1, np.int64)
        if not self.n or not len(x):
            return out
        x = x.astype(np.uint64)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        most = int(self.zeros[-1])
        inside = np.flatnonzero(bucket < most)
        bucket, low = bucket[inside], x[inside] & np.uint64((1 << self.width) - 1)
        if 8 * len(x) > self.n:  # for many lookups at once all buckets' ends are decoded, for as long as this takes
            ends = np.flatnonzero(np.unpackbits(self.high, bitorder="little") == 0)
            ends -= np.arange(len(ends))
            start, stop = np.where(bucket > 0, ends[bucket - 1], 0), ends[bucket]
        else:
            start = np.where(bucket > 0, self._zero_place(np.maximum(bucket - 1, 0)) - bucket + 1, 0)
            stop = self._zero_place(bucket) - bucket
        at, end, todo = start, stop.copy(), np.flatnonzero(start < stop)
        while len(todo):  # by halves: buckets of a frequent context are long
            middle = (at[todo] + end[todo]) >> 1
            less = get_bits(self.low, middle, self.width) < low[todo]
            at[todo[less]] = middle[less] + 1
            end[todo[~less]] = middle[~less]
            todo = todo[at[todo] < end[todo]]
        hit = np.flatnonzero(at < stop)
        hit = hit[get_bits(self.low, at[hit], self.width) == low[hit]]
        out[inside[hit]] = at[hit]
        return out
