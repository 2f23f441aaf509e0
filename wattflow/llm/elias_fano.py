"""Elias-Fano coding of ascending numbers, with select."""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"EFB1"
#: Every so many set bits the place of one is kept, so that select reads a short stretch of the upper bits.
SAMPLE = 256
#: Numbers whose low bits are packed at once; a multiple of 8, so that lots end at whole bytes.
LOT = 1 << 16
_HEAD = struct.Struct("<4sQQB")


class EliasFano:
    """n ascending numbers from 0 to top: low bits packed, high bits as gaps in a bit vector, n * (2 + log2(top / n)) bits in all."""

    def __init__(self, n: int, top: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.samples = n, top, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must ascend")
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = [np.packbits(((values[a : a + LOT, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, LOT)]
        low = np.concatenate([np.zeros(0, np.uint8), *low])
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(n + (top >> low_bits) + 1, np.uint8)
        bits[at] = 1
        return cls(n, top, low_bits, low, np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        return _HEAD.pack(MAGIC, self.n, self.top, self.low_bits) + self.samples.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The coded numbers at a place, and the place behind them."""
        magic, n, top, low_bits = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not an Elias-Fano block")
        at += _HEAD.size
        sizes = [-(-n // SAMPLE) * 8, (n * low_bits + 7) // 8, (n + (top >> low_bits) + 1 + 7) // 8]
        parts = []
        for size, kind in zip(sizes, ("<u8", np.uint8, np.uint8), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, top, low_bits, parts[1], parts[2], parts[0]), at

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low_bits):
            at = i * self.low_bits + b
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int) -> int:
        """The i-th number."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        left = i % SAMPLE
        byte = int(self.samples[i // SAMPLE])
        bits = np.unpackbits(self.high[byte // 8 : byte // 8 + 64], bitorder="little")[byte % 8 :]
        place, base, taken = None, byte, len(bits)
        ones = np.flatnonzero(bits)
        while len(ones) <= left:  # a wide gap: the stretch grows
            more = np.unpackbits(self.high[(base + taken) // 8 : (base + taken) // 8 + 1024], bitorder="little")
            ones = np.concatenate([ones, np.flatnonzero(more) + taken])
            taken += len(more)
        place = base + int(ones[left])
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def between(self, first: int, last: int) -> np.ndarray:
        """The numbers from the first-th to before the last-th, by select on the stretch of upper bits between two samples."""
        if not 0 <= first <= last <= self.n:
            raise IndexError((first, last))
        if first == last:
            return np.zeros(0, np.uint64)
        begin, behind = int(self.samples[first // SAMPLE]), (last - 1) // SAMPLE + 1
        end = int(self.samples[behind]) if behind < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little"))
        ones = ones[np.searchsorted(ones, begin % 8) :][first % SAMPLE : first % SAMPLE + last - first] + begin // 8 * 8
        i = np.arange(first, last)
        return (ones - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)
