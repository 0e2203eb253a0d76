"""Elias-Fano sequences on numpy: monotone integers in about 2 + log2(universe / n) bits each.

The low bits are packed; the high bits are unary in a bit vector with a count of its zeros and ones before
every 64-bit word. `successor_in` searches a value within a range of places by jumping to the run of equal high bits.
"""

from __future__ import annotations

import numpy as np

ONE, SIX = np.uint64(1), np.uint64(6)
#: The same byte in all eight; the place of the n-th set bit of a byte b, at 8 * b + n.
EACH, EVEN, TWOS, FOURS, TOPS = (np.uint64(x * 0x0101010101010101) for x in (1, 0x55, 0x33, 0x0F, 0x80))
SELECT = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[:8] for b in range(256)], np.uint64).reshape(-1)


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit (from 0) of each word: its byte by sums of the bytes' bits, its place there by a table."""
    n = n.astype(np.uint64)
    sums = words - (words >> ONE & EVEN)
    sums = (sums & TWOS) + (sums >> np.uint64(2) & TWOS)
    sums = ((sums + (sums >> np.uint64(4))) & FOURS) * EACH  # in each byte: bits up to its end
    skip = np.bitwise_count(((n * EACH) | TOPS) - sums & TOPS).astype(np.uint64) << np.uint64(3)
    n -= (sums << np.uint64(8)) >> skip & np.uint64(255)
    return skip + SELECT[((words >> skip & np.uint64(255)) << np.uint64(3) | n & np.uint64(7)).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence below `universe`."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.low, self.high, self.ones = n, bits, low, high, ones
        self.zeros = np.arange(len(high), dtype=np.int64) * 64 - ones  # zeros before each word
        self.from_byte = np.ndarray(8 * len(low) - 7, np.uint64, low, strides=1) if bits <= 57 else None  # the eight bytes from each one

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values, n = values.astype(np.uint64), len(values)
        bits = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits and n:
            part, at = values & np.uint64((1 << bits) - 1), np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> SIX).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (max(1, universe) >> bits) + n + 1
        flags = np.zeros((size // 64 + 1) * 64, np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.cumsum(counts) - counts)

    def nbytes(self) -> int:
        return self.low.nbytes + self.high.nbytes + self.ones.nbytes

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        if self.from_byte is not None:
            at = i * self.bits
            return self.from_byte[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> SIX).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        over = shift + np.uint64(self.bits) > np.uint64(64)
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places i."""
        i = np.asarray(i, np.int64)
        word = np.searchsorted(self.ones, i, side="right") - 1
        place = word * 64 + _nth_bit(self.high[word], i - self.ones[word]).astype(np.int64)
        return ((place - i).astype(np.uint64) << np.uint64(self.bits) | self._low(i)).astype(np.int64)

    def _run_start(self, h: np.ndarray) -> np.ndarray:
        """How many values have high bits below h: ones before the h-th zero (counted from 1)."""
        word = np.searchsorted(self.zeros, h - 1, side="right") - 1
        place = word * 64 + _nth_bit(~self.high[word], h - 1 - self.zeros[word]).astype(np.int64)
        return np.where(h > 0, place - h + 1, 0)

    def _run(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the values with high bits h begin and end. Most runs end within the 64 bits that follow their zero."""
        start = self._run_start(h)
        at = (start + h).astype(np.uint64)  # the place in the bit vector
        word, shift = (at >> SIX).astype(np.int64), at & np.uint64(63)
        bits = self.high[word] >> shift
        over = np.flatnonzero((shift > 0) & (word + 1 < len(self.high)))
        bits[over] |= self.high[word[over] + 1] << (np.uint64(64) - shift[over])
        length = np.bitwise_count(bits ^ (bits + ONE)).astype(np.int64) - 1
        end = start + length
        far = np.flatnonzero(length >= 63 - shift.astype(np.int64) * (word + 1 >= len(self.high)))
        if len(far):
            end[far] = self._run_start(h[far] + 1)
        return start, np.minimum(end, self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each x: the first place of its run of equal high bits whose low bits are x's or more, the first place of x or -1, and
        whether x is beyond all runs."""
        h = x >> self.bits
        last = (len(self.high) * 64 - self.n) - 1  # zeros that the vector has, less one
        out = h >= last
        lo, hi = self._run(np.where(out, 0, h))
        hi[out] = lo[out]
        want = (x & ((1 << self.bits) - 1)).astype(np.uint64)
        found = np.full(len(x), -1, np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):  # halving within the run, whose low bits ascend
            first, end = lo[open_], hi[open_]
            mid = (first + end) >> 1
            low, own = self._low(mid), want[open_]
            less, same = low < own, np.flatnonzero(low == own)
            found[open_[same]] = mid[same]
            first, end = np.where(less, mid + 1, first), np.where(less, end, mid)
            lo[open_], hi[open_] = first, end
            open_ = open_[first < end]
        return lo, found, out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place whose value is x or more (n if there is none)."""
        lo, _, out = self._search(np.asarray(x, np.int64))
        return np.where(out, self.n, lo)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The first place of value x, or -1."""
        return self._search(np.asarray(x, np.int64))[1]

    def arrays(self) -> dict[str, np.ndarray]:
        return {"meta": np.array([self.n, self.bits], np.int64), "low": self.low, "high": self.high, "ones": self.ones}

    @classmethod
    def of(cls, a: dict[str, np.ndarray]) -> EliasFano:
        return cls(int(a["meta"][0]), int(a["meta"][1]), a["low"], a["high"], a["ones"])
