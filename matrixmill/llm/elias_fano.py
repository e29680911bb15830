"""Monotone sequences in Elias-Fano form: n numbers below u in about 2 + log2(u / n) bits each, read and searched without unpacking.

All methods take and give numpy arrays, so one call answers many look-ups. Many look-ups in ascending order meet the sequence
in runs of bounded length, each read in one go.
"""

from __future__ import annotations

import numpy as np

_CHUNK = 1 << 16  # numbers whose low bits are laid out at once; a multiple of 8
_RUN = 1 << 16  # numbers read at once for look-ups in ascending order
_DENSE = 16  # such look-ups are many from one in so many numbers on


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits, lowest first, in 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")


def _nth_bit(words: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit, from 0, of each word."""
    w, left, place = words.copy(), n.astype(np.int64), np.zeros(len(n), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(w & np.uint64((1 << half) - 1)).astype(np.int64)
        on = left >= below
        place += on * half
        left -= on * below
        w = np.where(on, w >> np.uint64(half), w)
    return place


class EliasFano:
    """Built from ascending numbers, or from the parts that `parts` gave (also memory-mapped ones)."""

    def __init__(self, size: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray) -> None:
        self.size, self.low, self.high, self.ones = size, low, high, ones
        self.n, self.shift = int(size[0]), int(size[1])
        self.mask = np.uint64((1 << self.shift) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        x = values.astype(np.uint64)
        n = len(x)
        shift = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        places = np.arange(shift, dtype=np.uint64)
        low = [np.packbits(((x[a : a + _CHUNK, None] >> places) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, _CHUNK)] if shift else []
        flat = np.concatenate([*low, np.zeros(16, np.uint8)])
        low_words = flat[: len(flat) // 8 * 8].view("<u8") if len(flat) % 8 == 0 else np.concatenate([flat, np.zeros(-len(flat) % 8, np.uint8)]).view("<u8")
        bits = np.zeros(n + (universe >> shift) + 2, np.uint8)
        bits[(x >> np.uint64(shift)).astype(np.int64) + np.arange(n)] = 1
        high = _words(bits)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        return cls(np.array([n, shift], np.int64), low_words, high, ones)

    def parts(self) -> dict[str, np.ndarray]:
        return {"size": self.size, "low": self.low, "high": self.high, "ones": self.ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.shift:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.shift
        word, off = at >> 6, (at & 63).astype(np.uint64)
        # shifted in two steps: a shift by 64 is undefined
        return ((self.low[word] >> off) | ((self.low[word + 1] << np.uint64(1)) << (np.uint64(63) - off))) & self.mask

    def _many(self, x: np.ndarray) -> bool:
        return len(x) * _DENSE > self.n > 0 and bool((x[1:] >= x[:-1]).all())

    def _run(self, a: int, b: int) -> np.ndarray:
        """The numbers a to b - 1."""
        first, last = np.searchsorted(self.ones, [a, b - 1], "right") - 1
        places = np.flatnonzero(np.unpackbits(self.high[first : last + 1].view(np.uint8), bitorder="little"))[a - self.ones[first] : b - self.ones[first]]
        i = np.arange(a, b)
        return ((places + (first * 64 - i)).astype(np.uint64) << np.uint64(self.shift)) | self._low(i)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        if not self._many(i):
            return self._each(i)
        out = np.empty(len(i), np.uint64)
        starts = range(0, self.n, _RUN)
        cuts = np.searchsorted(i, [*starts, self.n]).tolist()
        for a, x, y in zip(starts, cuts, cuts[1:]):
            if x < y:
                out[x:y] = self._run(a, min(a + _RUN, self.n))[i[x:y] - a]
        return out

    def _each(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, "right") - 1
        place = word * 64 + _nth_bit(self.high[word], i - self.ones[word])
        return ((place - i).astype(np.uint64) << np.uint64(self.shift)) | self._low(i)

    def _zero(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.zeros, i, "right") - 1
        return word * 64 + _nth_bit(~self.high[word], i - self.zeros[word])

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the index of its first successor (itself, if there), and whether it is there. Values lie below the universe."""
        y = values.astype(np.uint64)
        return self._find_ascending(y) if self._many(y) else self._find_each(y)

    def _find_ascending(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, there = np.full(len(y), self.n), np.zeros(len(y), bool)
        starts = np.arange(0, self.n, _RUN)
        ends = np.minimum(starts + _RUN, self.n)
        cuts = np.searchsorted(y, self._each(ends - 1), "right").tolist()
        for a, b, start, stop in zip(starts.tolist(), ends.tolist(), [0, *cuts], cuts):
            if start < stop:
                run, wanted = self._run(a, b), y[start:stop]
                i = np.searchsorted(run, wanted)
                at[start:stop], there[start:stop] = a + i, run[i] == wanted
        return at, there

    def _find_each(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket, low = (y >> np.uint64(self.shift)).astype(np.int64), y & self.mask
        a = np.where(bucket > 0, self._zero(np.maximum(bucket - 1, 0)) - (bucket - 1), 0)
        end = self._zero(bucket) - bucket
        b = end.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            mid = (a[live] + b[live]) >> 1
            less = self._low(mid) < low[live]
            a[live] = np.where(less, mid + 1, a[live])
            b[live] = np.where(less, b[live], mid)
            live = live[a[live] < b[live]]
        there = a < end
        there[there] = self._low(a[there]) == low[there]
        return a, there
