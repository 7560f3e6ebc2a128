"""Suffix sorting by hash comparison: mergesort whose comparisons find common extensions by binary search."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15


class PrefixHashes:
    """Polynomial hashes modulo 2^64 of every substring of a byte array."""

    def __init__(self, text: np.ndarray, base: int = _BASE):
        n = len(text)
        self.up, self.down = powers(n + 1, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((text.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, at least n of each."""
    if base not in _powers or len(_powers[base][0]) < n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            all_ = np.full(n, b, np.uint64)
            all_[0] = 1
            both.append(np.multiply.accumulate(all_))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of suffixes a and b, at most ``most``."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) >> 1
        same = (hashes.of(a, mid) == hashes.of(b, mid)) & open_
        low = np.where(same, mid, low)
        high = np.where(open_ & ~same, mid - 1, high)
    return low


def sort_suffixes(text: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings text[start : start + length] within their groups, and verified common prefixes.

    group is in rising order.  The second result has, for each place of the order, the common
    prefix with the place before, and -1 where a group begins.
    """
    n = len(start)
    hashes = PrefixHashes(text)
    padded = np.append(text, np.uint8(0))
    change = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(change, n))
    begin, size_of = np.repeat(change, size), np.repeat(size, size)
    order, at = np.arange(n), np.arange(n) - begin

    def before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether string x sorts before string y; equal strings in the order of their numbers."""
        most = np.minimum(length[x], length[y])
        ext = common_extension(hashes, start[x], start[y], most)
        cx, cy = padded[start[x] + ext], padded[start[y] + ext]
        shorter = (length[x] < length[y]) | ((length[x] == length[y]) & (x < y))
        return np.where(ext < most, cx < cy, shorter)

    width = 1
    while (live := np.flatnonzero(size_of > width)).size:
        run = at[live] // width
        other = run ^ 1
        lo = begin[live] + np.minimum(other * width, size_of[live])
        hi = begin[live] + np.minimum((other + 1) * width, size_of[live])
        first, mine = lo.copy(), order[live]
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            ask = np.flatnonzero(open_)
            less = np.zeros(len(lo), bool)
            less[ask] = before(order[mid[ask]], mine[ask])
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        to = begin[live] + (run >> 1) * 2 * width + at[live] % width + (lo - first)
        order[to] = mine
        width *= 2

    lcp, sorted_ = _verified(padded, start, length, order, begin)
    if not sorted_:  # two different substrings had one hash
        for a, k in zip(change, size):
            order[a : a + k] = sorted(range(a, a + k), key=lambda i: (text[start[i] : start[i] + length[i]].tobytes(), i))
        lcp, _ = _verified(padded, start, length, order, begin)
    return order, lcp


def _verified(padded: np.ndarray, start: np.ndarray, length: np.ndarray, order: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, bool]:
    """Common prefixes of neighbours, byte by byte, and whether the order is the sorted one."""
    n, good = len(order), True
    lcp = np.full(n, -1, np.int64)
    step = max(1, (1 << 22) // (int(length.max(initial=0)) + 1))
    for i in range(1, n, step):
        place = np.arange(i, min(i + step, n))
        place = place[begin[place] != place]
        x, y = order[place - 1], order[place]
        most = np.minimum(length[x], length[y])
        span = np.arange(int(most.max(initial=0)))
        same = padded[np.minimum(start[x, None] + span, len(padded) - 1)] == padded[np.minimum(start[y, None] + span, len(padded) - 1)]
        same &= span < most[:, None]
        ext = np.where(same.all(1), most, same.argmin(1)) if len(span) else most
        lcp[place] = ext
        cx, cy = padded[start[x] + ext], padded[start[y] + ext]
        good &= bool(np.where(ext < most, cx < cy, length[x] <= length[y]).all())
    return lcp, good
