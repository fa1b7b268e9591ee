"""A sparse suffix sort by mergesort, whose comparisons look up prefix hashes.

Two suffixes are compared by the length of their common extension, found by binary search over prefix polynomial
hashes; the byte after it decides.  A merge computes the rank of every suffix of a run in the run beside it, for all
pairs of runs at once.
"""

from __future__ import annotations

import numpy as np

from .blocks import BYTE_SYMBOLS, Rolling

HEAD = 8


class Suffixes:
    """Suffixes of `data` that begin at `starts`, cut to `length` bytes: one number, or one for each."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, length, rolling: Rolling | None = None):
        self.data, self.starts = data, starts.astype(np.int64)
        self.length = np.broadcast_to(np.asarray(length, np.int64), self.starts.shape)
        self.rolling = rolling or Rolling(BYTE_SYMBOLS[data])
        self.steps = [1 << b for b in range(int(self.length.max(initial=1)).bit_length() - 1, -1, -1)]
        self.head = np.zeros(len(starts), np.uint64)
        for i in range(HEAD):  # the first bytes decide most comparisons
            inside = i < self.length
            byte = np.zeros(len(starts), np.uint64)
            byte[inside] = data[self.starts[inside] + i]
            self.head = (self.head << np.uint64(8)) | byte

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that suffixes a and b (indices) have in common: by binary search over the hashes of their beginnings."""
        x, y, most = self.starts[a], self.starts[b], np.minimum(self.length[a], self.length[b])
        common = np.zeros(len(a), np.int64)
        for step in self.steps:
            fits = common + step <= most
            i, j = x + common, y + common
            same = fits & (self.rolling.raw(i, np.where(fits, i + step, i)) == self.rolling.raw(j, np.where(fits, j + step, j)))
            common += step * same
        return common

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of indices; a beginning of another suffix comes before it."""
        out = (self.head[a] > self.head[b]).astype(np.int8) - (self.head[a] < self.head[b]).astype(np.int8)
        tied = np.flatnonzero(out == 0)
        if len(tied):
            p, q = a[tied], b[tied]
            common = self.extension(p, q)
            out[tied] = np.sign(self.length[p] - self.length[q])
            short = np.flatnonzero(common < np.minimum(self.length[p], self.length[q]))
            x = self.data[self.starts[p[short]] + common[short]].astype(np.int16)
            y = self.data[self.starts[q[short]] + common[short]].astype(np.int16)
            out[tied[short]] = np.sign(x - y)
        return out

    def order(self) -> np.ndarray:
        """Indices of the suffixes in byte order; equal ones keep their order.

        Suffixes whose first bytes no other has are in place once these are in order; mergesort orders the others.
        """
        order = np.argsort(self.head, kind="stable")
        h = self.head[order]
        alone = np.ones(len(h), bool)
        alone[1:] &= h[1:] != h[:-1]
        alone[:-1] &= h[1:] != h[:-1]
        order[~alone] = self._merged(order[~alone])
        return order

    def _merged(self, order: np.ndarray) -> np.ndarray:
        n, width = len(order), 1
        at = np.arange(n)
        while width < n:
            run = at // width
            left = run % 2 == 0
            low = (run ^ 1) * width  # the run beside it
            high = np.minimum(low + width, n)
            low = np.minimum(low, n)
            begin, lo, hi = low, low.copy(), high.copy()
            live = np.flatnonzero(lo < hi)
            while len(live):
                mid = (lo[live] + hi[live]) >> 1
                c = self.compare(order[live], order[mid])
                right = (c > 0) | ((c == 0) & ~left[live])  # of equal ones, those of the left run come first
                lo[live[right]] = mid[right] + 1
                hi[live[~right]] = mid[~right]
                live = live[lo[live] < hi[live]]
            pair = (at // (2 * width)) * 2 * width
            merged = np.empty(n, np.int64)
            merged[pair + at % width + (lo - begin)] = order
            order, width = merged, 2 * width
        return order

    def classes(self) -> np.ndarray:
        """The class of each suffix; two of a class have equal bytes.

        Neighbours of the sorted order with equal hashes are compared byte by byte, and a false match is told apart.
        """
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.int64)
        order = self.order()
        p, q = order[:-1], order[1:]
        same = (self.length[p] == self.length[q]) & (self.head[p] == self.head[q])
        hits = np.flatnonzero(same)
        same[hits] = self.extension(p[hits], q[hits]) >= self.length[p[hits]]
        hits = np.flatnonzero(same)
        longest = int(self.length.max(initial=1))
        wide, slab = np.arange(longest), max(1, (1 << 22) // longest)
        for s in range(0, len(hits), slab):
            x, y = p[hits[s : s + slab]], q[hits[s : s + slab]]
            inside = np.minimum(wide, self.length[x][:, None] - 1)  # the last byte again and again, where one is short
            same[hits[s : s + slab]] = (self.data[self.starts[x][:, None] + inside] == self.data[self.starts[y][:, None] + inside]).all(1)
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.r_[0, ~same])
        return out
