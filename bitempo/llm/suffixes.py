"""Hash-compared suffix sorting.

Prefix polynomial hashes give the longest common extension of two suffixes by binary
search, so a comparison takes a logarithmic number of probes. Suffixes are sorted by
a bottom-up mergesort in which all merges of a level run at once: each suffix looks
up its rank in the sibling run by binary search. Equal prefixes are verified byte by
byte, so a hash collision cannot join different strings.
"""

from __future__ import annotations

import numpy as np

from bitempo.llm import hashing as H


class Suffixes:
    """Suffixes of an array of bytes or other small integers, compared up to a cap."""

    def __init__(self, data: np.ndarray):
        self.data = np.asarray(data)
        self.sums = H.prefix(self.data.astype(np.uint64) + np.uint64(1))
        self.down = H.POWERS.get(len(self.data) + 1)[1]

    def extension(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b, at most cap."""
        n = len(self.data)
        most = np.minimum(cap, n - np.maximum(a, b))
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        sa, sb, da, db = self.sums[a], self.sums[b], self.down[a], self.down[b]
        for _ in range(max(1, int(cap).bit_length())):
            mid = (low + high + 1) >> 1
            same = (self.sums[a + mid] - sa) * da == (self.sums[b + mid] - sb) * db
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
            high = np.maximum(high, low)
        return low

    def less(self, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
        """-1, 0 or 1 as the suffix at a stands before, with or behind that at b."""
        n = len(self.data)
        e = self.extension(a, b, cap)
        x = np.where(a + e < n, self.data[np.minimum(a + e, n - 1)].astype(np.int64), -1)
        y = np.where(b + e < n, self.data[np.minimum(b + e, n - 1)].astype(np.int64), -1)
        return np.where(e >= cap, 0, np.sign(x - y))

    def sort(self, starts: np.ndarray, segment: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes by (segment, string), and each one's extension with the one before it in its segment (-1 for a segment's first)."""
        order = np.argsort(segment, kind="stable")
        if not len(order):
            return order, np.zeros(0, np.int64)
        seg = segment[order]
        first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
        size = np.diff(np.append(first, len(seg)))
        base = np.repeat(first, size)
        rank = np.arange(len(seg)) - base
        count = np.repeat(size, size)
        items = starts[order]
        width = 1
        while width < size.max():
            run = rank // width
            mate = run ^ 1
            low = base + mate * width
            stop = np.minimum(low + width, base + count)
            act = np.flatnonzero(low < base + count)
            lo, hi = low[act].copy(), stop[act].copy()
            left = run[act] % 2 == 0
            while True:
                on = np.flatnonzero(lo < hi)
                if not len(on):
                    break
                mid = (lo[on] + hi[on]) >> 1
                c = self.less(items[act[on]], items[mid], cap)
                behind = (c > 0) | (c == 0) & ~left[on]  # equal ones of the left run come first
                lo[on] = np.where(behind, mid + 1, lo[on])
                hi[on] = np.where(behind, hi[on], mid)
            to = np.arange(len(seg))
            pair = base[act] + (run[act] & ~1) * width
            to[act] = pair + (rank[act] - run[act] * width) + (lo - low[act])
            moved, ranked = np.empty_like(items), np.empty_like(order)
            moved[to], ranked[to] = items, order
            items, order = moved, ranked
            width *= 2
        same = np.full(len(seg), -1, np.int64)
        inner = np.flatnonzero(rank > 0)
        same[inner] = self.extension(items[inner - 1], items[inner], cap)
        return order, same

    def classes(self, starts: np.ndarray, segment: np.ndarray, cap: int) -> tuple[np.ndarray, int]:
        """Class number of each suffix: equal in segment and in their first cap bytes. All must have cap bytes."""
        order, same = self.sort(starts, segment, cap)
        joined = same >= cap
        at = np.flatnonzero(joined)
        for a in range(0, len(at), 1 << 16):
            k = at[a : a + (1 << 16)]
            x, y = starts[order[k - 1]], starts[order[k]]
            wide = np.arange(cap)
            joined[k] = (self.data[x[:, None] + wide] == self.data[y[:, None] + wide]).all(axis=1)
        number = np.cumsum(~joined) - 1
        out = np.empty(len(starts), np.int64)
        out[order] = number
        return out, int(number[-1]) + 1 if len(number) else 0


def suffix_array(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a byte string, and the common extension of each suffix with the one before it."""
    d = np.frombuffer(data, np.uint8)
    s = Suffixes(d)
    order, same = s.sort(np.arange(len(d)), np.zeros(len(d), np.int64), max(1, len(d)))
    if len(same):
        same[0] = 0
    return order, same
