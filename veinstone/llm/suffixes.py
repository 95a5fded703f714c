"""Suffix arrays by induced sorting, in array steps over whole buckets."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last symbol is a unique smallest one."""
    n = len(s)
    smaller = np.zeros(n, bool)
    smaller[-1] = True
    change = np.flatnonzero(s[:-1] != s[1:])  # the last symbol differs from the one before
    next_change = change[np.searchsorted(change, np.arange(n - 1))]
    smaller[:-1] = s[next_change] < s[next_change + 1]
    return smaller


class _Induction:
    """Fills a suffix array from sorted leftmost-smaller suffixes: larger types upwards, smaller ones downwards.

    A bucket is all suffixes with one first symbol. Whoever precedes a suffix of a finished bucket goes,
    in that order, to the open end of its own bucket; all of a bucket goes in one array step, and what
    falls into the same bucket again (runs of a symbol) in the next.
    """

    def __init__(self, s: np.ndarray, smaller: np.ndarray):
        self.s, self.smaller = s, smaller
        size = np.bincount(s)
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.used = np.flatnonzero(size)

    def _deal(self, sa, before, pointer, down):
        """Puts suffixes into their buckets at ``pointer``, in order; returns those symbols' ranges."""
        symbol = self.s[before]
        order = np.argsort(symbol, kind="stable")
        dealt = symbol[order]
        edge = np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]])
        count = np.diff(np.append(edge, len(dealt)))
        rank = np.arange(len(dealt)) - np.repeat(edge, count)
        base = pointer[dealt]
        sa[base - 1 - rank if down else base + rank] = before[order]
        pointer[dealt[edge]] += -count if down else count

    def run(self, seeds: np.ndarray) -> np.ndarray:
        s, smaller = self.s, self.smaller
        n = len(s)
        sa = np.full(n, -1, np.int64)
        # seeds (leftmost smaller suffixes in their order) to the ends of their buckets
        symbol = s[seeds]
        count = np.bincount(symbol, minlength=len(self.ends))
        first = self.ends - count
        order = np.argsort(symbol, kind="stable")
        seated = symbol[order]
        edge = np.cumsum(count) - count
        sa[first[seated] + np.arange(len(seeds)) - edge[seated]] = seeds[order]
        head = self.starts.copy()
        for c in self.used:
            at = self.starts[c]
            while at < head[c]:  # larger-type suffixes of this bucket, with those its own runs add
                upto = head[c]
                before = sa[at:upto] - 1
                at = upto
                before = before[before >= 0]
                before = before[~smaller[before]]
                if len(before):
                    self._deal(sa, before, head, False)
            low = first[c]
            if low < self.ends[c]:
                before = sa[low:self.ends[c]] - 1
                before = before[before >= 0]
                before = before[~smaller[before]]
                if len(before):
                    self._deal(sa, before, head, False)
        tail = self.ends.copy()
        for c in self.used[::-1]:
            at = self.ends[c]
            while at > tail[c]:
                upto = tail[c]
                before = sa[upto:at][::-1] - 1
                at = upto
                before = before[before >= 0]
                before = before[smaller[before]]
                if len(before):
                    self._deal(sa, before, tail, True)
            if c == self.used[0]:
                sa[self.starts[c]] = n - 1  # the closing symbol
            larger = sa[self.starts[c]:head[c]] if c != self.used[0] else sa[self.starts[c]:self.ends[c]]
            before = larger[::-1] - 1
            before = before[before >= 0]
            before = before[smaller[before]]
            if len(before):
                self._deal(sa, before, tail, True)
        return sa


def _names(s: np.ndarray, left: np.ndarray, sorted_left: np.ndarray) -> np.ndarray:
    """Equal numbers for equal leftmost-smaller substrings, in their order, by position."""
    following = np.empty(len(s), np.int64)
    following[left] = np.append(left[1:], len(s) - 1)
    a, b = sorted_left[:-1], sorted_left[1:]
    length = following[a] - a
    same = length == following[b] - b
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        open_ = open_[length[open_] >= step]
        differs = s[a[open_] + step] != s[b[open_] + step]
        same[open_[differs]] = False
        open_ = open_[~differs]
        step += 1
    name = np.empty(len(s), np.int64)
    name[sorted_left] = np.append(0, np.cumsum(~same))
    return name[left]


def _sort_names(name: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string: names of pairs of names, until all are told apart."""
    rank, step, n = name, 1, len(name)
    while True:
        second = np.zeros(n, np.int64)
        second[:n - step] = rank[step:] + 1
        key = rank * np.int64(n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.append(0, np.cumsum(key[order[1:]] != key[order[:-1]]))
        rank = new
        step *= 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``s`` in order; its last symbol must be 0 and unique.

    Suffixes are classified as smaller or larger than the next; leftmost smaller substrings are sorted by
    induction, named, and where names repeat the reduced string is sorted by its own names; from the
    order of the leftmost smaller suffixes all others are induced.
    """
    s = s.astype(np.int64)
    smaller = _types(s)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(left):
        return np.argsort(s, kind="stable")
    induction = _Induction(s, smaller)
    rough = induction.run(left)
    is_left = np.zeros(len(s), bool)
    is_left[left] = True
    name = _names(s, left, rough[is_left[rough]])
    if name.max() + 1 < len(name):
        order = _sort_names(name)
    else:
        order = np.empty(len(name), np.int64)
        order[name] = np.arange(len(name))
    return induction.run(left[order])


def common_prefixes(s: np.ndarray, sa: np.ndarray, starts: np.ndarray, lengths: np.ndarray, separator: int) -> np.ndarray:
    """For each position, the symbols its suffix shares with the one before it in the array (permuted order).

    Within a piece of text the value falls by at most one from position to position, so each comparison
    goes on where the last one ended; all pieces advance together. A separator equals nothing.
    """
    ahead = np.full(len(s), -1, np.int64)
    ahead[sa[1:]] = sa[:-1]
    out = np.zeros(len(s), np.int64)
    shared = np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max())):
        live = np.flatnonzero(lengths > t)
        at = starts[live] + t
        other = ahead[at]
        h = np.maximum(shared[live] - 1, 0)
        h[other < 0] = 0
        growing = np.flatnonzero(other >= 0)
        while len(growing):
            x, y = s[at[growing] + h[growing]], s[other[growing] + h[growing]]
            growing = growing[(x == y) & (x > separator)]
            h[growing] += 1
        shared[live] = h
        out[at] = h
    return out
