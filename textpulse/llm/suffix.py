"""Suffix arrays over words, built with numpy for the texts of one bounded slice."""

from __future__ import annotations

import numpy as np


def word_groups(symbols: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """For each position, how many ``width``-word windows sort before its own, and how many equal it.

    Symbol 0 ends a text; a window cut short by it sorts as if filled with zeros, and counts 0.
    """
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(width, symbols.dtype))).astype(np.int64)
    group, full, open_ = padded[:n], symbols > 0, symbols > 0
    for k in range(1, width):
        after = np.where(open_, padded[k : n + k], 0)
        open_ = after > 0
        _, group = np.unique(group * (int(symbols.max(initial=0)) + 1) + after, return_inverse=True)
        full = full & open_
    if width == 1:
        _, group = np.unique(group, return_inverse=True)
    members = np.bincount(group) if n else np.zeros(0, np.int64)
    return (np.cumsum(members) - members)[group], np.where(full, members[group], 0)


def repeat_lengths(symbols: np.ndarray, head: np.ndarray, count: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``width``-word window repeats, and the length of their longest repeat.

    The suffixes at those positions are sorted by prefix doubling from the given windows: each
    level ranks windows of twice the words, within the groups that are still tied. The common
    prefix of neighbours in that order, taken from the levels, gives the LCP array; the longer
    of a suffix's two is the longest text from there that occurs again. Texts must not share
    symbols (so that a repeat never spans two texts).
    """
    levels, live, size = [head], np.flatnonzero(count > 1), width
    first = live
    n = len(symbols)
    while len(live):
        rank = levels[-1]
        follow = rank[np.minimum(live + size, n - 1)]
        sorting = np.lexsort((follow, rank[live]))
        live, follow = live[sorting], follow[sorting]
        old = rank[live]
        at = np.arange(len(live))
        new_group = np.concatenate(([True], old[1:] != old[:-1]))
        new_rank = new_group | np.concatenate(([True], follow[1:] != follow[:-1]))
        starts = np.maximum.accumulate(np.where(new_rank, at, 0))
        level = rank.copy()
        level[live] = old + starts - np.maximum.accumulate(np.where(new_group, at, 0))
        levels.append(level)
        members = np.bincount(starts, minlength=len(live))
        live, size = live[members[starts] > 1], size * 2
    order = first[np.argsort(levels[-1][first], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][np.minimum(a + common, n - 1)] == levels[k][np.minimum(b + common, n - 1)]
        common[same] += width << k
    steps = common.copy()
    for _ in range(width - 1):  # what is left is shorter than a window
        x, y = symbols[np.minimum(a + common, n - 1)], symbols[np.minimum(b + common, n - 1)]
        alive = (x == y) & (x > 0) & (steps == common)
        common[alive] += 1
        steps = np.where(alive, common, -1)
    longest = np.zeros(len(order), np.int64)
    if len(order) > 1:
        longest[:-1] = common
        longest[1:] = np.maximum(longest[1:], common)
    return order, longest


class SuffixArray:
    """Sorted suffixes of a symbol array, for binary search. Symbol 0 ends a text and is no start."""

    def __init__(self, symbols: np.ndarray, depth: int, kept: np.ndarray | None = None):
        """``depth``: the suffixes are ordered by that many symbols at least. ``kept``: only these
        suffixes (of those that begin a text's rest at least as long as any query's window)."""
        self.symbols = np.concatenate((symbols.astype(np.int64), [0]))
        starts = np.flatnonzero(symbols if kept is None else (symbols > 0) & kept)
        live = starts if kept is None else _rests(self.symbols, starts)
        rank, width, n = np.where(np.isin(np.arange(len(self.symbols)), live), self.symbols, 0), 1, len(symbols)
        while width < depth and len(live):
            key = rank[live] * (int(rank.max()) + 1) + rank[np.minimum(live + width, n)]
            found, group = np.unique(key, return_inverse=True)
            rank[live] = group + 1
            width *= 2
            if len(found) == len(live):
                break
        self.order = starts[np.argsort(rank[starts], kind="stable")]

    def search(self, queries: np.ndarray, starts: np.ndarray, lengths: np.ndarray, windows: np.ndarray):
        """Binary-search the query suffixes at ``starts`` of ``queries`` (``lengths`` symbols long).

        Word by word, the interval of suffixes that agree so far is narrowed by two binary
        searches. Returns for each query suffix the length of its longest match, one position
        where that occurs, and the interval [lo, hi) of all suffixes that begin with its first
        ``windows`` symbols (empty if none does).
        """
        count = len(starts)
        lo, hi = np.zeros(count, np.int64), np.full(count, len(self.order), np.int64)
        best, where = np.zeros(count, np.int64), np.full(count, -1, np.int64)
        at_lo, at_hi = np.zeros(count, np.int64), np.zeros(count, np.int64)
        live, depth = np.arange(count), 0
        while len(live):
            live = live[lengths[live] > depth]
            wanted = queries[starts[live] + depth]
            lo[live], hi[live] = self._bound(lo[live], hi[live], wanted, depth, False), self._bound(lo[live], hi[live], wanted, depth, True)
            live = live[lo[live] < hi[live]]
            depth += 1
            best[live], where[live] = depth, self.order[lo[live]]
            full = live[windows[live] == depth]
            at_lo[full], at_hi[full] = lo[full], hi[full]
        return best, where, at_lo, at_hi

    def _bound(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, depth: int, right: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            middle = (lo + hi) >> 1
            place = self.order[np.minimum(middle, len(self.order) - 1)] + depth
            seen = self.symbols[np.minimum(place, len(self.symbols) - 1)]
            below = open_ & ((seen <= wanted) if right else (seen < wanted))
            lo = np.where(below, middle + 1, lo)
            hi = np.where(open_ & ~below, middle, hi)


def _rests(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """All positions from any of ``starts`` up to the next 0."""
    zeros = np.flatnonzero(symbols == 0)
    stop = zeros[np.searchsorted(zeros, starts)]
    change = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, stop, -1)
    return np.flatnonzero(np.cumsum(change[:-1]) > 0)
