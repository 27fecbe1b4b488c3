"""Periodic runs of words by descending-LCP Kruskal.

Suffixes of a text that begin alike form classes: at level ``l`` two suffixes are in one class if
they share their first ``l`` words. Going down the levels, neighbours in the suffix array are
united (union-find, the smaller class into the larger), and every class keeps its positions in
order. When positions ``p < q`` become neighbours in a class at level ``l`` and ``q - p <= l``, the
words from ``p`` to ``q + l`` repeat with period ``q - p``, and no smaller one (its next copy would
lie between them). The first such pair of a run starts at its first word, so a pair whose
preceding words are equal belongs to a run that another pair seeds.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.suffix import word_groups
from textpulse.llm.text import as_bytes, id_and_text, id_type, slices

#: Shortest run, in words; a run also has at least two periods.
MIN_LENGTH = 12
RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Positions:
    """An ordered set of positions: sorted blocks, split beyond ``BLOCK`` entries."""

    BLOCK = 1024
    __slots__ = ("blocks", "firsts", "count")

    def __init__(self, first: int):
        self.blocks, self.firsts, self.count = [[first]], [first], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def _block(self, position: int) -> int:
        return 0 if len(self.blocks) == 1 else max(bisect_left(self.firsts, position + 1) - 1, 0)

    def add(self, position: int) -> None:
        k = self._block(position)
        block = self.blocks[k]
        insort(block, position)
        self.firsts[k] = block[0]
        self.count += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[k : k + 1] = [block[:half], block[half:]]
            self.firsts[k : k + 1] = [block[0], block[half]]

    def neighbours(self, position: int) -> tuple[int, int]:
        """The positions before and after one that is in the set; -1 if there is none."""
        k = self._block(position)
        block = self.blocks[k]
        at = bisect_left(block, position)
        before = block[at - 1] if at else self.blocks[k - 1][-1] if k else -1
        after = block[at + 1] if at + 1 < len(block) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        return before, after


def sorted_repeats(symbols: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes whose first ``width`` symbols occur more than once, in order, and the length of
    the prefix that each shares with the one before it (at least ``width``, else 0).

    Prefix doubling over the suffixes that are still tied; then the shared lengths in text order
    (a suffix shares at most one symbol less with its predecessor than the suffix before it in
    the text). Symbol 0 ends a text; texts must not share symbols. Memory is linear.
    """
    head, count = word_groups(symbols, width)
    kept = np.flatnonzero(count > 1)
    if not len(kept):
        return kept, kept
    n, rank, live, size = len(symbols), head.copy(), kept, width
    while len(live):
        follow = rank[np.minimum(live + size, n - 1)]
        order = np.lexsort((follow, rank[live]))
        live, follow = live[order], follow[order]
        old, at = rank[live], np.arange(len(live))
        new_group = np.concatenate(([True], old[1:] != old[:-1]))
        new_rank = new_group | np.concatenate(([True], follow[1:] != follow[:-1]))
        starts = np.maximum.accumulate(np.where(new_rank, at, 0))
        fresh = old + starts - np.maximum.accumulate(np.where(new_group, at, 0))
        rank[live] = fresh
        members = np.bincount(starts, minlength=len(live))
        live, size = live[members[starts] > 1], size * 2
    order = kept[np.argsort(rank[kept], kind="stable")]
    tied = np.concatenate(([False], head[order[1:]] == head[order[:-1]]))
    before = np.full(n, -1, np.int64)
    before[order[tied]] = order[:-1][tied[1:]]
    shared = np.zeros(n, np.int64)
    words, previous = memoryview(np.ascontiguousarray(symbols)), memoryview(before)
    length, last = 0, -2
    for i in np.sort(order[tied]).tolist():
        j = previous[i]
        length = max(length - (i - last), width)
        last = i
        while words[i + length] and words[i + length] == words[j + length]:
            length += 1
        shared[i] = length
    return order, shared[order]


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``min_length`` symbols and two periods.

    ``symbols``: texts one after the other, each ended by a 0, without common symbols.
    """
    width = (min_length + 1) // 2  # positions a period apart share at least half of the run
    order, shared = sorted_repeats(symbols, width)
    places = order.tolist()
    edges = np.flatnonzero(shared >= width)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    levels = shared[edges].tolist()
    parent = list(range(len(places)))
    sets: dict[int, Positions] = {}
    words, runs = memoryview(np.ascontiguousarray(symbols)), []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    for edge, level in zip(edges.tolist(), levels, strict=True):
        a, b = root(edge - 1), root(edge)
        large, small = sets.pop(a, None) or Positions(places[a]), sets.pop(b, None) or Positions(places[b])
        if large.count < small.count:
            a, b, large, small = b, a, small, large
        parent[b] = a
        sets[a] = large
        moved = set(small)
        for p in moved:
            large.add(p)
        for p in moved:
            before, after = large.neighbours(p)
            for x, y in ((before, p), (p, after)):
                if x < 0 or y < 0 or y - x > level or (x in moved) == (y in moved):
                    continue
                if level + y - x >= min_length and not (x and words[x - 1] and words[x - 1] == words[y - 1]):
                    runs.append((x, level + y - x, y - x))
    return sorted((s, n, p) for s, n, p in runs)


def text_runs(texts: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """(words, runs by start and period, collapsed text) of each text.

    The collapsed text holds, one space apart, the words that lie in no run or in the first
    period of every run that holds them.
    """
    symbols: list[int] = []
    words, starts, base = [], [], 1
    for text in texts:
        parts = text.split()
        seen: dict[bytes, int] = {}
        starts.append(len(symbols))
        symbols += [seen.setdefault(w, base + len(seen)) for w in parts]
        symbols.append(0)
        base += len(seen)
        words.append(parts)
    found = find_runs(np.array(symbols, np.int64), min_length)
    owner = np.searchsorted(starts, [s for s, _, _ in found], side="right") - 1 if found else []
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (start, length, period) in zip(owner, found, strict=True):
        runs[k].append((start - starts[k], length, period))
    out = []
    for parts, of_text in zip(words, runs, strict=True):
        kept = parts
        if of_text:
            change = np.zeros(len(parts) + 1, np.int64)
            for start, length, period in of_text:
                change[start + period] += 1
                change[start + length] -= 1
            kept = [parts[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        out.append((len(parts), of_text, b" ".join(kept)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per document: its id, ``n_words``, ``runs`` (by start, then period) and the
    ``collapsed`` text; map-only.

    A run is a stretch of words with smallest period p, of at least ``min_length`` words and two
    periods, that neither neighbouring word continues. A null or empty text has no words, no runs
    and an empty collapsed text; null identifiers and repeated rows are kept as they are; an
    empty table gives no rows; other columns are ignored. A task holds one slice of about 4 MB of
    texts (or one longer text); its memory is linear in the slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in slices(batches, 1):
            n, runs, collapsed = zip(*text_runs(as_bytes(batch.column(1)), min_length), strict=True)
            listed = [[{"start": s, "length": length, "period": p} for s, length, p in of_text] for of_text in runs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(listed, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], [id_col, "n_words", "runs", "collapsed"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, n_words long, runs {RUN}, collapsed string")


def longest_run(runs: Column) -> Column:
    """The run of greatest length; of several the one with the smallest start, then period."""
    better = lambda x, y: (y["length"] > x["length"])
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(better(best, r), r).otherwise(best)))
