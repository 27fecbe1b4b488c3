"""Benchmark decontamination by suffix arrays over the training documents.

Every slice of training documents (a shard) is a suffix array of words; the suffixes of the test
items are searched in it by binary search, which gives their longest verbatim match, one place
of it, and the interval of all places where their first ``window`` words occur. A suffix whose
first few words lie nowhere in the shard cannot match there: only those whose words do are
searched, found by looking the shard's words up in the items' sorted codes, so a shard's cost
follows its own size and its matches, not the benchmark's size. For the same reason the array
leaves out suffixes of the shard that no test suffix can begin with.

The test items are broadcast in blocks of a checked size; more than one block means one pass per
block with the found spans carried along, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.suffix import SuffixArray
from textpulse.llm.text import as_bytes, id_and_text, id_type, slices
from textpulse.session import materialize

_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # an odd 64-bit multiplier
WINDOW = 13
#: Share of a document's words, in parts of 1/20, from which it counts as contaminated.
SHARE = 20
#: Bytes of test items broadcast at a time. What is sent is their distinct words and four bytes a
#: word; the arrays derived from it are made in each worker.
BLOCK_BYTES = 16 << 20
#: Words of a test suffix that must lie in a shard for the suffix to be searched there.
PREFIX = 6
#: Words are runs of ASCII digits and letters (lower-cased) and of all non-ASCII characters.
_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Codes:
    """Test suffixes by a code of their first ``width`` words, in the codes' order."""

    def __init__(self, width: int, codes: np.ndarray, suffixes: np.ndarray):
        order = np.argsort(codes, kind="stable")
        self.width, self.suffixes = width, suffixes[order]
        self.codes, self.first, self.count = np.unique(codes[order], return_index=True, return_counts=True)

    def places(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``codes`` some test suffix has, and the test suffixes that have one of them."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[at] == codes
        hit = np.unique(at[known])
        count = self.count[hit]
        inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return known, self.suffixes[np.repeat(self.first[hit], count) + inside]


def _codes(symbols: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = out * _FACTOR + symbols[at + k].astype(np.uint64)
    return out


class ItemBlock:
    """The words of some test items as numbers, and their suffixes that begin with a whole window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        self.window, self.derived = window, False
        numbers, sizes = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                numbers.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0], np.int32))
                sizes.append(len(words))
                self.ids.append(item)
        self.symbols = np.concatenate(numbers) if numbers else np.zeros(1, np.int32)
        self.sizes = np.array(sizes, np.int64)

    def derive(self) -> ItemBlock:
        """Add the arrays of the suffixes: once in each worker, so that they are not broadcast."""
        if not self.derived:
            width = np.minimum(self.sizes, self.window)
            count = self.sizes - width + 1
            self.owners = np.repeat(np.arange(len(self.sizes)), count)
            self.positions = np.arange(len(self.owners)) - np.repeat(np.cumsum(count) - count, count)
            self.starts = (np.cumsum(self.sizes + 1) - self.sizes - 1)[self.owners] + self.positions
            self.lengths, self.windows = self.sizes[self.owners] - self.positions, width[self.owners]
            self.longest = int(self.lengths.max(initial=1))
            prefix = np.minimum(self.windows, PREFIX)
            which = [(int(w), np.flatnonzero(prefix == w)) for w in np.unique(prefix)]
            self.codes = [Codes(w, _codes(self.symbols, self.starts[at], w), at) for w, at in which]
            self.derived = True
        return self


class Shard:
    """The suffix array of a slice of documents, searched with a block of test items.

    ``whole``: follow every match to its end; otherwise only to the end of the window.
    """

    def __init__(self, texts: list[bytes], block: ItemBlock, whole: bool = False):
        block.derive()
        get = block.vocabulary.get
        symbols, self.n_words = [], []
        for text in texts:
            words = words_of(text)
            self.n_words.append(len(words))
            symbols += [get(w, 0) for w in words]
            symbols.append(0)
        self.block, self.symbols = block, np.array(symbols, np.int64)
        n = len(self.symbols)
        sizes = np.array(self.n_words, np.int64) + 1
        self.begin = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        cuts = np.flatnonzero(self.symbols == 0)
        run = cuts[np.searchsorted(cuts, np.arange(n))] - np.arange(n)  # words up to the next cut
        kept, searched = np.zeros(n, bool), [np.zeros(0, np.int64)]
        for codes in block.codes:
            at = np.flatnonzero(run >= codes.width)
            known, suffixes = codes.places(_codes(self.symbols, at, codes.width))
            kept[at[known]] = True
            searched.append(suffixes)
        self.searched = np.concatenate(searched)
        lengths = (block.lengths if whole else block.windows)[self.searched]
        self.array = SuffixArray(self.symbols, int(lengths.max(initial=1)), kept)
        self.found = self.array.search(block.symbols, block.starts[self.searched], lengths, block.windows[self.searched])

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[set[str]]]:
        """Per document the spans [from, to) of words inside matched windows, and the items."""
        _, _, lo, hi = self.found
        order, block = self.array.order, self.block
        at = np.flatnonzero(hi > lo)
        change = np.zeros(len(self.symbols) + 1, np.int64)
        items: list[set[str]] = [set() for _ in self.n_words]
        by_interval: dict[tuple[int, int, int], set[str]] = {}
        for k in at:
            suffix = self.searched[k]
            by_interval.setdefault((int(lo[k]), int(hi[k]), int(block.windows[suffix])), set()).add(block.ids[block.owners[suffix]])
        for (a, b, width), names in by_interval.items():
            places = order[a:b]
            np.add.at(change, places, 1)
            np.add.at(change, places + width, -1)
            for doc in np.unique(self.owner[places]).tolist():
                items[doc] |= names
        inside = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        spans: list[list[tuple[int, int]]] = [[] for _ in self.n_words]
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            doc = int(self.owner[a])
            spans[doc].append((a - int(self.begin[doc]), b - int(self.begin[doc])))
        return spans, items

    def longest(self) -> Iterator[tuple[str, int, int, int, int]]:
        """(item, word position in it, document index, word position there, words) of the longest
        match of every test suffix that matches here for its whole window."""
        length, where, lo, hi = self.found
        block = self.block
        for k in np.flatnonzero(hi > lo).tolist():
            doc, suffix = int(self.owner[where[k]]), self.searched[k]
            yield block.ids[block.owners[suffix]], int(block.positions[suffix]), doc, int(where[k] - self.begin[doc]), int(length[k])


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[bool, ItemBlock]]:
    """Test items in blocks of about ``block_bytes``, one at a time: (last one, block)."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):  # the driver holds one block; their number follows the benchmark's size
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield k + 1 == blocks, ItemBlock([(r.item if r.item is not None else "", r.text.encode()) for r in part.collect()], window)


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = "struct<n_words:long,spans:array<struct<a:long,b:long>>,items:array<string>>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` as one struct column ``row`` and the finding of each document as ``found``.

    ``found``: ``n_words``, ``spans`` (word ranges inside occurrences of windows) and ``items``
    (sorted ids of the test items that occur). An item of fewer words than the window is one
    window; null texts have no words; an empty benchmark finds nothing; repeated rows are
    judged alike; an item that occurs twice counts once; a null item id is the empty text. Map-only for one block of test items.
    """
    spark = docs.sparkSession
    state = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"), F.lit(None).cast(_FOUND).alias("found"))
    for last, block in item_blocks(benchmark, item_col, item_text_col, window, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                shard = Shard(as_bytes(batch.column(1)), shared.value)
                found = []
                for n, spans, items, old in zip(shard.n_words, *shard.hits(), batch.column(2).to_pylist(), strict=True):
                    if old:
                        spans = _united(spans + [(s["a"], s["b"]) for s in old["spans"]])
                        items = items | set(old["items"])
                    found.append({"n_words": n, "spans": [{"a": a, "b": b} for a, b in spans], "items": sorted(items)})
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, batch.schema.field(2).type)], batch.schema.names)

        state = state.mapInArrow(run, state.schema)
        if not last:
            state = materialize(state)
            shared.unpersist()
    return state.select("row", "found")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The longest verbatim match of every test suffix over all shards, where it is at least its
    window: item, item_pos, n_words (of the match) and one place (document, word position)."""
    spark = docs.sparkSession
    parts = []
    for _, block in item_blocks(benchmark, item_col, item_text_col, window):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                rows = list(Shard(as_bytes(batch.column(1)), shared.value, whole=True).longest())
                item, pos, doc, at, n = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(pos, pa.int64()), batch.column(0).take(pa.array(doc, pa.int64())), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["item", "item_pos", id_col, "word_pos", "n_words"])

        schema = f"item string, item_pos long, `{id_col}` {id_type(docs, id_col)}, word_pos long, n_words long"
        parts.append(id_and_text(docs, id_col, text_col).mapInArrow(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max_by(F.struct(f"`{id_col}`", "word_pos"), F.struct("n_words", -F.col("word_pos"), f"`{id_col}`"))
    return out.groupBy("item", "item_pos").agg(F.max("n_words").alias("n_words"), best.alias("place"))


def n_hit(found: str = "found"):
    """Words of a document inside matched windows."""
    return F.aggregate(F.col(f"{found}.spans"), F.lit(0).cast("long"), lambda total, s: total + s["b"] - s["a"])


def contaminated(found: str = "found"):
    """A document is contaminated if some word is hit and hits are at least 1/20 of its words."""
    return (n_hit(found) > 0) & (n_hit(found) * SHARE >= F.col(f"{found}.n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all their columns) that are not contaminated."""
    clean = find_contamination(docs, benchmark, **options).where(~contaminated())
    return clean.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
