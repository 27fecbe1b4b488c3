"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last lines decides after which lines a chunk ends, so
boundaries depend on the lines around them and not on their position. A line is the likelier to
end a chunk the more words lie under the rolling window, so a passage of over 50 words holds a
boundary wherever its lines break (the chance that it holds none is a few percent, for passages of
many short lines). Every boundary is an anchor: the lines under the window there, with the rest
of the chunk before it and of the chunk after it. Anchors that occur more than once in the corpus
are compared with their first occurrence and grown line by line in both directions to the next
boundaries, which are anchors themselves. Runs of matched lines that share a line unite; a run of
enough words is removed everywhere but at its first occurrence. Lines are compared by digests
whose lines' bytes were compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse.llm.text import as_bytes, id_type, slices
from textpulse.session import materialize

_WORD = (1 << 64) - 1
_FACTOR = 0x9E3779B97F4A7C15  # an odd 64-bit multiplier
#: Bits of a digest that number the bit map of repeated lines (8 MB).
MAP_BITS = 26


@dataclass(frozen=True)
class Chunking:
    """window: lines in the rolling hash and in an anchor. unit: a line ends a chunk if the hash's
    high bits modulo ``unit`` are below the number of words under the window, so about one chunk
    ends in ``unit / window`` words. max_lines: the most lines of a chunk. long_words: a line of
    more words is an anchor by itself. min_words: shorter runs of repeated lines stay."""

    window: int = 2
    unit: int = 32
    max_lines: int = 64
    long_words: int = 50
    min_words: int = 25


@dataclass(frozen=True)
class Anchor:
    """Filled lines [at - size + 1, at] of a text; ``before`` are those back to the line that ended
    the chunk before, nearest first, ``after`` those up to the end of the next chunk, without it."""

    at: int
    size: int
    before: range
    after: range


class Lines:
    """The filled lines of one text, with their digests and the boundaries of its chunks.

    Empty lines belong to the filled line they follow, those at the start to the first one; they
    take no part in the hash.
    """

    def __init__(self, lines: list[bytes], how: Chunking):
        self.how = how
        self.filled = [k for k, line in enumerate(lines) if line.strip()]
        self.starts = [0, *self.filled[1:], len(lines)] if self.filled else [0]
        self.words = [len(lines[k].split()) for k in self.filled]
        self.digests = [_digest(lines[k]) for k in self.filled]
        self.cuts = self._cuts()

    def _cuts(self) -> list[int]:
        """The filled lines that end a chunk by the rolling hash (the last line ends one anyway)."""
        how, cuts, rolling, under, since = self.how, [], 0, 0, 0
        drop = pow(_FACTOR, how.window, 1 << 64)
        values = [int.from_bytes(d[:8]) for d in self.digests]
        for n, value in enumerate(values):
            rolling = (rolling * _FACTOR + value) & _WORD
            under += self.words[n]
            if n >= how.window:
                rolling = (rolling - values[n - how.window] * drop) & _WORD
                under -= self.words[n - how.window]
            since += 1
            if n + 1 >= how.window and ((rolling >> 32) % how.unit < under or since >= how.max_lines):
                cuts.append(n)
                since = 0
        return cuts

    def chunks(self) -> list[tuple[int, int]]:
        """[from, to) of the chunks, as filled lines."""
        ends = [n + 1 for n in self.cuts]
        if self.filled and (not ends or ends[-1] < len(self.filled)):
            ends.append(len(self.filled))
        return list(zip([0, *ends], ends, strict=False))

    def anchors(self) -> list[Anchor]:
        how, out = self.how, []
        for before, n, after in zip([0, *self.cuts], self.cuts, [*self.cuts[1:], len(self.filled)], strict=False):
            out.append(Anchor(n, how.window, range(n - how.window, before - 1, -1), range(n + 1, after)))
        return out + [Anchor(n, 1, range(0), range(0)) for n, words in enumerate(self.words) if words > how.long_words]

    def runs(self, matched: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Matched ranges of filled lines, those that share a line united, of enough words."""
        out: list[tuple[int, int]] = []
        for a, b in sorted(matched):
            if out and a < out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return [(a, b) for a, b in out if sum(self.words[a:b]) >= self.how.min_words]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Identifier, text and a key of the text; rows with equal identifier and text are one document."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def _digest(line: bytes) -> bytes:
    return hashlib.sha256(line).digest()[:16]


def clashing_digests(docs: DataFrame, text_col: str = "text", repeated: np.ndarray | None = None) -> list[bytes]:
    """Line digests that lines of different bytes share; no such pair of lines is known.

    Lines are shuffled compressed (losslessly; the digest is the key, so another build's
    compression could at most leave a line where it is). ``repeated``: a bit map by the first bits
    of the digests; only lines whose bit is set are compared. Partial aggregation keeps one row
    per line and task, whatever its share of the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeated) if repeated is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            lines = list({line for text in as_bytes(batch.column(0)) for line in text.split(b"\n") if line.strip()})
            digests = list(map(_digest, lines))
            if shared is not None and lines:
                bits = np.array([int.from_bytes(d[:4]) for d in digests], np.int64) >> (32 - MAP_BITS)
                at = np.flatnonzero(shared.value[bits >> 6] >> (bits & 63) & 1).tolist()
                lines, digests = [lines[k] for k in at], [digests[k] for k in at]
            bodies = [zlib.compress(line, 6, wbits=-12) for line in lines]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(bodies, pa.binary())], ["digest", "body"])

    lines = docs.select(F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "digest binary, body binary").distinct()
    return [bytes(r.digest) for r in lines.groupBy("digest").count().where("count > 1").select("digest").collect()]


def anchor_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking(), apart: frozenset[bytes] = frozenset()) -> DataFrame:  # noqa: B008
    """(id, key, at, digest, before, after) of every anchor.

    ``digest`` holds the digests of its lines one after the other, ``before`` and ``after`` those
    of the lines around it, nearest first. Lines whose digest is in ``apart`` match nothing.
    """
    kind = id_type(docs, id_col)
    names = ["id", "key", "at", "digest", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            row, at, digest, before, after = [], [], [], [], []
            for r, text in enumerate(as_bytes(batch.column(2))):
                lines = Lines(text.split(b"\n"), how)
                known = lines.digests
                for anchor in lines.anchors():
                    own = known[anchor.at - anchor.size + 1 : anchor.at + 1]
                    if apart and not apart.isdisjoint(own):
                        continue
                    row.append(r)
                    at.append(anchor.at)
                    digest.append(b"".join(own))
                    for column, around in ((before, anchor.before), (after, anchor.after)):
                        column.append(list(takewhile(lambda d: d not in apart, (known[n] for n in around))))
            rows = pa.array(row, pa.int64())
            digests = [pa.array(digest, pa.binary()), *(pa.array(c, pa.list_(pa.binary())) for c in (before, after))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), *digests], names)

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {kind}, key long, at int, digest binary, before array<binary>, after array<binary>")


def repeated_anchors(anchors: DataFrame) -> DataFrame:
    """(digest, n, first) of the anchors that occur more than once.

    ``first`` is the occurrence that stays: the smallest (id, key, at), null ids last, with the
    lines around it. Partial aggregation keeps one row per anchor and task, whatever its share of
    the corpus.
    """
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "at", "before", "after")
    return anchors.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")


def _repeated_bits(again: DataFrame) -> np.ndarray:
    """The bit map of all lines in repeated anchors and around their first occurrences.

    At most 2 ** (MAP_BITS - 6) words reach the driver; with very many lines all bits are set and
    all lines are compared.
    """
    own = F.transform(F.sequence(F.lit(0), (F.length("digest") / 16).cast("int") - 1), lambda i: F.expr("digest").substr(i * 16 + 1, F.lit(4)))
    lines = again.select(F.explode(F.concat(own, "first.before", "first.after")).alias("line"))
    bit = F.shiftright(F.conv(F.hex(F.substring("line", 1, 4)), 16, 10).cast("long"), 32 - MAP_BITS).alias("bit")
    words = lines.select(bit).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    found = words.toPandas()
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out


def _alike(here: str, there: str):
    """How many digests at the start of two lists are equal."""
    same = F.zip_with(here, there, lambda x, y: F.coalesce(x == y, F.lit(False)))
    other = F.array_position(same, F.lit(False)).cast("int")
    return F.when(other == 0, F.size(same)).otherwise(other - 1)


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking()) -> DataFrame:  # noqa: B008
    """(id, key, matched): for each document the ranges [a, b) of filled lines that match an
    earlier occurrence, an anchor grown as far as the lines around it are alike."""
    apart: frozenset[bytes] = frozenset()
    while True:
        anchors = anchor_table(docs, id_col, text_col, how, apart)
        # written once, so that the join reads plain shuffles and an anchor with very many places is split
        again = materialize(repeated_anchors(anchors))
        clashes = frozenset(clashing_digests(docs, text_col, _repeated_bits(again))) - apart
        if not clashes:
            break
        apart |= clashes  # lines of other bytes under one digest: cut again without them
    here = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "at")
    first = F.struct("first.no_id", "first.id", "first.key", "first.at")
    places = anchors.join(again, "digest").where(~here.eqNullSafe(first))
    size = (F.length("digest") / 16).cast("int")
    grown = F.struct((F.col("at") - size + 1 - _alike("before", "first.before")).alias("a"), (F.col("at") + 1 + _alike("after", "first.after")).alias("b"))
    return places.groupBy("id", "key").agg(F.collect_set(grown).alias("matched"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Chunking = Chunking(), keep_emptied: bool = True) -> DataFrame:  # noqa: B008
    """``docs`` as one struct column ``row``, with each document's ``text`` after removal and counts.

    Columns: ``row`` (the input row), ``text``, ``n_lines``, ``n_chunks``, ``n_removed_chunks``
    (those that went whole), ``n_removed_lines``. Every line stays at its first place in the
    corpus, in the order of ``repeated_anchors``. Null and empty texts have no lines and stay as
    they are (null stays null in ``text``); rows with equal identifier and text are one document
    and get the same text; an empty table gives no rows. ``keep_emptied=False`` drops documents
    that had filled lines and lost them all.
    """
    gone = removals(docs, id_col, text_col, how)
    body = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(body).alias("key"))
    joined = whole.join(gone, whole["id"].eqNullSafe(gone["id"]) & (whole["key"] == gone["key"]), "left").select("row", "matched")
    place = docs.columns.index(text_col)

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the text is taken from the row here, so that it is passed once
            text = batch.column(0).field(place)
            if not pa.types.is_string(text.type) and not pa.types.is_large_string(text.type):
                text = text.cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, batch.column(1)], ["row", "text", "matched"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(with_text(batches), 1):
            keep, texts, counts = [], [], [[], [], [], []]
            for text, known, matched in zip(as_bytes(batch.column(1)), batch.column(1).is_valid().to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n") if text else []
                found = Lines(lines, how)
                runs = found.runs([(m["a"], m["b"]) for m in matched]) if matched else []
                cut = {k for a, b in runs for k in range(found.starts[a], found.starts[b])}
                left = [line for k, line in enumerate(lines) if k not in cut]
                filled = any(line.strip() for line in left)
                keep.append(keep_emptied or not cut or filled)
                texts.append((b"\n".join(left) if cut else text) if known else None)
                chunks, covered = found.chunks(), {n for a, b in runs for n in range(a, b)}
                removed = sum(covered.issuperset(range(c, d)) for c, d in chunks) if runs else 0
                for column, value in zip(counts, (len(lines), len(chunks), removed, len(cut)), strict=True):
                    column.append(value)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(batch.schema.field(1).type), *(pa.array(c, pa.int64()) for c in counts)], names)
            yield out.filter(pa.array(keep))

    names = ["row", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines"]
    schema = joined.select("row", F.lit(None).cast("string").alias("text"), *(F.lit(0).cast("long").alias(n) for n in names[2:])).schema
    return joined.mapInArrow(run, schema)
