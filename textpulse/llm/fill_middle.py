"""Fill-in-the-middle transformation with content-defined chunks and remembered summaries.

A document is cut at token counts drawn from its identifier. To find them, a rolling hash over
the bytes chooses chunk boundaries that depend on the nearby content only, so documents that
share a passage share its chunks. A chunk's summary (tokens, code points, whether it begins and
ends inside a letter run) is worked out once per distinct content; summaries combine from left
to right into the document's count, and only the two chunks that hold a cut are read again.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.text import as_bytes, id_and_text, id_type, slices

#: A token: a run of ASCII letters, or any other code point (here its first UTF-8 byte).
TOKEN = re.compile(rb"[A-Za-z]+|[^A-Za-z\x80-\xBF]")
CONTINUATION = bytes(range(0x80, 0xC0))
LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
SENTINELS = (b"<P>", b"<S>", b"<M>")
#: Bytes under the rolling hash; boundaries fall on one position in 512, 64 to 4,096 bytes apart.
WINDOW, DIVISOR, MIN_CHUNK, MAX_CHUNK = 16, 512, 64, 4096
FACTOR = 0x9E3779B1


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the polynomial hash (mod 2^32) of the ``WINDOW`` bytes that end there.

    Hashes of 2, 4, 8, 16 bytes come from those of half the width.
    """
    h, width, factor = data.astype(np.uint32) + np.uint32(1), 1, FACTOR
    while width < WINDOW:
        h[width:] = h[width:] + h[:-width] * np.uint32(factor)
        width, factor = 2 * width, factor * factor % (1 << 32)
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text, never inside a code point.

    A boundary is taken where the hash says so, at least ``MIN_CHUNK`` bytes after the last one;
    without one for ``MAX_CHUNK`` bytes, the text is cut there.
    """
    n = len(data)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    inside = np.append((raw[1:] & 0xC0) == 0x80, False)  # the next byte continues a code point
    marked = (np.flatnonzero(((rolling_hash(raw) >> np.uint32(16)) % np.uint32(DIVISOR) == 0) & ~inside) + 1).tolist()
    ends, last, k = [], 0, 0
    while n - last > MIN_CHUNK:
        while k < len(marked) and marked[k] < last + MIN_CHUNK:
            k += 1
        end = min(marked[k] if k < len(marked) else n, last + MAX_CHUNK, n)
        while end < n and inside[end - 1]:
            end -= 1
        ends.append(end)
        last = end
    if last < n:
        ends.append(n)
    return ends


class ChunkMemory:
    """Summaries of chunks by content, within a bound of bytes.

    The dictionary compares a chunk's bytes with the stored ones before it shares a summary. Of
    two generations the older one goes when the younger is full, so what is met often stays.
    """

    def __init__(self, limit: int = 32 << 20):
        self.limit, self.held, self.young, self.old = limit, 0, {}, {}
        self.worked_out = 0

    def summary(self, chunk: bytes) -> tuple[int, int, bool, bool]:
        """(tokens, code points, begins with a letter, ends with a letter)."""
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk)
            if found is None:
                self.worked_out += 1
                found = (len(TOKEN.findall(chunk)), len(chunk.translate(None, CONTINUATION)), chunk[0] in LETTERS, chunk[-1] in LETTERS)
            if self.held > self.limit:
                self.young, self.old, self.held = {}, self.young, 0
            self.young[chunk] = found
            self.held += len(chunk) + 100
        return found


def cut_places(data: bytes, memory: ChunkMemory, draws: tuple[int, int]) -> tuple[int, list[tuple[int, int]]]:
    """Tokens of the text, and the places (byte, code point) behind its first ``draw % (tokens + 1)``
    tokens, the smaller first."""
    ends = chunk_ends(data)
    starts = [0, *ends][: len(ends)]
    firsts, chars, joined = [0], [0], []  # tokens that begin, and code points, before each chunk
    open_ = False
    for start, end in zip(starts, ends, strict=True):
        tokens, points, head, tail = memory.summary(data[start:end])
        joined.append(open_ and head)
        firsts.append(firsts[-1] + tokens - joined[-1])
        chars.append(chars[-1] + points)
        open_ = tail
    n = firsts[-1]
    places = []
    for unit in sorted(draw % (n + 1) for draw in draws):
        if unit == n:
            places.append((len(data), chars[-1]))
            continue
        k = bisect_right(firsts, unit) - 1  # the chunk in which token ``unit`` begins
        chunk = data[starts[k] : ends[k]]
        skip = unit - firsts[k] + joined[k]
        at = next(m.start() for seen, m in enumerate(TOKEN.finditer(chunk)) if seen == skip)
        places.append((starts[k] + at, chars[k] + len(chunk[:at].translate(None, CONTINUATION))))
    return n, places


@dataclass(frozen=True)
class Rates:
    """In percent: documents that are transformed, and of those the share in suffix-first order."""

    transformed: int = 90
    suffix_first: int = 20


def transform_text(data: bytes, memory: ChunkMemory, doc_id, seed: int = 1, rates: Rates = Rates()) -> tuple[int, str, int | None, int | None, bytes]:  # noqa: B008
    """(tokens, form, prefix and middle code points, output) of one text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n, ((a, a_chars), (b, b_chars)) = cut_places(data, memory, (h1, h2))
    if not data or any(s in data for s in SENTINELS) or h3 % 100 >= rates.transformed:
        return n, "plain", None, None, data
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < rates.suffix_first:
        return n, "spm", a_chars, b_chars - a_chars, b"<S>" + suffix + b"<P>" + prefix + b"<M>" + middle
    return n, "psm", a_chars, b_chars - a_chars, b"<P>" + prefix + b"<S>" + suffix + b"<M>" + middle


_MEMORY: list[ChunkMemory] = []


def _memory() -> ChunkMemory:
    """The task's memory (the worker's, kept between its tasks, where the package is installed)."""
    if not _MEMORY:
        _MEMORY.append(ChunkMemory())
    return _MEMORY[0]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rates: Rates = Rates()) -> DataFrame:  # noqa: B008
    """One row per document: its id, ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``,
    ``middle_chars`` (code points, null if plain) and the ``output`` text; map-only.

    A null text is empty; an empty text, and one that holds a sentinel, stays plain. A null
    identifier draws as an empty string; rows with equal identifiers draw alike; an empty table
    gives no rows; other columns are ignored. A task holds one slice of about 4 MB of texts (or
    one longer text) and a bounded memory of chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            memory = _memory()
            rows = [transform_text(t, memory, i, seed, rates) for i, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type(docs, id_col)}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(form: Column, output: Column) -> Column:
    """The exact text from an output and its form: texts in psm or spm form hold no sentinel, and no
    sentinel overlaps another, so the three sentinels split the output."""
    part = F.split(output, "<[PSM]>", -1)
    psm = F.concat(F.get(part, 1), F.get(part, 3), F.get(part, 2))
    spm = F.concat(F.get(part, 2), F.get(part, 3), F.get(part, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
