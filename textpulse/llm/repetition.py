"""Quality rules by suffix-array repetition: how much of a text repeats itself, and how long.

The words of each text are sorted as a suffix array; its longest-common-prefix intervals give
the maximal repeated substrings. The spans of those of at least ``MIN_REPEAT`` words (every
occurrence, the first included) are united (a line that opens and closes a short text is shorter
than that, and no reason to reject it); a text is rejected if they cover too large a
fraction of it or if one repeat is too long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textpulse.llm.suffix import repeat_lengths, word_groups
from textpulse.llm.text import as_bytes, id_and_text, id_type, slices

#: Bytes that separate words: space and the ASCII controls 9 to 13 (what bytes.split() splits on).
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """min_words, max_repeated_percent: base rules. min_repeat: shortest repeat (words) whose spans
    count as covered. max_covered_percent: largest share of words covered. max_repeat_words:
    longest repeat allowed, in words, whatever the text's length; max_repeat_percent: if set, it must
    also pass this share of the text to reject."""

    min_words: int = 50
    max_repeated_percent: int = 50
    min_repeat: int = 20
    max_covered_percent: int = 30
    max_repeat_words: int = 100
    max_repeat_percent: int = 0


def measure(texts: list[bytes], min_repeat: int) -> dict[str, np.ndarray]:
    """The counts of each text: words, word characters, symbols, repeated lines, words in
    repeated 3-word windows, words covered by long repeats, and the longest repeat."""
    symbols: list[int] = []
    n_words, chars, marks, lines = [], [], [], []
    base = 1
    for text in texts:
        words = text.split()
        seen: dict[bytes, int] = {}
        symbols += [seen.setdefault(w, base + len(seen)) for w in words]
        symbols.append(0)
        base += len(seen)
        n_words.append(len(words))
        chars.append(len(text.translate(None, SPACES).decode("utf-8", "replace")))
        marks.append(len(text) - len(text.translate(None, SYMBOLS)))
        filled = [line for line in text.split(b"\n") if line.strip()]
        lines.append(len(filled) - len(set(filled)))
    array = np.array(symbols, np.int64)
    n_words = np.array(n_words, np.int64)
    starts = np.cumsum(n_words + 1) - n_words - 1
    owner = np.repeat(np.arange(len(texts)), n_words + 1)
    head, count = word_groups(array)

    def covered(at: np.ndarray, length: np.ndarray) -> np.ndarray:
        change = np.zeros(len(array) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        return np.bincount(owner[np.cumsum(change[:-1]) > 0], minlength=len(texts))

    repeated = np.flatnonzero(count > 1)
    order, longest = repeat_lengths(array, head, count)
    keep = longest >= min_repeat
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, owner[order], longest)
    return {
        "start": starts, "n_words": n_words, "word_chars": np.array(chars), "n_symbols": np.array(marks), "n_dup_lines": np.array(lines),
        "n_repeat_words": covered(repeated, np.full(len(repeated), 3)), "n_covered": covered(order[keep], longest[keep]), "longest_repeat": most,
    }


def verdicts(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of each measured text."""
    words = m["n_words"]
    failed = (words < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeated_percent * words)
    covered = 100 * m["n_covered"] > limits.max_covered_percent * words
    long = (m["longest_repeat"] > limits.max_repeat_words) & (100 * m["longest_repeat"] > limits.max_repeat_percent * words)
    return failed, ~(failed | covered | long)


FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def repetition_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """One row per document with its counts, ``base_failed`` and ``kept``; map-only.

    A null or empty text has no words (and fails on length); repeated rows and null identifiers
    are kept as they are; other columns are ignored. Each task holds one slice of about 4 MB of
    texts (or one longer text) and its suffix array.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            m = measure(as_bytes(batch.column(1)), limits.min_repeat)
            failed, kept = verdicts(m, limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[f], pa.int64()) for f in FIELDS), pa.array(failed), pa.array(kept)], [id_col, *FIELDS, "base_failed", "kept"])

    schema = f"`{id_col}` {id_type(docs, id_col)}, " + ", ".join(f"{f} long" for f in FIELDS) + ", base_failed boolean, kept boolean"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def keep_good(docs: DataFrame, text_col: str = "text", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` (all their columns) whose text passes; map-only."""
    index = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, index):
            yield batch.filter(pa.array(verdicts(measure(as_bytes(batch.column(index)), limits.min_repeat), limits)[1]))

    return docs.mapInArrow(run, docs.schema)
