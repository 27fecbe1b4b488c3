"""Segmentation of unspaced text with a dictionary: the likeliest words, or the longest.

A dictionary within a size bound is broadcast; every worker builds one automaton from it, which
finds all dictionary words in a run of text in one pass. A run is then segmented in one walk, so
time is linear in its length. A dictionary beyond the bound is joined to the substrings of
the distinct runs instead; the walk is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest dictionary (words, UTF-8 bytes) that is broadcast.
MAX_WORDS, MAX_BYTES = 500_000, 16 << 20
#: Costs are -1000 times the natural logarithm of a word's share, rounded: whole numbers add up
#: alike in any order. A character that no word covers counts as half an occurrence.
SCALE = 1000
#: UTF-8 bytes of texts that a worker segments, and hands back, at a time.
PIECE_BYTES = 1 << 18

Matches = Iterable[tuple[int, int, int]]  # (end, length, cost), by end


def word_costs(counts: DataFrame, total: int | None = None) -> tuple[DataFrame, int]:
    """((word, cost), cost of an unknown character) from (word, n): counts of the words of a table.

    Equal words are added up; empty and null words, and words without occurrences, are left out.
    """
    words = counts.where("word is not null and word <> '' and n > 0").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))
    total = total or words.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]
    costs = words.select("word", F.round(F.log(F.lit(float(total)) / F.col("n")) * SCALE).cast("bigint").alias("cost"))
    unknown = counts.sparkSession.range(1).select(F.round(F.log(F.lit(2.0 * total)) * SCALE).cast("bigint")).first()[0]
    return costs, unknown


def likeliest(run: str, matches: Matches, unknown: int) -> list[str]:
    """The words of least total cost that make up the run (Viterbi); of equal ones the longest
    last word, at every place."""
    best, length = [0], [0]
    found = iter(matches)
    match = next(found, None)
    for end in range(1, len(run) + 1):
        cost, size = best[end - 1] + unknown, 1
        while match is not None and match[0] == end:
            _, n, c = match
            through = best[end - n] + c
            if through < cost or (through == cost and n > size):
                cost, size = through, n
            match = next(found, None)
        best.append(cost)
        length.append(size)
    out, end = [], len(run)
    while end:
        out.append(run[end - length[end] : end])
        end -= length[end]
    return out[::-1]


def longest(run: str, matches: Matches, unknown: int) -> list[str]:
    """From the left, the longest word that begins at each place, else one character."""
    at = [1] * len(run)
    for end, n, _ in matches:
        at[end - n] = max(at[end - n], n)
    out, start = [], 0
    while start < len(run):
        out.append(run[start : start + at[start]])
        start += at[start]
    return out


CHOICES: dict[str, Callable[[str, Matches, int], list[str]]] = {"likeliest": likeliest, "longest": longest}


class Automaton:
    """All dictionary words in a text, by their ends."""

    def __init__(self, entries: list[tuple[str, int]]):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for word, cost in entries:
            self.found.add_word(word, (len(word), cost))
        self.found.make_automaton()
        self.empty = not entries

    def matches(self, text: str) -> Matches:
        return () if self.empty else ((end + 1, n, cost) for end, (n, cost) in self.found.iter(text))


def _terms(texts: pa.ListArray, cut: Callable[[str], list[str]]) -> pa.ListArray:
    """The terms of every text; each distinct run is cut once, and only if it is ``segmented``."""
    flat = texts.flatten()
    runs = flat.field(0).dictionary_encode(null_encoding="encode")
    kinds = 2 * runs.indices.to_numpy().astype(np.int64) + pc.fill_null(flat.field(1), False).to_numpy(zero_copy_only=False)
    distinct, kind = np.unique(kinds, return_inverse=True)
    names = runs.dictionary.take(pa.array(distinct // 2)).to_pylist()
    known = [cut(run) if segmented else [run] for run, segmented in zip(names, (distinct % 2).tolist(), strict=True)]
    words = pa.array([t for terms in known for t in terms], pa.string())
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    each = sizes[kind]  # the number of terms of every run, and the place of its first one in the output
    ends = np.cumsum(each)
    at = np.repeat((np.cumsum(sizes) - sizes)[kind] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)
    of_text = np.concatenate(([0], np.cumsum(pc.fill_null(texts.value_lengths(), 0).to_numpy())))
    offsets = np.concatenate(([0], ends))[of_text].astype(np.int32)
    mask = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(at)), mask=mask)


def _pieces(texts: pa.ListArray, cut: Callable[[str], list[str]]) -> Iterator[tuple[int, pa.ListArray]]:
    """(first text, the terms of every text) for a bounded number of bytes at a time (one text at
    least): the texts stay in Arrow's buffers, and Python holds the distinct runs of a piece alone."""
    before = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts.flatten().field(0)), 0).to_numpy())))
    ends = before[np.cumsum(pc.fill_null(texts.value_lengths(), 0).to_numpy())]
    start = 0
    while start < len(texts):
        most = (ends[start - 1] if start else 0) + PIECE_BYTES
        end = max(start + 1, int(np.searchsorted(ends, most, side="right")))
        yield start, _terms(texts.slice(start, end - start), cut)
        start = end


def _all_terms(texts: pa.ListArray, cut: Callable[[str], list[str]]) -> pa.ListArray:
    """The terms of every text, at once."""
    return pa.concat_arrays([pa.array([], pa.list_(pa.string())), *(terms for _, terms in _pieces(texts, cut))])


def _replaced(batches: Iterable[pa.RecordBatch], cut: Callable[[str], list[str]]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches with the terms in place of the last column, a piece at a time."""
    for batch in batches:
        for start, terms in _pieces(batch.column(batch.num_columns - 1), cut):
            kept = batch.slice(start, len(terms)).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, terms], names=batch.schema.names)
            del terms
        del batch
        pa.default_memory_pool().release_unused()


def segment_runs(texts: DataFrame, costs: DataFrame, unknown: int = 0, choice: str = "longest") -> DataFrame | None:
    """The rows with, in place of the last column, an array of (run, segmented) structs, the terms
    of each run, one after the other; runs that are not ``segmented`` stay whole. None if the
    dictionary is too large to broadcast."""
    n, size = costs.limit(MAX_WORDS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word")), F.lit(0))).first()
    if n > MAX_WORDS or size > MAX_BYTES:
        return None
    held = costs.sparkSession.sparkContext.broadcast({"entries": [tuple(r) for r in costs.collect()]})
    pick = CHOICES[choice]

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value  # one per worker, so its automaton is built once
        if "automaton" not in known:
            known["automaton"] = Automaton(known["entries"])
        matches = known["automaton"].matches
        return _replaced(batches, lambda run: pick(run, matches(run), unknown))

    *kept, last = texts.schema.fields
    return texts.mapInArrow(segment, T.StructType([*kept, T.StructField(last.name, T.ArrayType(T.StringType()))]))


def segment_by_join(runs: DataFrame, costs: DataFrame, unknown: int = 0, choice: str = "longest") -> DataFrame:
    """(run, terms) for the distinct ``run`` strings, for a dictionary of any size: every substring up
    to the longest word is joined to the dictionary."""
    distinct = runs.select("run").where("run is not null").distinct()
    most = costs.agg(F.coalesce(F.max(F.length("word")), F.lit(1))).first()[0]
    ends = distinct.select("run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("end"))
    parts = ends.select("run", "end", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.col("end")))).alias("n"))
    found = parts.withColumn("word", F.substring("run", F.col("end") - F.col("n") + 1, F.col("n"))).join(costs, "word")
    listed = found.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("end", "n", "cost"))).alias("matches"))
    pick = CHOICES[choice]

    @F.pandas_udf("array<string>")
    def walk(batch: pd.Series, matches: pd.Series) -> pd.Series:
        return pd.Series([pick(r, () if m is None else ((x["end"], x["n"], x["cost"]) for x in m), unknown) for r, m in zip(batch, matches, strict=True)])

    return distinct.join(listed, "run", "left").select("run", walk("run", "matches").alias("terms"))
