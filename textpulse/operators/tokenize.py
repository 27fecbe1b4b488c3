"""Tokenisation of message text into one row per term.

``mode="regex"`` (default): terms are runs of letters/digits; every punctuation, symbol and
separator is a boundary. This is the JVM-side path for spaced scripts.

``mode="dictionary"`` and ``mode="lattice"``: the text is first stripped of punctuation, symbols
and separators (the original's cleaning step); Han runs are then segmented with a dictionary and
other letter/digit runs stay whole. ``dictionary`` takes the longest word from the left
(unknown characters become single-character terms); ``lattice`` takes the likeliest words by
their counts in a table (see :mod:`textpulse.operators.segment`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.functions.text import clean, token_length, words
from textpulse.operators.segment import segment_by_join, segment_runs, word_costs

# a run of Han characters, or of other letters and digits
_RUNS = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"
_CHOICE = {"dictionary": "longest", "lattice": "likeliest"}


def _segmented(messages: DataFrame, text: Column, dictionary: DataFrame, choice: str, keep: list[str], word_col: str) -> DataFrame:
    """(keep..., pos, word); ``pos`` orders the terms of a text."""
    if choice == "likeliest":
        costs, unknown = word_costs(dictionary)
    else:
        entries = dictionary.select(F.col("word").cast("string").alias("word")).where(F.length("word") > 0).distinct()
        costs, unknown = entries.withColumn("cost", F.lit(0).cast("bigint")), 0
    kept = [F.col(f"`{c}`") for c in keep]
    is_han = lambda run: run.rlike(r"^\p{IsHan}")
    runs = F.regexp_extract_all(text, F.lit(_RUNS), 0)
    marked = F.transform(runs, lambda run: F.struct(run.alias("run"), is_han(run).alias("segmented")))
    segmented = segment_runs(messages.select(*kept, marked.alias("_terms")), costs, unknown, choice)
    if segmented is not None:  # no shuffle: every task segments its own messages
        return segmented.select(*kept, F.posexplode("_terms").alias("pos", word_col)).withColumn("pos", F.col("pos").cast("bigint"))
    source = F.struct(*kept).alias("source") if keep else F.lit(1).alias("source")
    listed = messages.select(source, F.posexplode(runs).alias("run_no", "run"))
    han = listed.where(is_han(F.col("run")))
    done = han.join(segment_by_join(han, costs, unknown, choice), "run").select("source", "run_no", F.posexplode("terms").alias("place", "word"))
    whole = listed.where(~is_han(F.col("run"))).select("source", "run_no", F.lit(0).alias("place"), F.col("run").alias("word"))
    pos = F.col("run_no").cast("bigint") * (1 << 32) + F.col("place")
    return done.unionByName(whole).select(*[F.col(f"source.`{c}`").alias(c) for c in keep], pos.alias("pos"), F.col("word").alias(word_col))


def tokenize(messages: DataFrame, text_col: str = "text", mode: str = "regex", dictionary: DataFrame | None = None,
             min_len: int | None = None, strip_latin: bool = False, utf16_length: bool = False,
             keep: Sequence[str] | None = None, word_col: str = "word", pos_col: str | None = "pos") -> DataFrame:
    """messages -> one row per term (keep..., pos, word); ``pos`` is the order in the text (dense, but
    for a dictionary beyond the broadcast bound).

    ``min_len`` keeps terms with at least that many characters (2 = the original's
    ``length > 1``); ``strip_latin`` removes ASCII letters first (windowed sentiment path).
    """
    keep = [c for c in (keep if keep is not None else messages.columns) if c != text_col]
    text: Column = F.col(text_col)
    if mode == "regex":
        if strip_latin:
            # only the letters go: separators must stay, they are this path's term boundaries
            text = F.regexp_replace(text, fixed.LATIN_PATTERN, "")
        terms = words(text)
    elif mode in _CHOICE:
        if dictionary is None:
            raise ValueError(f"mode={mode!r} needs a dictionary DataFrame with a `word` column (and `n`, its count, for the lattice)")
        out = _segmented(messages, clean(text, strip_latin=strip_latin), dictionary, _CHOICE[mode], keep, word_col)
        out = out.withColumnRenamed("pos", pos_col) if pos_col else out.drop("pos")
        return out.where(token_length(word_col, utf16=utf16_length) >= min_len) if min_len else out
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if pos_col:
        out = messages.select(*keep, F.posexplode(terms).alias(pos_col, word_col))
    else:
        out = messages.select(*keep, F.explode(terms).alias(word_col))
    if min_len:
        out = out.where(token_length(word_col, utf16=utf16_length) >= min_len)
    return out
