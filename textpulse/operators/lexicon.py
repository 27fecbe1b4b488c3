"""Lexicon lookups: polarity classification and blacklist exclusion (broadcast hash joins)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.operators.joins import DEFAULT_BROADCAST_ROWS, bounded_broadcast


def lexicon(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """(word, polarity) with one row per word; a word in both lists is negative."""
    both = negative.select("word", F.lit(fixed.NEGATIVE).alias("polarity"), F.lit(0).alias("prio")).unionByName(
        positive.select("word", F.lit(fixed.POSITIVE).alias("polarity"), F.lit(1).alias("prio"))
    )
    return both.groupBy("word").agg(F.min_by("polarity", "prio").alias("polarity"))


def classify(tokens: DataFrame, lex: DataFrame, word_col: str = "word", out_col: str = "emotion",
             default: str = fixed.UNKNOWN, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Attach the word's polarity (``default`` when absent) via a left join to the lexicon."""
    lex = lex.select(F.col("word").alias("_lw"), F.col("polarity").alias("_pol"))
    lex = bounded_broadcast(lex, max_broadcast_rows)
    joined = tokens.join(lex, tokens[word_col] == lex["_lw"], "left")
    return joined.withColumn(out_col, F.coalesce(F.col("_pol"), F.lit(default))).drop("_lw", "_pol")


def drop_blacklisted(tokens: DataFrame, words: DataFrame, scope: str = "all", word_col: str = "word",
                     origin_col: str = "origin", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Remove blacklisted terms; ``scope="reply"`` applies the list to replies only."""
    bl = bounded_broadcast(words.select(F.col("word").alias("_bw")).distinct(), max_broadcast_rows)
    if scope == "all":
        return tokens.join(bl, tokens[word_col] == bl["_bw"], "left_anti")
    if scope != "reply":
        raise ValueError(f"scope must be 'all' or 'reply', got {scope!r}")
    flagged = tokens.join(bl, tokens[word_col] == bl["_bw"], "left")
    return flagged.where(F.col("_bw").isNull() | (F.col(origin_col) != "reply")).drop("_bw")
