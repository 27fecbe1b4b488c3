"""Mixing sources to target weights by capped water-filling and seeded repetition.

The sources share the mix by weight. A source's share may not exceed ``max_epochs`` passes over
it; what is cut off is shared again among the others by weight, until no share is above its cap.
A source whose target is e.g. 2.4 times its size is taken twice as a whole, and 0.4 of it once
more: the documents with the smallest seeded keys, up to one cut-off key per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textpulse.operators.aggregate import running_counts
from textpulse.operators.joins import bounded_broadcast
from textpulse.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Levels of two hex digits of the documents' keys: after them a bucket holds one in 2^24 of a source.
LEVELS = 3


def word_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def document_key(seed: int, doc_id: Column, text: Column) -> Column:
    """The seeded pseudo-random place of a document in its source's order (32 hex digits).

    The text's digest sets apart documents that share an identifier (or have none).
    """
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))


def measure_documents(docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, key) of every document, without its text."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").alias("source"))
    return rows.select("id", "source", word_count(F.col("text")).alias("size"), document_key(seed, F.col("id"), F.col("text")).alias("key"))


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size): one row per source; null is a source of its own."""
    return sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))


def repeating_weights(sources: DataFrame, pattern: Sequence[int]) -> DataFrame:
    """Give the sources, by code point and null last, the weights of ``pattern`` over and over."""
    ranked = running_counts(sources.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    turn = F.pmod(F.col("_rank") - 1, F.lit(len(pattern))).cast("int")
    return ranked.withColumn("weight", F.get(F.array(*map(F.lit, pattern)), turn).cast("long")).drop("_null", "_rank")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Add ``target``, each source's words in a mix as large as all sources together.

    ``sources``: (source, source_size, weight), weights positive integers. In each round the
    sources whose share by weight is above their cap are clamped to it and the rest of the mix
    is shared among the others; the driver sees three numbers a round. The level only rises, so
    a clamped source stays clamped; it ends when a round clamps no further source. Integer
    arithmetic until the last division, so the result does not depend on the order of rows.
    """
    exact = "decimal(38,0)"
    cap = (F.col("source_size") * max_epochs).cast(exact)
    clamped = 0
    amount, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weights = int(amount or 0), int(weights or 0)
    left = total
    while True:
        over = cap * F.lit(weights).cast("decimal(18,0)") < F.col("weight") * F.lit(left).cast("decimal(19,0)")
        n, capped, open_weight = sources.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped:
            break
        clamped, left, weights = n, total - int(capped), int(open_weight or 0)
    share = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(max(weights, 1)))
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(share))


def repetition_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Add to each source ``whole`` passes and ``cut``: documents whose key is at most ``cut``
    are taken once more.

    The cut is the key at which the running size of the source's documents, in key order, comes
    nearest to the rest of the target. It is found digit by digit, so that no task holds a
    source: sizes by the next two digits (at most 256 sums a source) tell in which bucket the
    rest of the target ends, and the next level looks into that bucket only; after ``LEVELS``
    levels the bucket's own keys decide.
    """
    size, target = F.col("source_size").cast("double"), F.col("target")
    whole = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    wanted = targets.withColumn("whole", whole).withColumn("rest", target - F.col("whole") * size)
    at = wanted.select(F.col("source").alias("_source"), "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    inside = F.col("source").eqNullSafe(F.col("_source")) & F.col("key").startswith(F.col("prefix"))
    by_source = Window.partitionBy("_source")
    for level in range(1, LEVELS + 1):
        sums = sized.join(bounded_broadcast(at), inside).groupBy("_source", "rest", "before", F.substring("key", 1, 2 * level).alias("prefix")).agg(F.sum("size").alias("n"))
        upto = sums.withColumn("upto", F.col("before") + F.sum("n").over(by_source.orderBy("prefix")))
        first = F.min_by(F.struct("prefix", (F.col("upto") - F.col("n")).alias("before")), F.col("prefix"))
        at = materialize(upto.where(F.col("upto") > F.col("rest")).groupBy("_source", "rest").agg(first.alias("at")).select("_source", "rest", "at.*"))
    keys = sized.join(bounded_broadcast(at), inside).groupBy("_source", "rest", "prefix", "before", "key").agg(F.sum("size").alias("n"))
    middle = F.col("before") + F.sum("n").over(by_source.orderBy("key")) - F.col("n") / 2
    cuts = keys.withColumn("taken", middle <= F.col("rest")).groupBy("_source", "prefix").agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("last"))
    cuts = cuts.select("_source", F.coalesce("last", "prefix").alias("cut"))
    return wanted.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "rest").withColumn("cut", F.coalesce("cut", F.lit("")))


def mix_sources(docs: DataFrame, weights: Sequence[int] | DataFrame = (5, 2, 1), max_epochs: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: its id, ``source``, ``key``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``repeats`` (times the mix holds the document) and ``taken``
    (``size * repeats``).

    ``weights`` repeat over the sources by code point, or are a table (source, weight) with one
    positive integer per source. A source's taken words differ from its target by at most half
    of one document. A null text has no words; a null source is a source, the last by code
    point; documents with equal id and text decide alike (they are taken as often as each
    other, and count as one document in that bound); a source without words has target 0; an
    empty table gives no rows; other columns are ignored. The same input and seed give the same
    mix whatever its partitions.

    Each text is read once; its size and key are written to the checkpoint folder. A hot source
    is a partial sum per task; the per-source plan is broadcast if small, else joined.
    """
    sized = materialize(measure_documents(docs, seed, id_col, text_col, source_col))
    sources = source_sizes(sized)
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("_source"), F.col("weight").cast("long").alias("weight"))
        sources = sources.join(given, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    else:
        sources = repeating_weights(sources, weights)
    plan = materialize(repetition_plan(sized, water_fill(materialize(sources), max_epochs)))
    side = bounded_broadcast(plan.withColumnRenamed("source", "_source"))
    repeats = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    out = sized.join(side, F.col("source").eqNullSafe(F.col("_source"))).withColumn("repeats", F.when(F.col("target") > 0, repeats).otherwise(F.lit(0)).cast("long"))
    return out.select(F.col("id").alias(id_col), "source", "key", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def write_out_mix(docs: DataFrame, mixed: DataFrame, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` (all its columns) as often as ``mixed`` says.

    ``mixed`` is :func:`mix_sources` of the same documents, seed and columns.
    """
    decisions = mixed.groupBy(F.col("source").alias("_source"), F.col("key").alias("_key")).agg(F.max("repeats").alias("_repeats"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    key = document_key(seed, F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`").cast("string"))
    held = rows.withColumn("key", key).join(decisions, (F.col("key") == F.col("_key")) & F.col(f"row.`{source_col}`").eqNullSafe(F.col("_source")))
    return held.where(F.col("_repeats") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("_repeats")))).select("row.*")
