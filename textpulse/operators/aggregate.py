"""Aggregations: hot words, sentiment counts, running counts, totals, count windows.

All grouped counts are declarative ``groupBy().agg()``: Spark combines map-side (partial
HashAggregate) before the shuffle, so a hot word costs one partial row per task, not one
shuffled row per occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textpulse import fixed
from textpulse.functions.time import day_of_ms
from textpulse.session import materialize


def _threshold(cnt: Column, threshold: int, op: str) -> Column:
    if op == ">=":
        return cnt >= threshold
    if op == ">":
        return cnt > threshold
    raise ValueError(f"op must be '>=' or '>', got {op!r}")


def hot_words(tokens: DataFrame, threshold: int | None = fixed.HOT_WORD_THRESHOLD, op: str = ">=",
              keys: Sequence[str] = ("bucket_ms", "word"), count_col: str = "cnt") -> DataFrame:
    """Count per (bucket, word); keep pairs whose count passes the threshold (HAVING)."""
    agg = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
    if threshold is None:
        return agg
    return agg.where(_threshold(F.col(count_col), threshold, op))


def arrival_window_ms(arrival_sec: Column | str, width_s: int = fixed.BUCKET_SECONDS) -> Column:
    """Start (ms) of the tumbling arrival window containing ``arrival_sec``."""
    a = (F.col(arrival_sec) if isinstance(arrival_sec, str) else arrival_sec).cast("bigint")
    return (a - F.pmod(a, F.lit(width_s))) * F.lit(1000)


def hot_words_two_level(tokens: DataFrame, arrival_col: str = "arrival_sec",
                        threshold: int = fixed.HOT_WORD_THRESHOLD, op: str = ">=",
                        width_s: int = fixed.BUCKET_SECONDS, count_col: str = "cnt") -> DataFrame:
    """Per arrival window: count (bucket, word) and apply the threshold; then accumulate the
    surviving counts per (day, bucket, word), day = UTC day of the arrival window.

    Windows below the threshold contribute nothing, so the total can be below the global
    count of the pair; this is the original's accumulate-into-daily-table behaviour.
    """
    per_window = (
        tokens.withColumn("_win", arrival_window_ms(arrival_col, width_s))
        .groupBy("_win", "bucket_ms", "word")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(_threshold(F.col("_n"), threshold, op))
    )
    return (
        per_window.withColumn("day", day_of_ms("_win"))
        .groupBy("day", "bucket_ms", "word")
        .agg(F.sum("_n").alias(count_col))
    )


def sentiment_counts(tokens: DataFrame, keys: Sequence[str] = ("bucket_ms", "av", "emotion"),
                     count_col: str = "cnt") -> DataFrame:
    """Count of classified terms per (bucket, item, emotion); no threshold."""
    return tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))


def sentiment_first_item(tokens: DataFrame, order_cols: Sequence[str], keys: Sequence[str] = ("bucket_ms", "emotion"),
                         item_col: str = "av", count_col: str = "cnt") -> DataFrame:
    """Count per (bucket, emotion) and the item of the key's first record in ``order_cols``.

    ``min_by`` is a declarative aggregate with a partial phase, so a hot key is combined
    map-side like the count.
    """
    order = F.struct(*[F.col(c) for c in order_cols])
    return tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(count_col),
        F.min_by(F.col(item_col), order).alias(f"first_{item_col}"),
    )


def running_counts(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], out_col: str = "running_cnt",
                   num_partitions: int | None = None) -> DataFrame:
    """Per-record running count per key in ``order_cols`` order (1 for the key's first row).

    Skew-safe form of ``row_number() over (partition by keys order by order_cols)``: rows are
    range-partitioned on (keys, order), so a hot key is split over many tasks; each task
    numbers its slice, and a small per-(partition, key) count table supplies each slice's
    offset (at most one row per partition and key). The range-partitioned rows are written
    once to the checkpoint folder so that both consumers see the same partitioning.
    """
    return _numbered(df, keys, order_cols, out_col, num_partitions)[0]


def _numbered(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], out_col: str,
              num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`running_counts` and the sizes of its slices (``_pid``, keys, ``_n``)."""
    keys, order_cols = list(keys), list(order_cols)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sort_cols = keys + order_cols
    # Range bounds are sampled anew on each execution, so the partition ids are pinned by a
    # checkpoint before the numbering and the offset table both read them.
    ranged = materialize(df.repartitionByRange(n, *sort_cols).withColumn("_pid", F.spark_partition_id()))
    slice_sizes = ranged.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slice_sizes.select(
        F.col("_pid").alias("_opid"), *[F.col(k).alias(f"_o_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
    )
    local = ranged.withColumn(
        "_local", F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order_cols))
    )
    same = F.col("_pid") == F.col("_opid")
    for k in keys:  # a null key is a key like any other
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    out = local.join(offsets, same).withColumn(out_col, (F.col("_local") + F.col("_off")).cast("bigint"))
    return out.drop("_pid", "_local", "_off", "_opid", *[f"_o_{k}" for k in keys]), slice_sizes


def totals(df: DataFrame, value_col: str | None, by_col: str | None = None, values: Sequence[str] = (),
           total_name: str = "total", count_name: str | None = "rows") -> DataFrame:
    """One-pass global totals: SUM(value) (0 on empty input), SUM(value) WHERE by = v for each
    v, and COUNT(*). One row with one column per metric."""
    v = F.col(value_col) if value_col else F.lit(1)
    aggs = [F.coalesce(F.sum(v), F.lit(0)).alias(total_name)]
    for val in values:
        aggs.append(F.coalesce(F.sum(F.when(F.col(by_col) == val, v)), F.lit(0)).alias(val))
    if count_name:
        aggs.append(F.count(F.lit(1)).alias(count_name))
    return df.agg(*aggs)


def count_windows(df: DataFrame, order_cols: Sequence[str], size: int = 200, keep: Column | None = None,
                  window_col: str = "window_no", collect: bool = False) -> DataFrame:
    """Global count windows: rows in ``order_cols`` order are cut into consecutive windows of
    ``size`` rows; only full windows fire (a trailing partial window never does). Rows of a
    fired window that satisfy ``keep`` are emitted with their window number.

    Row numbers come from the skew-safe :func:`running_counts` with no key, so no single task
    ever holds the whole input. ``collect=True`` flushes each fired window as one list of its
    kept rows in order (window_no, rows); a list holds at most ``size`` rows.
    """
    numbered, sizes = _numbered(df, [], order_cols, "_rn")
    # the row count comes from the sizes of the pinned slices, not from a second numbering
    total = sizes.agg(F.sum("_n")).scalar()
    full_windows = F.floor(total / F.lit(size))
    fired = numbered.withColumn(
        window_col, F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")
    ).where(F.col(window_col) < full_windows)
    if keep is not None:
        fired = fired.where(keep)
    if collect:
        payload = [c for c in fired.columns if c not in ("_rn", window_col)]
        lists = fired.groupBy(window_col).agg(
            F.array_sort(F.collect_list(F.struct(F.col("_rn"), *[F.col(c) for c in payload]))).alias("_l")
        )
        return lists.select(window_col, F.transform("_l", lambda x: x.dropFields("_rn")).alias("rows"))
    return fired.drop("_rn")
