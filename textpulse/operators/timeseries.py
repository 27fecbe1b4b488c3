"""Snapshot and time-series operators: cumulative snapshots, deltas, latest ticks, look-back,
day changes and elapsed-interval resets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse import fixed
from textpulse.functions.time import day_of_ms, previous_day, tick_ms


MAX_METRICS = 10_000


def metric_names(df: DataFrame, metric_col: str) -> list[str]:
    """The distinct non-null metrics of a column, sorted; refuses a column that is no metric name
    (more than ``MAX_METRICS`` values, the bound Spark's own pivot has)."""
    names = [r[0] for r in df.where(F.col(metric_col).isNotNull()).select(metric_col).distinct().limit(MAX_METRICS + 1).collect()]
    if len(names) > MAX_METRICS:
        raise ValueError(f"{metric_col} has more than {MAX_METRICS} values")
    return sorted(names)


def snapshot(increments: DataFrame, sec_col: str, metric_col: str, value_col: str | None,
             metrics: Sequence[str] | None = None, period_s: int = fixed.SNAPSHOT_PERIOD_SECONDS,
             idle_ticks: bool = True) -> DataFrame:
    """Totals of the current day's rows at every snapshot tick: (tick_ms, day, metric, total).

    Each row contributes ``value`` (1 if ``value_col`` is None) to its metric at the tick of
    its arrival second; a snapshot at tick t holds, per metric, the sum of all of the day's
    contributions up to t (totals restart each UTC day, like the daily tables they read).
    ``metrics`` defaults to those in the data. ``idle_ticks`` writes every tick between the first
    and the last, like a job that runs each period, also when no row arrived.
    Rows are first reduced to one row per tick (conditional sums, combined map-side), so the
    running-sum window only ever sees at most one row per tick of a day.
    """
    metrics = metric_names(increments, metric_col) if metrics is None else list(metrics)
    v = F.col(value_col) if value_col else F.lit(1)
    names = [f"m{k}" for k in range(len(metrics))]
    per_tick = (
        increments.where(F.col(sec_col).isNotNull()).withColumn("tick_ms", tick_ms(sec_col, period_s))
        .groupBy("tick_ms")
        .agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(F.when(F.col(metric_col) == m, v)), F.lit(0)).cast("bigint").alias(n)
               for m, n in zip(metrics, names, strict=True)])
    )
    if idle_ticks:
        span = per_tick.agg(F.min("tick_ms").alias("a"), F.max("tick_ms").alias("b")).where("a is not null")
        ticks = span.select(F.explode(F.sequence("a", "b", F.lit(period_s * 1000).cast("bigint"))).alias("tick_ms"))
        per_tick = ticks.join(per_tick, "tick_ms", "left").fillna(0, subset=names)
    per_tick = per_tick.withColumn("day", day_of_ms("tick_ms"))
    upto = Window.partitionBy("day").orderBy("tick_ms").rowsBetween(Window.unboundedPreceding, 0)
    running = per_tick.select("tick_ms", "day", *[F.sum(n).over(upto).alias(n) for n in names])
    totals = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(n).alias("total")) for m, n in zip(metrics, names, strict=True)])) if metrics else None
    if totals is None:
        return running.select("tick_ms", "day", F.lit("").alias("metric"), F.lit(0).cast("bigint").alias("total")).limit(0)
    return running.select("tick_ms", "day", totals.alias("m")).select("tick_ms", "day", "m.metric", "m.total")


def snapshot_delta(snapshots: DataFrame, tick_col: str = "tick_ms", metric_col: str = "metric",
                   value_col: str = "total", reset_daily: bool = False, day_col: str = "day",
                   out_col: str = "delta") -> DataFrame:
    """Newest minus previous snapshot per metric; with no earlier snapshot the previous is 0.

    By default the previous snapshot may come from the day before (the first delta of a day is
    today's total minus yesterday's last, as the original computes across its daily tables);
    ``reset_daily=True`` compares only within a day. The window holds one row per tick and
    metric, i.e. it grows with the time span, not with the data volume.
    """
    parts = [metric_col, day_col] if reset_daily else [metric_col]
    w = Window.partitionBy(*parts).orderBy(tick_col)
    prev = F.coalesce(F.lag(value_col).over(w), F.lit(0))
    return snapshots.withColumn(out_col, (F.col(value_col) - prev).cast("bigint"))


def latest_ticks(snapshots: DataFrame, tick_col: str = "tick_ms", k: int = 2) -> DataFrame:
    """Rows of the ``k`` most recent distinct ticks (top-k, then a broadcast semi join of k rows)."""
    top = snapshots.select(tick_col).distinct().orderBy(F.col(tick_col).desc()).limit(k)
    return snapshots.join(F.broadcast(top), tick_col, "left_semi")


def lookback(df: DataFrame, tick_col: str = "tick_ms", as_of_ms: int | Column | None = None,
             minutes: int = fixed.LOOKBACK_MINUTES) -> DataFrame:
    """Rows with ``tick >= as_of - minutes``; ``as_of`` defaults to the newest tick in the data."""
    if as_of_ms is None:
        as_of: Column = df.agg(F.max(tick_col)).scalar()
    elif isinstance(as_of_ms, Column):
        as_of = as_of_ms
    else:
        as_of = F.lit(int(as_of_ms))
    return df.where(F.col(tick_col) >= as_of - F.lit(minutes * 60 * 1000))


def day_changes(df: DataFrame, sec_col: str, id_col: str) -> DataFrame:
    """The rows at which the UTC calendar day changes in (time, id) order — the first row of
    every day — with the day and the previous day's key: (day, previous_day, id, sec).

    A global ``lag`` over time would pull everything into one task; the first row per day is
    a grouped ``min`` with a map-side partial phase.
    """
    firsts = (
        df.withColumn("day", day_of_ms(F.col(sec_col) * 1000))
        .groupBy("day")
        .agg(F.min(F.struct(F.col(sec_col).alias("sec"), F.col(id_col).alias("id"))).alias("_f"))
    )
    return firsts.select("day", previous_day("day").alias("previous_day"),
                         F.col("_f.id").alias(id_col), F.col("_f.sec").alias(sec_col))


def elapsed_resets(df: DataFrame, key_col: str, sec_col: str, id_col: str, interval_s: int) -> DataFrame:
    """Greedy elapsed-interval resets per key: a key's first row resets, and afterwards the
    first row at least ``interval_s`` after the last reset resets again (the daily/hourly
    clock of the original). Returns the reset rows: (key, id, sec, reset_no), reset_no from 0.

    A reset only depends on the seconds at which a key has rows, and takes the smallest id of
    its second, so rows are first reduced to one per (key, second), combined map-side: what is
    left of a key, however large its share of the rows, is bounded by the time span. One pass
    over key-sorted partitions then keeps the current key and its last reset and jumps from
    reset to reset by binary search. Keys and ids may be of any type; null keys are one key;
    rows without a second cannot be placed and are left out.
    """
    key, sec = F.col(key_col), F.col(sec_col).cast("bigint")
    rows = df.where(F.col(sec_col).isNotNull()).select(key.alias("key"), sec.alias("sec"), F.col(id_col).alias("id"))
    seconds = rows.groupBy("key", "sec").agg(F.min("id").alias("id"))
    group = F.coalesce(F.concat(F.lit("k"), F.col("key").cast("string")), F.lit(""))
    ordered = seconds.withColumn("grp", group).repartition("grp").sortWithinPartitions("grp", "sec")

    def resets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, count = None, None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("grp")
            secs = batch.column("sec").to_numpy()
            changed = pc.not_equal(groups.slice(1), groups.slice(0, len(groups) - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, changed])
            picked, numbers = [], []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(secs)], strict=True):
                name = groups[a].as_py()
                if name != current:
                    current, last, count = name, None, -1
                i = a
                while i < b:
                    if last is not None and secs[i] - last < interval_s:
                        i = a + int(np.searchsorted(secs[a:b], last + interval_s, side="left"))
                        continue
                    last, count = int(secs[i]), count + 1
                    picked.append(i)
                    numbers.append(count)
                    i += 1
            taken = batch.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column("key"), taken.column("id"), taken.column("sec"), pa.array(numbers, pa.int64())], ["key", "id", "sec", "reset_no"])

    schema = T.StructType([seconds.schema["key"], seconds.schema["id"], seconds.schema["sec"], T.StructField("reset_no", T.LongType())])
    found = ordered.select("grp", "key", "sec", "id").mapInArrow(resets, schema)
    return found.select(F.col("key").alias(key_col), F.col("id").alias(id_col), F.col("sec").alias(sec_col), "reset_no")
