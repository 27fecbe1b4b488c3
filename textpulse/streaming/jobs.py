"""Structured Streaming forms of the operators.

* :func:`windowed_hot_words` — tumbling 5-minute arrival windows with a watermark, keyed by
  content bucket and word (state bounded by the watermark).
* :func:`running_word_counts` — unbounded running counts per key in ``update`` mode.
* :func:`run_branches` — one source, several outputs: a ``foreachBatch`` that persists the
  micro-batch once and hands it to every branch (sink callables get ``batch_id`` so they can
  be idempotent, e.g. :meth:`TableStore.accumulate`).
* :func:`last_emitted` — final state from an ``update``-mode output log (latest emission per
  key), which equals the batch result once the stream has consumed its input.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from textpulse import fixed
from textpulse.functions.time import day_of_ms, seconds_to_timestamp
from textpulse.session import remove_path

BatchSink = Callable[[DataFrame, int], None]


def table_stream(spark: SparkSession, directory: str, schema: str, glob: str | None = None,
                 max_files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """A file stream over the files of a directory (optionally only those matching ``glob``);
    new files are picked up as they land."""
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(directory)


def stored_table_stream(spark: SparkSession, sf_dir: str, table: str, schema: str,
                        max_files_per_trigger: int = 64) -> DataFrame:
    """A file stream over one stored table, whether it is a single file or a folder of part files;
    a micro-batch takes at most ``max_files_per_trigger`` files."""
    path = f"{sf_dir.rstrip('/')}/{table}.parquet"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        return table_stream(spark, path, schema, "*.parquet", max_files_per_trigger)
    return table_stream(spark, sf_dir, schema, f"{table}.parquet", max_files_per_trigger)


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Use the RocksDB state store for queries started inside; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB_PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_until_idle(writer: DataStreamWriter) -> StreamingQuery:
    """Run a query over all there is, the batches without data that a moved watermark asks for
    included (sources written in Python get none with ``availableNow``), and stop it."""
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What a stream's batches wrote under ``path``; no rows if no batch wrote any."""
    fields = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(path)


def windowed_counts(tokens: DataFrame, arrival_col: str, watermark: str, width_s: int) -> DataFrame:
    """Streaming (window, bucket_ms, word, cnt) over tumbling arrival windows."""
    ts = tokens.withColumn("_arrival_ts", seconds_to_timestamp(arrival_col)).withWatermark("_arrival_ts", watermark)
    return ts.groupBy(F.window("_arrival_ts", f"{width_s} seconds"), "bucket_ms", "word").agg(F.count(F.lit(1)).alias("cnt"))


def windowed_hot_words(tokens: DataFrame, arrival_col: str = "arrival_sec", watermark: str = "10 minutes",
                       width_s: int = fixed.BUCKET_SECONDS) -> DataFrame:
    """Streaming count per (arrival window, bucket, word); late rows beyond the watermark are
    dropped and their windows' state is released."""
    counts = windowed_counts(tokens, arrival_col, watermark, width_s)
    return counts.select(
        (F.unix_micros(F.col("window.start")) / 1000).cast("bigint").alias("window_ms"), "bucket_ms", "word", "cnt"
    )


def running_word_counts(tokens: DataFrame, keys: Sequence[str] = ("bucket_ms", "word")) -> DataFrame:
    """Streaming running count per key (no window); run in ``update`` mode."""
    return tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def run_branches(source: DataFrame, branches: Mapping[str, tuple[Callable[[DataFrame], DataFrame], BatchSink]],
                 checkpoint: str, trigger: Mapping[str, object] | None = None,
                 output_mode: str = "append", query_name: str | None = None) -> StreamingQuery:
    """Start one streaming query whose micro-batches feed several outputs.

    ``branches`` maps a name to (build, sink): ``build`` turns the persisted micro-batch into
    that branch's result and ``sink(result, batch_id)`` writes it.
    """

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for build, sink in branches.values():
                sink(build(batch), batch_id)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    writer = writer.outputMode(output_mode)
    if query_name:
        writer = writer.queryName(query_name)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.start()


def write_updates(path: str) -> BatchSink:
    """A sink appending each micro-batch's rows under ``path`` tagged with ``batch_id``;
    a replayed batch id overwrites its own partition."""

    def sink(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    return sink


def last_emitted(log: DataFrame, keys: Sequence[str], batch_col: str = "batch_id") -> DataFrame:
    """Latest emitted row per key from an update-mode log (max_by over batch id)."""
    others = [c for c in log.columns if c not in keys and c != batch_col]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(batch_col)).alias("_r"))
    return latest.select(*keys, "_r.*")


def snapshot_ticks(source: DataFrame, on_tick: Callable[[DataFrame, int], None], checkpoint: str,
                   period: str = "5 minutes") -> StreamingQuery:
    """Run ``on_tick(batch, batch_id)`` every ``period`` (the periodic snapshot+delta job)."""
    return (
        source.writeStream.foreachBatch(on_tick)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=period)
        .start()
    )


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Expiry:
    """When running counts may be forgotten: ``keep_ms`` after the first key (an epoch-ms bucket),
    by the watermark of ``event_time_col`` (``delay`` behind its newest value). Rows behind the
    watermark are late and dropped."""

    event_time_col: str
    delay: str
    keep_ms: int


class RunningCountProcessor(StatefulProcessor):
    """Running counts emitted for every input record.

    The processor is keyed by a group of many first keys (and a slice of the other keys), because
    a call per word, or per bucket, would cost more than its work. Its state is a map from a first
    key to the counts of its fine keys in JSON; counts of more than ``PART`` fine keys are dealt to
    several entries by the fine key's CRC-32, so that a micro-batch rewrites no more than the
    entries of its own words. Within a micro-batch a key's rows are numbered in ``order_cols``
    order, continuing from the stored count: the rows are held as plain arrays (numbers for the keys'
    values, and the order columns) and come out in small frames. With ``keep_ms`` a timer removes a first key's
    counts when the watermark has passed it.

    Whole numbers come with a 0 for each null and the set of the null columns in ``NULLS`` (by the
    bits of ``bits``), since a frame with a null would turn them into floating point."""

    FRAME, PART, NULLS = 20_000, 1024, "nulls_in_row"  # a name with a leading _ would be lost on the way

    def __init__(self, group_key: str, fine_keys: Sequence[str], order_cols: Sequence[str], out_cols: Sequence[str], bits: Mapping[str, int], out_col: str = "running_cnt", keep_ms: int | None = None):
        self.group_key, self.fine_keys, self.order_cols = group_key, list(fine_keys), list(order_cols)
        self.out_cols, self.bits, self.out_col, self.keep_ms = list(out_cols), dict(bits), out_col, keep_ms
        self.keys = list(dict.fromkeys([group_key, *fine_keys]))

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "first STRING, part INT", "parts INT, words BIGINT, counts STRING")

    @staticmethod
    def _entry(values: Sequence) -> str:
        """A key as text; a null is no word "None"."""
        if len(values) == 1:
            return "" if values[0] is None or values[0] != values[0] else f"={values[0]}"
        return json.dumps([None if v is None or v != v else str(v) for v in values], ensure_ascii=False)

    def _columns(self, pdf, known: Mapping[str, dict]) -> list:
        """By key column the number of each row's value; new values get the next numbers in ``known``."""
        import numpy as np
        import pandas as pd

        out = []
        for c in self.keys:
            codes, more = pd.factorize(pdf[c], use_na_sentinel=False)
            of, values = known[c], (None if v != v else v for v in more.tolist())
            numbers = np.array([of.setdefault(v, len(of)) for v in values], np.int32)[codes]
            if c in self.bits:  # a null came as 0
                null = (pdf[self.NULLS].to_numpy() >> self.bits[c] & 1).astype(bool)
                if null.any():
                    numbers[null] = of.setdefault(None, len(of))
            out.append(numbers)
        return out

    def _distinct(self, columns: Sequence, known: Mapping[str, dict]):
        """The number of each row's key, and by first key its value, the range of its keys' numbers
        and their fine keys' entries. An entry is made once for all first keys."""
        import numpy as np

        values = [list(known[c]) for c in self.keys]
        fine_at = [self.keys.index(c) for c in self.fine_keys]
        fine = columns[fine_at[0]].astype(np.int64)
        names = [(v,) for v in values[fine_at[0]]]
        for k in fine_at[1:]:
            both, fine = np.unique(fine * len(values[k]) + columns[k], return_inverse=True)
            names = [(*names[x // len(values[k])], values[k][x % len(values[k])]) for x in both.tolist()]
        entries = np.array([self._entry(v) for v in names], object)
        at = self.keys.index(self.group_key)
        distinct, code = np.unique(columns[at] * np.int64(len(names)) + fine, return_inverse=True)
        firsts, mine = distinct // len(names), entries[distinct % len(names)].tolist()
        starts = np.flatnonzero(np.diff(firsts, prepend=-1)).tolist()
        parts = [(values[at][firsts[lo]], lo, hi, mine[lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(mine)], strict=True)]
        return code, parts

    def _deal(self, entries: Sequence[str], parts: int) -> dict:
        """By part the places of its entries."""
        import numpy as np

        if parts == 1:
            return {0: np.arange(len(entries))}
        part = np.fromiter((zlib.crc32(e.encode()) for e in entries), np.int64, len(entries)) % parts
        places = np.argsort(part, kind="stable")
        found, starts = np.unique(part[places], return_index=True)
        return dict(zip(found.tolist(), np.split(places, starts[1:]), strict=True))

    def _change(self, value: object, entries: Sequence[str], amounts, add: bool, fresh: bool = False):
        """Add the amounts to the counts of the entries of one first key, or store them; the counts before."""
        import numpy as np

        first = self._entry([value])
        head = None if fresh else self.counts.getValue((first, 0))
        parts, words = (1, 0) if head is None else (int(head[0]), int(head[1]))
        held: dict[int, dict[str, int]] = {} if head is None else {0: json.loads(head[2])}

        def load(part: int) -> dict[str, int]:
            if part not in held:
                found = self.counts.getValue((first, part)) if parts > 1 else None
                held[part] = {} if found is None else json.loads(found[2])
            return held[part]

        before = np.zeros(len(entries), np.int64)
        dealt = self._deal(entries, parts)
        for part, places in dealt.items():
            counts = load(part)
            words -= len(counts)
            mine = [entries[k] for k in places.tolist()]
            before[places] = [counts.get(e, 0) for e in mine]
            counts.update(zip(mine, (amounts[places] + (before[places] if add else 0)).tolist(), strict=True))
            words += len(counts)
        changed = {0, *dealt}
        if words > self.PART * parts:  # four times the room that is used, so this is rare
            every = {k: n for part in range(parts) for k, n in load(part).items()}
            parts = 1 << (4 * words // self.PART).bit_length()
            stored = list(every)
            held = {part: {stored[k]: every[stored[k]] for k in places.tolist()} for part, places in self._deal(stored, parts).items()}
            held.setdefault(0, {})
            changed = set(held)
        for part in changed:
            self.counts.updateValue((first, part), (parts, words, json.dumps(held[part], ensure_ascii=False)))
        if head is None and self.keep_ms is not None and value is not None:
            self.handle.registerTimer(int(value) + self.keep_ms)
        return before

    def handleInitialState(self, key, initialState, timerValues) -> None:
        import numpy as np

        known: dict[str, dict] = {c: {} for c in self.keys}
        code, parts = self._distinct(self._columns(initialState, known), known)
        totals = np.zeros(parts[-1][2] if parts else 0, np.int64)
        totals[code] = initialState[self.out_col].to_numpy()
        for value, lo, hi, entries in parts:
            self._change(value, entries, totals[lo:hi], add=False)

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        known: dict[str, dict] = {c: {} for c in self.keys}
        columns, orders, nulls = [[] for _ in self.keys], [[] for _ in self.order_cols], []
        for pdf in rows:
            for held, numbers in zip(columns, self._columns(pdf, known), strict=True):
                held.append(numbers)
            nulls.append(pdf[self.NULLS].to_numpy())
            for held, c in zip(orders, self.order_cols, strict=True):
                held.append(pdf[c].to_numpy())
        if not sum(map(len, nulls)):
            return
        columns, absent = [np.concatenate(held) for held in columns], np.concatenate(nulls)
        code, parts = self._distinct(columns, known)
        order = [np.concatenate(held) for held in orders]
        del orders, nulls
        ranks = []
        for c, o in zip(self.order_cols, order, strict=True):  # nulls come last
            ranks += [absent >> self.bits[c] & 1] if c in self.bits else []
            ranks.append(pd.factorize(o, sort=True, use_na_sentinel=False)[0] if o.dtype == object else o)
        by_key = np.lexsort([*ranks[::-1], code])
        sizes = np.bincount(code)
        fresh = not self.counts.exists()
        base = np.concatenate([self._change(value, entries, sizes[lo:hi], add=True, fresh=fresh) for value, lo, hi, entries in parts])
        starts = np.cumsum(sizes) - sizes
        running = np.empty(len(code), np.int64)
        running[by_key] = base[code[by_key]] + np.arange(len(code)) - starts[code[by_key]] + 1
        del by_key, ranks, code
        values = {}
        for c in self.keys:
            values[c] = np.empty(len(known[c]), np.int64 if c in self.bits else object)
            values[c][:] = [0 if v is None and c in self.bits else v for v in known[c]]
        numbers = dict(zip(self.keys, columns, strict=True))
        for start in range(0, len(running), self.FRAME):
            part = slice(start, start + self.FRAME)
            frame = {c: pd.Series(v[numbers[c][part]], dtype=v.dtype) for c, v in values.items()}
            frame |= {c: o[part] for c, o in zip(self.order_cols, order, strict=True)}
            yield pd.DataFrame({c: frame[c] for c in self.out_cols} | {self.out_col: running[part], self.NULLS: absent[part]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        first = self._entry([expiredTimerInfo.getExpiryTimeInMs() - self.keep_ms])
        head = self.counts.getValue((first, 0))
        for part in range(0 if head is None else int(head[0])):
            if self.counts.containsKey((first, part)):
                self.counts.removeKey((first, part))
        return iter(())

    def close(self) -> None:
        pass


def running_counts_per_record(tokens: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                              out_col: str = "running_cnt", salts: int = 8, expiry: Expiry | None = None,
                              initial: DataFrame | None = None, spans: int = 128) -> DataFrame:
    """Streaming per-record running counts: every input record is emitted (``append`` mode)
    with its key's count so far, in arrival order across micro-batches and ``order_cols``
    order within one. State is grouped by (hash of the first key mod ``spans``, hash of the other
    keys mod ``salts``), so a hot first key is spread over ``salts`` groups and many small ones
    share a group; each group holds a map of its counts. Neither may change for a checkpoint.

    ``expiry`` forgets a bucket when the watermark has passed it (default: counts are kept for
    ever). ``initial`` (keys, ``out_col``) gives stored totals from which the counts go on. Needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` =
    :data:`ROCKSDB_PROVIDER`)."""
    keys = list(keys)
    cols = list(dict.fromkeys([*keys, *order_cols]))
    rest = keys[1:] or keys
    group = (F.pmod(F.xxhash64(keys[0]), F.lit(spans)) * salts + F.pmod(F.xxhash64(*rest), F.lit(salts))).cast("int").alias("_group")
    fields = tokens.select(*cols).schema.fields
    bits = {f.name: i for i, f in enumerate(f for f in fields if isinstance(f.dataType, T.IntegralType))}

    def whole(of: Sequence[str]) -> list:
        """The columns with 0 for null in whole numbers, and which were null."""
        null = [F.when(F.col(c).isNull(), F.lit(1 << bits[c])).otherwise(F.lit(0)) for c in of if c in bits]
        marked = sum(null[1:], null[0]) if null else F.lit(0)
        return [*(F.coalesce(c, F.lit(0)).alias(c) if c in bits else F.col(c) for c in of), marked.cast("bigint").alias(RunningCountProcessor.NULLS)]

    extra = [expiry.event_time_col] if expiry and expiry.event_time_col not in cols else []
    rows = tokens.withWatermark(expiry.event_time_col, expiry.delay) if expiry else tokens
    rows = rows.select(*whole(cols), *extra, group)
    schema = T.StructType([*fields, T.StructField(out_col, T.LongType()), T.StructField(RunningCountProcessor.NULLS, T.LongType())])
    processor = RunningCountProcessor(keys[0], rest, order_cols, cols, bits, out_col, expiry.keep_ms if expiry else None)
    start = None
    if initial is not None:
        typed = [F.col(k).cast(tokens.schema[k].dataType).alias(k) for k in keys]
        totals = initial.select(*typed, F.col(out_col).cast("bigint").alias(out_col)).select(*whole(keys), out_col, group)
        # a group comes in batches: in order, a first key's totals lie in one of them (two at a batch's end), not a few in each
        start = totals.repartition("_group").sortWithinPartitions("_group", keys[0]).groupBy("_group")
    out = rows.groupBy("_group").transformWithStateInPandas(
        processor, schema, "Append", "EventTime" if expiry else "None", initialState=start
    )
    was_null = lambda c: F.col(RunningCountProcessor.NULLS).bitwiseAND(F.lit(1 << bits[c])) != 0
    return out.select(*(F.when(~was_null(c), F.col(c)).alias(c) if c in bits else F.col(c) for c in cols), out_col)


class TickProcessor(StatefulProcessor):
    """One snapshot per tick from closed ticks' sums: the day's running totals, idle ticks included.

    State: the totals after the last emitted tick, and the closed ticks not yet emitted. An event
    timer at the end of the next tick emits every tick that the watermark has passed. The
    group sees one row per tick, whatever the number of records."""

    def __init__(self, metrics: Sequence[str], period_ms: int):
        self.metrics, self.period_ms = list(metrics), period_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "tick BIGINT, totals ARRAY<BIGINT>")
        self.pending = handle.getListState("pending", "tick BIGINT, sums ARRAY<BIGINT>")

    def handleInputRows(self, key, rows, timerValues):
        new = [(int(r[0]), [int(x) for x in r[1:]]) for pdf in rows for r in pdf[["tick_ms", *(f"m{k}" for k in range(len(self.metrics)))]].itertuples(index=False)]
        if new:
            self.pending.appendList(new)
            if not list(self.handle.listTimers()):
                self.handle.registerTimer(min(t for t, _ in new) + self.period_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd

        upto = timerValues.getCurrentWatermarkInMs() // self.period_ms * self.period_ms  # ends of passed ticks
        waiting = [(int(t), list(sums)) for t, sums in self.pending.get()]
        first = min((t for t, _ in waiting), default=0)
        totals = [0] * len(self.metrics)
        if self.last.exists():
            last, totals = self.last.get()
            first, totals = int(last) + self.period_ms, [int(x) for x in totals]
        ticks = np.arange(first, upto, self.period_ms, dtype=np.int64)
        sums = np.zeros((len(ticks), len(self.metrics)), np.int64)
        for t, values in waiting:
            if t < upto:
                sums[(t - first) // self.period_ms] += values
        if len(ticks):
            day = ticks // 86_400_000
            running = np.cumsum(sums, axis=0)
            opens = np.concatenate(([True], day[1:] != day[:-1]))  # totals restart each day
            before = np.where(opens[:, None], np.vstack((np.zeros((1, len(self.metrics)), np.int64), running[:-1])), 0)
            running -= np.maximum.accumulate(before, axis=0)
            if self.last.exists() and (first - self.period_ms) // 86_400_000 == day[0]:
                running[day == day[0]] += np.array(totals, np.int64)
            left = [(t, v) for t, v in waiting if t >= upto]
            self.pending.put(left) if left else self.pending.clear()
            self.last.update((int(ticks[-1]), [int(x) for x in running[-1]]))
            yield pd.DataFrame({"tick_ms": np.repeat(ticks, len(self.metrics)), "metric": self.metrics * len(ticks), "total": running.ravel()})
        self.handle.registerTimer(max(upto, first) + self.period_ms)

    def close(self) -> None:
        pass


def tick_totals(events: DataFrame, sec_col: str, metric_col: str, metrics: Sequence[str], period_s: int = fixed.SNAPSHOT_PERIOD_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Streaming snapshots (tick_ms, day, metric, total), one per tick and metric as the watermark
    passes the tick, idle ticks included (``append`` mode): the batch ``snapshot`` as a job that
    ticks by itself. The records are first summed per tick in Spark's own windowed aggregate; a
    timer then walks the closed ticks. Rows without a time are left out. Needs RocksDB state."""
    timed = events.where(F.col(sec_col).isNotNull()).select(seconds_to_timestamp(sec_col).alias("_at"), F.col(metric_col).alias("_metric"))
    sums = [F.count(F.when(F.col("_metric") == m, 1)).alias(f"m{k}") for k, m in enumerate(metrics)]
    per_tick = timed.withWatermark("_at", delay).groupBy(F.window("_at", f"{period_s} seconds")).agg(*sums)
    rows = per_tick.select(F.window_time("window").alias("_closed"), (F.unix_micros("window.start") / 1000).cast("bigint").alias("tick_ms"), *(f"m{k}" for k in range(len(metrics))), F.lit(0).alias("job"))
    out = rows.groupBy("job").transformWithStateInPandas(TickProcessor(metrics, period_s * 1000), "tick_ms BIGINT, metric STRING, total BIGINT", "Append", "EventTime")
    return out.select("tick_ms", day_of_ms("tick_ms").alias("day"), "metric", "total")


def two_level_hot_words(tokens: DataFrame, arrival_col: str = "arrival_sec", watermark: str = "10 minutes", threshold: int = fixed.HOT_WORD_THRESHOLD, width_s: int = fixed.BUCKET_SECONDS) -> DataFrame:
    """Two stateful aggregates in one query (``append`` mode): counts per arrival window of which
    those at the threshold go on, summed per (day, bucket, word). A day comes out when the
    watermark has passed it; the state of closed windows and days is released."""
    counts = windowed_counts(tokens, arrival_col, watermark, width_s).where(F.col("cnt") >= threshold)
    daily = counts.groupBy(F.window(F.window_time("window"), "1 day").alias("window"), "bucket_ms", "word").agg(F.sum("cnt").alias("cnt"))
    start_ms = (F.unix_micros("window.start") / 1000).cast("bigint")
    return daily.select(day_of_ms(start_ms).alias("day"), "bucket_ms", "word", "cnt")


class ElapsedResetProcessor(StatefulProcessor):
    """Greedy elapsed-interval resets in arrival order: a key's first row resets, then the first
    row at least ``interval_s`` after the key's last reset. One value state per key: the second
    of its last reset and the number of resets so far."""

    def __init__(self, key_col: str, sec_col: str, id_col: str, interval_s: int):
        self.key_col, self.sec_col, self.id_col, self.interval_s = key_col, sec_col, id_col, interval_s

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "last BIGINT, n BIGINT")

    def handleInputRows(self, key, rows, timerValues):
        import numpy as np
        import pandas as pd

        # per batch of rows only the smallest id of every second can be a reset
        kept = None
        for pdf in rows:
            part = pdf.groupby(self.sec_col, sort=True)[self.id_col].min()
            kept = part if kept is None else pd.concat([kept, part]).groupby(level=0, sort=True).min()
        last, n = (int(x) for x in self.state.get()) if self.state.exists() else (None, -1)
        secs, ids = kept.index.to_numpy(), kept.to_numpy()
        i, out = 0, []
        while i < len(secs):
            if last is not None and secs[i] - last < self.interval_s:
                i = max(i + 1, int(np.searchsorted(secs, last + self.interval_s, side="left")))
                continue
            last, n = int(secs[i]), n + 1
            out.append((int(ids[i]), last, n))
            i += 1
        if last is not None:
            self.state.update((last, n))
        found = pd.DataFrame(out, columns=[self.id_col, self.sec_col, "reset_no"], dtype="int64")
        found.insert(0, self.key_col, pd.Series([key[0]] * len(found), dtype="int64"))
        yield found

    def close(self) -> None:
        pass


def elapsed_resets_stream(df: DataFrame, key_col: str, sec_col: str, id_col: str, interval_s: int) -> DataFrame:
    """Streaming elapsed-interval resets (``append`` mode); rows are processed in arrival order
    across micro-batches and in (second, id) order within one. Rows without key or second are left
    out. Needs the RocksDB state store (:func:`rocksdb_state`)."""
    rows = df.select(
        F.col(key_col).cast("bigint").alias(key_col), F.col(sec_col).cast("bigint").alias(sec_col),
        F.col(id_col).cast("bigint").alias(id_col),
    ).where(F.col(key_col).isNotNull() & F.col(sec_col).isNotNull())
    schema = f"{key_col} BIGINT, {id_col} BIGINT, {sec_col} BIGINT, reset_no BIGINT"
    return rows.groupBy(key_col).transformWithStateInPandas(
        ElapsedResetProcessor(key_col, sec_col, id_col, interval_s), schema, "Append", "None"
    )


def count_window_sink(root: str, order_cols: Sequence[str], size: int = 200, keep=None) -> BatchSink:
    """A ``foreachBatch`` sink cutting the stream into global windows of ``size`` rows in
    arrival order (batch id, then ``order_cols``); each full window fires once, rows passing
    ``keep`` are written to ``<root>/out`` with their window number, and the rows of the
    unfinished window are carried to the next batch (at most ``size - 1`` rows).

    Carried rows and the next window number are stored per batch id under ``<root>/state``, and
    output is written per batch id with dynamic overwrite, so a replayed batch reproduces the
    same result."""
    from textpulse.operators.aggregate import _numbered

    order_cols = list(order_cols)
    spark_of = lambda df: df.sparkSession

    def read_state(spark, batch_id: int):
        if batch_id == 0:
            return None, 0
        prev = f"{root}/state/batch_id={batch_id - 1}"
        meta = spark.read.json(f"{prev}/meta").first()
        pending = spark.read.parquet(f"{prev}/pending")
        return pending, int(meta["next_window"])

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = spark_of(batch)
        pending, next_window = read_state(spark, batch_id)
        # written once: the range numbering samples its rows, which would run a stateful batch twice
        written = f"{root}/rows/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(written)
        rows = spark.read.schema(batch.schema).parquet(written).withColumn("_b", F.lit(int(batch_id)).cast("bigint"))
        if pending is not None:
            rows = pending.unionByName(rows)
        numbered, sizes = _numbered(rows, [], ["_b", *order_cols], "_rn")
        total = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]  # one number per micro-batch
        full = total // size
        win = F.floor((F.col("_rn") - 1) / F.lit(size)).cast("bigint")
        fired = numbered.where(win < full).withColumn("window_no", win + F.lit(next_window))
        if keep is not None:
            fired = fired.where(keep)
        (fired.drop("_rn", "_b").withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/out"))
        state = f"{root}/state/batch_id={batch_id}"
        numbered.where(win >= full).drop("_rn").write.mode("overwrite").parquet(f"{state}/pending")
        spark.createDataFrame([(next_window + full,)], "next_window BIGINT").coalesce(1).write.mode(
            "overwrite").json(f"{state}/meta")
        remove_path(spark, written)

    return sink
