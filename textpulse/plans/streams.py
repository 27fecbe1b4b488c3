"""Streaming queries over ``conversations`` as a file stream (trigger availableNow).

The queries read the same source: windowed hot words (tumbling 5-minute arrival windows with
a watermark) and unbounded running counts. They run in ``update`` mode; every micro-batch's
updated rows are logged per batch id, and the final state is the last emission per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from textpulse import fixed
from textpulse.functions.time import day_of_ms
from textpulse.operators.aggregate import sentiment_counts
from textpulse.operators.lexicon import classify
from textpulse.plans.messages import MESSAGES_SQL, POLARITY_SQL, RUNNING_SQL, _lexicon, prepare_messages, prepare_tokens
from textpulse.session import scratch_path
from textpulse.plans.events import ORACLE as EVENTS_ORACLE
from textpulse.operators.timeseries import metric_names
from textpulse.sources.adapters import KEY_STEP, event_seconds
from textpulse.plans.messages import ORACLE as MESSAGES_ORACLE
from textpulse.sources.record_log import append_to_log, commit_progress, publish_stream, record_log
from textpulse.sources.tables import read_table
from textpulse.sinks.store import TableStore
from textpulse.streaming.jobs import (
    BatchSink,
    count_window_sink,
    elapsed_resets_stream,
    last_emitted,
    read_log,
    rocksdb_state,
    run_branches,
    run_until_idle,
    running_counts_per_record,
    running_word_counts,
    stored_table_stream,
    tick_totals,
    two_level_hot_words,
    windowed_hot_words,
    write_updates,
)

CONVERSATION_SCHEMA = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = stored_table_stream(spark, sf_dir, "conversations", CONVERSATION_SCHEMA)
    return prepare_tokens(prepare_messages(conv))


def _run_to_end(result: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Run a stream over all there is; the log of its batches (with ``batch_id``)."""
    spark = result.sparkSession
    log = scratch_path(spark, f"{name}-log")
    query = (
        result.writeStream.outputMode(mode)
        .foreachBatch(write_updates(log))
        .option("checkpointLocation", scratch_path(spark, f"{name}-ckpt"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"streaming query {name} failed: {query.exception()}")
    return read_log(spark, log, result.schema)


def q_stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot words per 5-minute arrival window (count >= 10), from the stream's final state."""
    log = _run_to_end(windowed_hot_words(_token_stream(spark, sf_dir)), "stream-tumbling")
    final = last_emitted(log, ["window_ms", "bucket_ms", "word"])
    return final.where(F.col("cnt") >= fixed.HOT_WORD_THRESHOLD).select("window_ms", "bucket_ms", "word", "cnt")


def q_stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count per (bucket, word), from the stream's final state."""
    log = _run_to_end(running_word_counts(_token_stream(spark, sf_dir)), "stream-running")
    return last_emitted(log, ["bucket_ms", "word"]).select("bucket_ms", "word", "cnt")


def q_stream_running_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-record running count of (bucket, word) in arrival order (stateful processor, one
    map of counts by bucket for a span of buckets and a salt in a RocksDB state store); cleaned stream with the blacklist on replies."""
    conv = stored_table_stream(spark, sf_dir, "conversations", CONVERSATION_SCHEMA)
    toks = prepare_tokens(prepare_messages(conv), blacklist_scope="reply")
    out = running_counts_per_record(toks, ["bucket_ms", "word"], ["seq", "pos"])
    with rocksdb_state(spark):
        log = _run_to_end(out, "stream-running-per-record", mode="append")
    return log.select("bucket_ms", "word", "seq", "pos", "running_cnt")


def q_stream_elapsed_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: first event, then every first event at least 24 h after the last reset, as a
    stateful stream over the events file (arrival order across micro-batches)."""
    ev = event_seconds(stored_table_stream(spark, sf_dir, "events", EVENT_SCHEMA))
    out = elapsed_resets_stream(ev, "user_id", "sec", "event_id", 86_400)
    with rocksdb_state(spark):
        log = _run_to_end(out, "stream-elapsed-resets", mode="append")
    return log.select("user_id", "event_id", "sec", "reset_no")


def q_stream_count_window_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-record running counts (stateful stream) cut into global windows of 200 records by a
    micro-batch sink that carries the unfinished window; records with a running count above
    10 are emitted with their window number."""
    conv = stored_table_stream(spark, sf_dir, "conversations", CONVERSATION_SCHEMA)
    toks = prepare_tokens(prepare_messages(conv), blacklist_scope="reply")
    running = running_counts_per_record(toks, ["bucket_ms", "word"], ["seq", "pos"])
    root = scratch_path(spark, "stream-count-windows")
    sink = count_window_sink(root, ["seq", "pos"], size=200, keep=F.col("running_cnt") > 10)
    with rocksdb_state(spark):
        query = (running.writeStream.outputMode("append").foreachBatch(sink)
                 .option("checkpointLocation", scratch_path(spark, "stream-count-windows-ckpt"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(f"streaming query failed: {query.exception()}")
    schema = T.StructType([*running.schema.fields, T.StructField("window_no", T.LongType())])
    return read_log(spark, f"{root}/out", schema).select("window_no", "bucket_ms", "word", "seq", "pos", "running_cnt")


TOPIC, GROUP = "Word_Count", "WordCount.stream"
TURN_RECORD = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def _turns(log: DataFrame) -> DataFrame:
    """The turns in log records; records that do not parse are a failure here."""
    return log.select("key", F.from_json("value", TURN_RECORD, {"mode": "FAILFAST"}).alias("r")).select("key", "r.*")


def q_stream_log_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns read from a partitioned record log that grows in two steps.

    ``resumed``: one job from the earliest offset, stopped after the first step and restarted from
    its checkpoint. ``group``: a new job, after the second step, from the offsets that the first
    had committed for the group, so it sees the second step only. ``times`` counts how often a
    turn was seen.
    """
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    root = scratch_path(spark, "record-log")
    logs = {name: scratch_path(spark, f"record-log-{name}") for name in ("resumed", "group")}

    def consume(name: str, **start: str) -> StreamingQuery:
        stream = record_log(spark, root, TOPIC, **start).writeStream.foreachBatch(write_updates(logs[name]))
        query = stream.option("checkpointLocation", f"{logs[name]}-ckpt").trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    append_to_log(conv.where("conv_id % 2 = 0"), root, TOPIC, "conv_id")
    commit_progress(consume("resumed", start="earliest"), root, TOPIC, GROUP)
    append_to_log(conv.where("conv_id % 2 <> 0"), root, TOPIC, "conv_id")
    consume("resumed", start="earliest")
    consume("group", start="committed", group=GROUP)
    schema = record_log(spark, root, TOPIC, stream=False).schema
    seen = [_turns(read_log(spark, path, schema)).withColumn("job", F.lit(name)) for name, path in logs.items()]
    turns = seen[0].unionByName(seen[1])
    return turns.groupBy("job", "conv_id", "turn", "role", F.sha2("text", 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("times"))


def q_stream_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn published as a record by a stream, each micro-batch one commit, and read back
    from the log: per key the records, and whether their offsets have no gap."""
    conv = stored_table_stream(spark, sf_dir, "conversations", CONVERSATION_SCHEMA)
    root = scratch_path(spark, "published")
    query = publish_stream(conv, root, TOPIC, "publisher", scratch_path(spark, "published-ckpt"), "conv_id")
    query.awaitTermination()
    log = record_log(spark, root, TOPIC, stream=False)
    ends = log.groupBy("partition").agg((F.max("offset") + 1 == F.count_distinct("offset")).alias("dense"))
    per_key = log.groupBy("key", "partition").agg(F.count(F.lit(1)).alias("records"), F.sum(F.length("value")).alias("chars"))
    return per_key.join(F.broadcast(ends), "partition").select("key", "records", "chars", "dense")


def _in_steps(steps: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run a stateful job over a record log that grows step by step; the log of its output.

    Every step is one commit, and the job is restarted from its checkpoint
    for each, so state, watermark and timers come from the store.
    """
    log = root = None
    for step in steps:
        spark = step.sparkSession
        root = root or scratch_path(spark, f"{name}-in")
        log = log or scratch_path(spark, f"{name}-out")
        append_to_log(step, root, name)
        records = record_log(spark, root, name, start="earliest")
        rows = records.select(F.from_json("value", step.schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        result = build(rows)
        with rocksdb_state(spark):
            run_until_idle(result.writeStream.outputMode("append").foreachBatch(write_updates(log)).option("checkpointLocation", f"{log}-ckpt"))
    return read_log(spark, log, result.schema)


def _by_time(df: DataFrame, sec_col: str, steps: int, closing: tuple) -> Iterator[DataFrame]:
    """The rows in ``steps`` parts by time, then one closing row that moves the watermark on."""
    low, high = df.agg(F.min(sec_col), F.max(sec_col)).first()
    width = ((high or 0) - (low or 0)) // steps + 1
    for k in range(steps):
        yield df.where(F.col(sec_col).between((low or 0) + k * width, (low or 0) + (k + 1) * width - 1))
    yield df.sparkSession.createDataFrame([(*closing, (high or 0) + 3 * 86_400)], df.schema)


def q_stream_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hot words per arrival window, summed per day by a second stateful aggregate of the same
    query; three steps by arrival, then a row three days later that closes the last day."""
    toks = prepare_tokens(prepare_messages(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])))
    steps = _by_time(toks.select("bucket_ms", "word", "arrival_sec"), "arrival_sec", 3, (0, "~"))
    return _in_steps(steps, two_level_hot_words, "two-level").select("day", "bucket_ms", "word", "cnt")


def q_stream_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's totals of every event type at every tick up to the last event, written by timers
    of a running job; three steps by time, then a row that closes the last tick."""
    events = event_seconds(read_table(spark, sf_dir, "events", ["ts", "event_type"])).select("event_type", "sec").where("sec is not null")
    types = metric_names(events, "event_type")
    last = (events.agg(F.max("sec")).first()[0] or 0) * 1000
    done = _in_steps(_by_time(events, "sec", 3, (None,)), lambda rows: tick_totals(rows, "sec", "event_type", types), "ticks")
    return done.where(F.col("tick_ms") <= last).select("tick_ms", "day", "metric", "total")


def q_stream_resume_from_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-record running counts of the later half of the conversations, as a stream that starts
    from the stored totals of the earlier half."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    toks = prepare_tokens(prepare_messages(conv), blacklist_scope="reply").select("bucket_ms", "word", "seq", "pos")
    middle = ((conv.agg(F.max("conv_id")).first()[0] or 0) + 1) // 2 * KEY_STEP
    totals = scratch_path(spark, "totals")
    toks.where(F.col("seq") < middle).groupBy("bucket_ms", "word").agg(F.count(F.lit(1)).alias("running_cnt")).write.parquet(totals)
    build = lambda rows: running_counts_per_record(rows, ["bucket_ms", "word"], ["seq", "pos"], initial=spark.read.parquet(totals))
    log = _in_steps([toks.where(F.col("seq") >= middle)], build, "from-totals")
    return log.select("bucket_ms", "word", "seq", "pos", "running_cnt")


def q_stream_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job whose source feeds two outputs: word counts and sentiment counts per item, each
    accumulated by micro-batch into a table of its own; the sums of both tables."""
    messages = prepare_messages(stored_table_stream(spark, sf_dir, "conversations", CONVERSATION_SCHEMA))
    store = TableStore(spark, scratch_path(spark, "branches"))
    keys = {"words": ["bucket_ms", "word"], "sentiment": ["bucket_ms", "av", "emotion"]}

    def words(batch: DataFrame) -> DataFrame:
        return prepare_tokens(batch).groupBy(*keys["words"]).agg(F.count(F.lit(1)).alias("cnt"))

    def sentiment(batch: DataFrame) -> DataFrame:
        return sentiment_counts(classify(prepare_tokens(batch, min_len=None), _lexicon(batch.sparkSession)))

    def sink(table: str) -> BatchSink:
        return lambda rows, batch_id: store.accumulate(rows.withColumn("day", day_of_ms("bucket_ms")), table, keys[table], "cnt", batch_id)

    query = run_branches(messages, {"words": (words, sink("words")), "sentiment": (sentiment, sink("sentiment"))}, scratch_path(spark, "branches-ckpt"))
    query.awaitTermination()
    sums = {t: store.accumulated(t, keys[t], "cnt") for t in keys}
    word_rows = sums["words"].select(F.lit("words").alias("branch"), "day", "bucket_ms", F.col("word").alias("item"), F.lit("").alias("emotion"), "cnt")
    return word_rows.unionByName(sums["sentiment"].select(F.lit("sentiment").alias("branch"), "day", "bucket_ms", F.col("av").alias("item"), "emotion", "cnt"))


QUERIES = {
    "stream_branches": q_stream_branches,
    "stream_two_level": q_stream_two_level,
    "stream_ticks": q_stream_ticks,
    "stream_resume_from_totals": q_stream_resume_from_totals,
    "stream_log_resume": q_stream_log_resume,
    "stream_publish": q_stream_publish,
    "stream_tumbling": q_stream_tumbling,
    "stream_running": q_stream_running,
    "stream_running_per_record": q_stream_running_per_record,
    "stream_elapsed_resets": q_stream_elapsed_resets,
    "stream_count_window_batches": q_stream_count_window_batches,
}

_TOKENS = """
kept AS (
  SELECT (sec - sec % 300) * 1000 AS bucket_ms, arrival_sec, text
  FROM (SELECT role, text, CAST(1704067200 + conv_id * 61 + turn * 45 AS BIGINT) AS sec,
               CAST(1704067200 + conv_id * 61 + turn * 45 + turn * 150 AS BIGINT) AS arrival_sec
        FROM conversations)
  WHERE NOT (role = 'user' AND left(text, 1) = '[' AND right(text, 1) = ']' AND length(text) >= 2)
),
toks AS (
  SELECT * FROM (SELECT bucket_ms, arrival_sec, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word FROM kept)
  WHERE length(word) >= 2
)
"""

ORACLE = {
    "stream_branches": f"""WITH {MESSAGES_SQL},
both_branches AS (
  SELECT 'words' AS branch, bucket_ms, word AS item, '' AS emotion, count(*) AS cnt FROM toks GROUP BY bucket_ms, word
  UNION ALL
  SELECT 'sentiment', bucket_ms, av, {POLARITY_SQL}, count(*) FROM terms GROUP BY 1, 2, 3, 4
)
SELECT branch, strftime(DATE '1970-01-01' + CAST(bucket_ms // 86400000 AS INTEGER), '%Y%m%d') AS day, bucket_ms, item, emotion, cnt FROM both_branches""",
    "stream_two_level": MESSAGES_ORACLE["hot_words_two_level"],
    "stream_ticks": EVENTS_ORACLE["snapshot_totals"],
    "stream_resume_from_totals": f"""WITH {MESSAGES_SQL}, {RUNNING_SQL}
SELECT bucket_ms, word, seq, pos, running_cnt FROM running
WHERE seq >= ((SELECT max(conv_id) FROM conversations) + 1) // 2 * {KEY_STEP}""",
    "stream_log_resume": """
SELECT job, conv_id, turn, role, sha256(text) AS text_sha256, count(*) AS times
FROM conversations, (VALUES ('resumed'), ('group')) j(job) WHERE job = 'resumed' OR conv_id % 2 <> 0 GROUP BY ALL""",
    "stream_publish": """
SELECT CAST(conv_id AS VARCHAR) AS key, count(*) AS records,
       CAST(sum(length('{"conv_id":,"turn":,"role":"","text":""}') + length(CAST(conv_id AS VARCHAR)) + length(CAST(turn AS VARCHAR)) + length(role)
           + length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '"', ''), chr(10), ''))) AS BIGINT) AS chars,
       true AS dense
FROM conversations GROUP BY conv_id""",
    "stream_tumbling": f"""WITH {_TOKENS}
SELECT (arrival_sec - arrival_sec % 300) * 1000 AS window_ms, bucket_ms, word, count(*) AS cnt
FROM toks GROUP BY 1, 2, 3 HAVING count(*) >= 10""",
    "stream_running": f"""WITH {_TOKENS}
SELECT bucket_ms, word, count(*) AS cnt FROM toks GROUP BY 1, 2""",
    "stream_running_per_record": f"""WITH {MESSAGES_SQL}, {RUNNING_SQL}
SELECT bucket_ms, word, seq, pos, running_cnt FROM running""",
    "stream_elapsed_resets": EVENTS_ORACLE["elapsed_resets"],
    "stream_count_window_batches": MESSAGES_ORACLE["count_window_batches"],
}
