"""Plan-shape checks: the properties that matter at scale hold in the physical plans."""

import re

import __spark_entry__ as E
from textpulse.operators.aggregate import running_counts

SF = "/root/testdata/sf0.001"


def _formatted(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_hot_words_prunes_columns_and_aggregates_before_shuffle(spark):
    text = _formatted(spark, E.queries()["hot_words"](spark, SF))
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in text
    # partial count below the exchange, final count above it
    partial = text.index("partial_count")
    exchange = text.index("hashpartitioning(bucket_ms")
    assert partial < exchange


def test_lexicon_join_is_broadcast(spark):
    text = _formatted(spark, E.queries()["sentiment_by_item"](spark, SF))
    assert "BroadcastHashJoin LeftOuter BuildRight" in text


def test_running_counts_window_is_split_by_range_partition(spark):
    df = spark.createDataFrame([("k", i) for i in range(100)], "key STRING, seq BIGINT")
    text = _formatted(spark, running_counts(df, ["key"], ["seq"], num_partitions=4))
    # row_number is partitioned by (range partition id, key); only the offsets table, one row
    # per partition and key, is windowed by the key alone
    first_cols = re.findall(r"row_number\(\) windowspecdefinition\(([^,]+),", text)
    assert first_cols and all(c.startswith("_pid") for c in first_cols), first_cols


def test_flatten_reads_records_once(spark):
    df = E.queries()["nested_roundtrip"](spark, SF)
    text = _formatted(spark, df)
    physical = text.split("\n\n")[0]
    assert "Union" not in physical


def test_store_day_filter_prunes_partitions(spark, tmp_dir):
    from pyspark.sql import functions as F

    from textpulse.sinks.store import TableStore

    store = TableStore(spark, tmp_dir)
    rows = spark.createDataFrame([("20240101", "w", 1), ("20240102", "w", 2)], "day STRING, word STRING, count BIGINT")
    store.append(rows, "hot_word")
    df = store.scan("hot_word", columns=["word", "count"], where=F.col("day") == "20240102")
    text = _formatted(spark, df)
    assert "PartitionFilters: [isnotnull(day" in text and "(day#" in text
    assert [tuple(r) for r in df.collect()] == [("w", 2)]


def test_time_split_reaches_the_parquet_scan(spark):
    text = _formatted(spark, E.queries()["raw_upsert_last"](spark, SF))
    assert "PushedFilters: [IsNotNull(ts), LessThan(ts," in text
    assert "PushedFilters: [Or(GreaterThanOrEqual(ts," in text and "IsNull(ts))]" in text
    schemas = {frozenset(m.split(",")) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)}
    assert schemas == {frozenset(["event_id:bigint", "ts:timestamp_ntz", "user_id:bigint", "props:string"])}


def test_latest_two_snapshots_read_only_the_days_of_the_look_back(spark):
    text = _formatted(spark, E.queries()["latest_two_snapshots"](spark, SF))
    scans = re.findall(r"PushedFilters: \[([^\]]*)\]", text)
    assert scans and all("GreaterThanOrEqual(ts," in s for s in scans)


def test_running_counts_number_the_rows_once(spark):
    from textpulse.operators.aggregate import running_counts

    df = spark.createDataFrame([("a", i) for i in range(50)], "k STRING, o BIGINT")
    text = _formatted(spark, running_counts(df, ["k"], ["o"], num_partitions=3))
    assert text.count("row_number() windowspecdefinition") == 1


def test_elapsed_resets_reduce_rows_before_the_shuffle(spark):
    from textpulse.operators.timeseries import elapsed_resets

    df = spark.createDataFrame([(1, i, i * 1000) for i in range(50)], "k BIGINT, id BIGINT, sec BIGINT")
    text = _formatted(spark, elapsed_resets(df, "k", "sec", "id", 86400))
    assert "partial_min(id" in text and "Window" not in text
