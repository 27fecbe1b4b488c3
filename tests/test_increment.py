from textpulse.plans.increment import increment_tick
from textpulse.sinks.store import TableStore

T0 = 1704067200000  # 2024-01-01T00:00:00Z
DAY_MS = 86_400_000


def _rows(store, table):
    return {(r.time_stamp, r.metric): r["count"] for r in store.read(table).collect()}


def test_increment_ticks_snapshot_and_delta(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    hot_schema = "times_stamp BIGINT, word STRING, count BIGINT, day STRING"
    emo_schema = "times_stamp BIGINT, av STRING, emotional STRING, count BIGINT, day STRING"
    store.append(spark.createDataFrame([(T0, "w", 12, "20240101")], hot_schema), "hot_word")
    store.append(spark.createDataFrame([(T0, "av1", "positive", 3, "20240101"), (T0, "av1", "unknown", 4, "20240101")],
                                       emo_schema), "emotional_word")
    increment_tick(store, T0 + 300_000)
    store.append(spark.createDataFrame([(T0, "x", 10, "20240101")], hot_schema), "hot_word")
    increment_tick(store, T0 + 600_000)
    increment_tick(store, T0 + 600_000)  # re-run of a tick replaces its rows
    # next day: empty tables -> totals 0, delta against yesterday's last snapshot
    store.append(spark.createDataFrame([(T0 + DAY_MS, "y", 11, "20240102")], hot_schema), "hot_word")
    increment_tick(store, T0 + DAY_MS + 300_000)

    counts = _rows(store, "increment_count")
    assert counts[(T0 + 300_000, "hotword")] == 12 and counts[(T0 + 600_000, "hotword")] == 22
    assert counts[(T0 + 600_000, "positive")] == 3 and counts[(T0 + 600_000, "negative")] == 0
    assert counts[(T0 + DAY_MS + 300_000, "hotword")] == 11
    deltas = _rows(store, "increment")
    assert deltas[(T0 + 300_000, "hotword")] == 12  # first snapshot: delta = total
    assert deltas[(T0 + 600_000, "hotword")] == 10 and deltas[(T0 + 600_000, "unknown")] == 0
    assert deltas[(T0 + DAY_MS + 300_000, "hotword")] == 11 - 22
    assert deltas[(T0 + DAY_MS + 300_000, "positive")] == -3
    assert len(counts) == 12 and len(deltas) == 12
