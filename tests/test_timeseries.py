
from textpulse.operators.timeseries import (
    day_changes,
    elapsed_resets,
    latest_ticks,
    lookback,
    snapshot,
    snapshot_delta,
)

DAY = 86400


def test_deltas_from_zero_base(spark):
    snaps = spark.createDataFrame([(1, "20240101", "m", 3), (2, "20240101", "m", 10)],
                                  "tick_ms BIGINT, day STRING, metric STRING, total BIGINT")
    got = [r.delta for r in snapshot_delta(snaps).orderBy("tick_ms").collect()]
    assert got == [3, 7]


def test_snapshot_totals_restart_daily_and_delta_crosses_days(spark):
    t0 = 1704067200  # 2024-01-01T00:00:00Z
    rows = [(t0 + 10, "a"), (t0 + 20, "a"), (t0 + 400, "b"), (t0 + DAY + 5, "a")]
    inc = spark.createDataFrame(rows, "sec BIGINT, metric STRING")
    snaps = snapshot(inc, "sec", "metric", None, ["a", "b"], idle_ticks=False)
    got = {(r.tick_ms // 1000 - t0, r.metric): r.total for r in snaps.collect()}
    assert got == {(0, "a"): 2, (0, "b"): 0, (300, "a"): 2, (300, "b"): 1, (DAY, "a"): 1, (DAY, "b"): 0}
    deltas = {(r.tick_ms // 1000 - t0, r.metric): r.delta for r in snapshot_delta(snaps).collect()}
    # first snapshot of a new day: today's total minus yesterday's last
    assert deltas[(DAY, "a")] == 1 - 2 and deltas[(DAY, "b")] == 0 - 1
    daily = {(r.tick_ms // 1000 - t0, r.metric): r.delta for r in snapshot_delta(snaps, reset_daily=True).collect()}
    assert daily[(DAY, "a")] == 1


def test_latest_ticks_and_lookback(spark):
    rows = [(t * 300000, "m", t) for t in range(10)]
    df = spark.createDataFrame(rows, "tick_ms BIGINT, metric STRING, total BIGINT")
    assert sorted(r.tick_ms for r in latest_ticks(df, k=2).collect()) == [8 * 300000, 9 * 300000]
    assert lookback(df, minutes=30).count() == 7  # ticks 3..9 within 30 minutes of tick 9
    assert lookback(df, as_of_ms=3 * 300000, minutes=5).count() == 8


def test_day_changes_first_row_per_day(spark):
    rows = [(1, 1704067200 + 5), (2, 1704067200 + 5), (3, 1704067200 + DAY + 1), (0, 1704067200 - 1)]
    df = spark.createDataFrame(rows, "id BIGINT, sec BIGINT")
    got = sorted(tuple(r) for r in day_changes(df, "sec", "id").collect())
    assert got == [
        ("20231231", "20231230", 0, 1704067199),
        ("20240101", "20231231", 1, 1704067205),
        ("20240102", "20240101", 3, 1704067200 + DAY + 1),
    ]


def test_elapsed_resets_greedy(spark):
    secs = [0, 100, DAY - 1, DAY, DAY + 5, 2 * DAY + 10, 5 * DAY]
    rows = [(7, i, s) for i, s in enumerate(secs)] + [(8, 100, 50)]
    df = spark.createDataFrame(rows, "k BIGINT, id BIGINT, sec BIGINT")
    got = sorted(tuple(r) for r in elapsed_resets(df, "k", "sec", "id", DAY).collect())
    assert got == [(7, 0, 0, 0), (7, 3, DAY, 1), (7, 5, 2 * DAY + 10, 2), (7, 6, 5 * DAY, 3), (8, 100, 50, 0)]


def _brute_resets(rows, interval):
    out = []
    for key in {k for k, _, _ in rows}:
        last, n = None, 0
        for sec, i in sorted((s, i) for k, i, s in rows if k == key and s is not None):
            if last is None or sec - last >= interval:
                out.append((key, i, sec, n))
                last, n = sec, n + 1
    return sorted(out, key=str)


def test_resets_with_a_hot_key_repeated_ids_null_and_string_keys(spark):
    import random

    rnd = random.Random(7)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 9007199254740993, None]), rnd.randrange(50), rnd.randint(0, 30 * DAY)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k BIGINT, id BIGINT, sec BIGINT").repartition(5)
    assert sorted(map(tuple, elapsed_resets(df, "k", "sec", "id", DAY).collect()), key=str) == _brute_resets(rows, DAY)
    assert sorted(map(tuple, elapsed_resets(df, "k", "sec", "id", 3600).collect()), key=str) == _brute_resets(rows, 3600)
    texts = [(None if k is None else f"user{k}", f"id{i}", s) for k, i, s in rows] + [("", "e", 5), ("x", "no second", None)]
    strings = spark.createDataFrame(texts, "k STRING, id STRING, sec BIGINT")
    assert sorted(map(tuple, elapsed_resets(strings, "k", "sec", "id", DAY).collect()), key=str) == _brute_resets(texts, DAY)
    assert elapsed_resets(df.limit(0), "k", "sec", "id", DAY).count() == 0


def test_idle_ticks_are_written_and_metrics_come_from_the_data(spark):
    inc = spark.createDataFrame([(0, "a"), (901, "b"), (902, None), (None, "a")], "sec BIGINT, metric STRING")
    snaps = snapshot(inc, "sec", "metric", None)
    assert {(r.tick_ms // 300000, r.metric): r.total for r in snaps.collect()} == {(t, m): int(m == "a" or t == 3) for t in range(4) for m in "ab"}
    deltas = {(r.tick_ms // 300000, r.metric): r.delta for r in snapshot_delta(snaps).collect()}
    assert deltas[(1, "a")] == 0 and deltas[(3, "b")] == 1
    assert snapshot(inc.limit(0), "sec", "metric", None).count() == 0
