"""Property checks on random inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpulse.functions import bucket_ms
from textpulse.operators.aggregate import running_counts
from textpulse.operators.timeseries import snapshot, snapshot_delta

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-10**9, max_value=4 * 10**9), min_size=1, max_size=50))
def test_buckets_are_multiples_and_truncate_like_java(spark, secs):
    df = spark.createDataFrame([(s,) for s in secs], "s BIGINT")
    got = [r.b for r in df.select(bucket_ms("s").alias("b")).collect()]
    assert got == [int(s / 300) * 300000 for s in secs]  # int() truncates toward zero
    assert all(b % 300000 == 0 for b in got)


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3 * 86400), st.sampled_from(["a", "b", "c"])), min_size=1, max_size=60))
def test_deltas_telescope_to_last_total(spark, rows):
    inc = spark.createDataFrame([(1704067200 + s, m) for s, m in rows], "sec BIGINT, metric STRING")
    snaps = snapshot_delta(snapshot(inc, "sec", "metric", None, ["a", "b", "c"]))
    per_metric = snaps.groupBy("metric").agg(
        F.sum("delta").alias("sum_delta"), F.max_by("total", "tick_ms").alias("last_total"))
    for r in per_metric.collect():
        assert r.sum_delta == r.last_total


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "x", "y"]), st.integers(0, 10**6)),
                min_size=1, max_size=80, unique_by=lambda t: t))
def test_running_counts_equal_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "key STRING, seq BIGINT")
    got = {(r.key, r.seq): r.running_cnt for r in running_counts(df, ["key"], ["seq"], num_partitions=3).collect()}
    expected = {}
    for key in {k for k, _ in rows}:
        for i, seq in enumerate(sorted(s for k, s in rows if k == key), start=1):
            expected[(key, seq)] = i
    assert got == expected
