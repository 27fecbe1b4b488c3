"""State of the streaming jobs over several micro-batches and restarts: expiry, initial totals, timers."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from textpulse.operators.timeseries import snapshot
from textpulse.sources.record_log import append_to_log, record_log
from textpulse.streaming.jobs import Expiry, RunningCountProcessor, rocksdb_state, run_until_idle, running_counts_per_record, tick_totals, write_updates

TOKENS = "bucket_ms long, word string, seq long, pos int, at timestamp"


@pytest.fixture()
def steps(spark, tmp_dir):
    """Run a job over steps, restarted for each; the rows it wrote and its state's size after each."""

    def run(parts, schema, build):
        sizes = []
        for part in parts:
            append_to_log(spark.createDataFrame(part, schema) if isinstance(part, list) else part, f"{tmp_dir}/in", "t")
            rows = record_log(spark, f"{tmp_dir}/in", "t", start="earliest").select(F.from_json("value", schema).alias("r")).select("r.*")
            with rocksdb_state(spark):
                query = run_until_idle(build(rows).writeStream.outputMode("append").foreachBatch(write_updates(f"{tmp_dir}/out")).option("checkpointLocation", f"{tmp_dir}/ck"))
            ran = [p for p in query.recentProgress if p["stateOperators"]]
            sizes.append(ran[-1]["stateOperators"][-1]["numRowsTotal"])
        return spark.read.parquet(f"{tmp_dir}/out"), sizes

    return run


def at(seconds):
    import datetime

    return datetime.datetime.fromtimestamp(1704067200 + seconds, datetime.timezone.utc)


def test_expired_buckets_leave_the_state(steps):
    def bucket(k):  # 40 words a bucket; the row times lie in the bucket
        start = 1704067200 + 300 * k
        return [(start * 1000, f"w{i % 40}", i, 0, at(300 * k + i)) for i in range(120)]

    expiry = Expiry("at", "1 minute", 600_000)
    out, sizes = steps([bucket(k) for k in range(0, 24, 3)], TOKENS, lambda rows: running_counts_per_record(rows, ["bucket_ms", "word"], ["seq", "pos"], expiry=expiry))
    assert out.count() == 8 * 120 and {r.m for r in out.groupBy("bucket_ms", "word").agg(F.max("running_cnt").alias("m")).collect()} == {3}
    assert max(sizes) < 3 * 40 * 3 and sizes[-1] <= sizes[2]  # some buckets' entries, not all 8


def test_counts_go_on_from_stored_totals_and_null_is_no_word(spark, steps):
    first = [(0, "a", 1, 0, at(0)), (0, None, 2, 0, at(0)), (0, "None", 3, 0, at(0)), (0, "a", 4, 0, at(0))]
    second = [(0, "a", 6, 0, at(1)), (0, None, 5, 0, at(1)), (7, "a", 8, 0, at(1))]
    totals = spark.createDataFrame([(0, "a", 10), (0, None, 5), (9, "z", 1)], "bucket_ms int, word string, running_cnt int")
    out, _ = steps([first, second], TOKENS, lambda rows: running_counts_per_record(rows, ["bucket_ms", "word"], ["seq", "pos"], initial=totals))
    got = {r.seq: (r.word, r.running_cnt) for r in out.collect()}
    assert got == {1: ("a", 11), 2: (None, 6), 3: ("None", 1), 4: ("a", 12), 5: (None, 7), 6: ("a", 13), 8: ("a", 1)}


def test_rows_of_a_hot_word_are_numbered_in_order(steps):
    import random

    rows = [(0, "hot" if i % 10 else f"w{i}", i, i % 3, at(0)) for i in range(30_000)]
    random.Random(1).shuffle(rows)
    out, _ = steps([rows[:20_000], rows[20_000:]], TOKENS, lambda r: running_counts_per_record(r, ["bucket_ms", "word"], ["seq", "pos"]))
    hot = out.where("word = 'hot'").select("batch_id", "seq", "running_cnt").collect()
    assert sorted(r.running_cnt for r in hot) == list(range(1, 27_001))
    for batch in (0, 1):
        ordered = sorted((r.seq, r.running_cnt) for r in hot if r.batch_id == batch)
        assert [n for _, n in ordered] == sorted(n for _, n in ordered)


def test_ticks_equal_the_batch_snapshots(spark, steps):
    import random

    rng = random.Random(2)
    seconds = sorted(rng.randrange(0, 3 * 86_400) for _ in range(400))
    seconds = [s for s in seconds if not 40_000 < s < 90_000]  # idle over a day's end
    events = [(1704067200 + s, rng.choice(["a", "b", None])) for s in seconds]
    parts = [events[:90], events[90:91], events[91:250], events[250:], [(1704067200 + 5 * 86_400, None)]]
    out, _ = steps(parts, "sec long, kind string", lambda rows: tick_totals(rows, "sec", "kind", ["a", "b"]))
    want = snapshot(spark.createDataFrame(events, "sec long, kind string"), "sec", "kind", None, ["a", "b"])
    last = max(s for s, _ in events) * 1000
    columns = ["tick_ms", "day", "metric", "total"]
    got = sorted(map(tuple, out.where(F.col("tick_ms") <= last).select(*columns).collect()))
    assert got == sorted(map(tuple, want.select(*columns).collect()))
    assert out.select("batch_id").distinct().count() >= 3


def test_state_holds_an_entry_for_many_words(steps):
    rows = [(300_000 * (i // 40), f"w{i % 40}", i, 0, at(0)) for i in range(8_000)]  # 200 buckets of 40 words
    out, sizes = steps([rows, rows[:40]], TOKENS, lambda r: running_counts_per_record(r, ["bucket_ms", "word"], ["seq", "pos"]))
    assert max(sizes) <= 200 * 8  # not 8,000: one entry per bucket and salt
    assert sorted((r.running_cnt, r.n) for r in out.groupBy("running_cnt").agg(F.count(F.lit(1)).alias("n")).collect()) == [(1, 8_000), (2, 40)]


def test_counts_of_a_bucket_with_many_words_are_dealt_to_entries(steps):
    words = [(0, f"w{i}", i, 0, at(0)) for i in range(30_000)]
    more = [(0, f"w{i}", 40_000 + i, 0, at(0)) for i in range(0, 60_000, 7)]
    out, sizes = steps([words, more, [(0, "w7", 99_000, 0, at(0))]], TOKENS, lambda r: running_counts_per_record(r, ["bucket_ms", "word"], ["seq", "pos"]))
    assert 8 < sizes[0] <= 8 * 64
    got = {(r.word, r.seq): r.running_cnt for r in out.collect()}
    assert len(got) == len(words) + len(more) + 1 and got[("w7", 99_000)] == 3
    assert all(n == (2 if seq >= 40_000 and int(w[1:]) < 30_000 else 1) for (w, seq), n in got.items() if seq != 99_000)


def test_nulls_leave_the_other_rows_whole_numbers(steps):
    big = (1 << 53) + 1
    rows = [(0, "a", big, 0, at(0)), (0, "a", None, 0, at(0)), (None, "a", big, 1, at(0)), (None, None, None, None, at(0)), (0, "a", big + 1, None, at(0))]
    out, _ = steps([rows, rows], TOKENS, lambda r: running_counts_per_record(r, ["bucket_ms", "word"], ["seq", "pos"]))
    got = sorted(((r.bucket_ms, r.word, r.seq, r.pos, r.running_cnt) for r in out.collect()), key=str)
    want = []
    for bucket, word, seq, pos, first, later in ((0, "a", big, 0, 1, 4), (0, "a", big + 1, None, 2, 5), (0, "a", None, 0, 3, 6), (None, "a", big, 1, 1, 2), (None, None, None, None, 1, 2)):
        want += [(bucket, word, seq, pos, first), (bucket, word, seq, pos, later)]
    assert got == sorted(want, key=str)


def test_stored_totals_of_many_buckets_and_words(spark, steps):
    totals = spark.range(40_000).selectExpr("id % 2 * 300000 AS bucket_ms", "concat('w', id) AS word", "id + 1 AS running_cnt")
    rows = [(300_000 * (i % 2), f"w{i}", i, 0, at(0)) for i in range(0, 40_000, 9)]
    out, sizes = steps([rows], TOKENS, lambda r: running_counts_per_record(r, ["bucket_ms", "word"], ["seq", "pos"], initial=totals))
    assert sizes[0] <= 2 * 8 * 64  # not one for every word
    assert sorted((r.seq, r.running_cnt) for r in out.collect()) == [(i, i + 2) for i in range(0, 40_000, 9)]


class HeldState:
    """A processor's handle and map state, in a dict."""

    def __init__(self):
        self.held, self.written = {}, 0

    def getMapState(self, *_):
        return self

    def exists(self):
        return bool(self.held)

    def getValue(self, key):
        return self.held.get(key)

    def updateValue(self, key, value):
        self.held[key], self.written = value, self.written + 1


def test_an_entry_is_made_once_for_all_buckets(monkeypatch):
    made, entry = [], RunningCountProcessor._entry
    monkeypatch.setattr(RunningCountProcessor, "_entry", staticmethod(lambda values: made.append(values) or entry(values)))
    pairs = [(300_000 * b, f"w{w}") for b in range(60) for w in range(80)]
    totals = pd.DataFrame([(b, w, i, 0) for i, (b, w) in enumerate(pairs)], columns=["bucket_ms", "word", "running_cnt", "nulls_in_row"])
    rows = pd.DataFrame([(b, w, i, 0, 0) for i, (b, w) in enumerate(pairs + pairs[::3])], columns=["bucket_ms", "word", "seq", "pos", "nulls_in_row"])
    processor, state = RunningCountProcessor("bucket_ms", ["word"], ["seq", "pos"], ["bucket_ms", "word", "seq", "pos"], {"bucket_ms": 0, "seq": 1, "pos": 2}), HeldState()
    processor.init(state)
    processor.handleInitialState((0,), totals, None)
    out = pd.concat(processor.handleInputRows((0,), iter([rows[:3000], rows[3000:]]), None))
    assert len(made) <= 2 * (60 + 80)  # not one for every word of every bucket
    assert state.written == 2 * 60
    again = {k: i + 2 for i, k in enumerate(pairs)}
    got = {r.seq: (r.bucket_ms, r.word, r.running_cnt) for r in out.itertuples()}
    assert got == {**{i: (*k, i + 1) for i, k in enumerate(pairs)}, **{len(pairs) + i: (*k, again[k]) for i, k in enumerate(pairs[::3])}}


def test_two_fine_keys_and_a_null_among_them():
    columns = ["a", "b", "c", "seq"]
    rows = [(1, "x", 5, 0, 0), (1, "x", 5, 1, 0), (1, "x", 0, 2, 4), (1, None, 0, 3, 4), (2, "x", 5, 4, 0), (1, "x", 0, 5, 0), (0, "x", 5, 6, 1), (1, "x", 0, 7, 4)]
    processor = RunningCountProcessor("a", ["b", "c"], ["seq"], columns, {"a": 0, "seq": 1, "c": 2})
    processor.init(HeldState())
    frames = [pd.DataFrame(part, columns=[*columns, "nulls_in_row"]) for part in (rows[:5], rows[5:])]
    runs = [pd.concat(processor.handleInputRows((0,), iter(frames), None)) for _ in range(2)]
    assert runs[0].running_cnt.tolist() == [1, 2, 1, 1, 1, 1, 1, 2] and runs[1].running_cnt.tolist() == [3, 4, 3, 2, 2, 2, 2, 4]
    assert runs[0].c.tolist() == [5, 5, 0, 0, 5, 0, 5, 0] and [v if isinstance(v, str) else None for v in runs[0].b] == ["x", "x", "x", None, "x", "x", "x", "x"]


def test_stored_totals_come_in_order_of_their_bucket(spark, steps):
    totals = spark.createDataFrame([(b, f"w{w}", 1) for w in range(30) for b in range(20)], "bucket_ms long, word string, running_cnt long")
    plans = []

    def build(rows):
        out = running_counts_per_record(rows, ["bucket_ms", "word"], ["seq", "pos"], initial=totals, salts=1, spans=1)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out

    out, _ = steps([[(b, "w3", b, 0, at(0)) for b in range(20)]], TOKENS, build)
    assert "Sort [_group" in plans[0] and "RepartitionByExpression [_group" in plans[0]
    assert {r.running_cnt for r in out.collect()} == {2}
