from pyspark.sql import functions as F

from textpulse.operators.aggregate import count_windows, hot_words, hot_words_two_level, running_counts


def _skewed(spark, n=3000):
    # one key holds a third of the rows; sequence numbers are shuffled
    rows = [((i % 3 == 0) and "hot" or f"k{i % 97}", (i * 7919) % n) for i in range(n)]
    return spark.createDataFrame(rows, "key STRING, seq BIGINT")


def test_running_counts_match_brute_force_with_hot_key(spark):
    df = _skewed(spark)
    got = running_counts(df, ["key"], ["seq"], num_partitions=6).toPandas()
    exp = df.toPandas().sort_values(["key", "seq"])
    exp["running_cnt"] = exp.groupby("key").cumcount() + 1
    merged = got.merge(exp, on=["key", "seq"], suffixes=("", "_exp"))
    assert len(merged) == len(exp) == len(got)
    assert (merged.running_cnt == merged.running_cnt_exp).all()
    # the hot key was split over several range partitions
    assert got[got.key == "hot"].running_cnt.max() == 1000


def test_global_numbering_without_key(spark):
    df = _skewed(spark)
    got = running_counts(df, [], ["seq"], out_col="rn", num_partitions=5).toPandas().sort_values("seq")
    assert list(got.rn) == list(range(1, len(got) + 1))


def test_count_windows_fire_only_full_windows(spark):
    df = spark.range(450).withColumnRenamed("id", "seq")
    out = count_windows(df, ["seq"], size=200)
    stats = out.groupBy("window_no").agg(F.count("*").alias("n"), F.min("seq").alias("lo")).orderBy("window_no")
    assert [tuple(r) for r in stats.collect()] == [(0, 200, 0), (1, 200, 200)]
    kept = count_windows(df, ["seq"], size=200, keep=F.col("seq") % 2 == 0)
    assert kept.count() == 200


def test_two_level_never_exceeds_global_count(spark):
    rows = [(b * 300000, w, a) for b in range(3) for w in ("x", "y") for a in range(0, 3000, 37)]
    toks = spark.createDataFrame(rows, "bucket_ms BIGINT, word STRING, arrival_sec BIGINT")
    one = {(r.bucket_ms, r.word): r.cnt for r in hot_words(toks, threshold=None).collect()}
    two = hot_words_two_level(toks, threshold=8).collect()
    assert two
    for r in two:
        assert r.cnt <= one[(r.bucket_ms, r.word)]


def test_count_windows_flush_lists(spark):
    df = spark.range(450).withColumnRenamed("id", "seq")
    lists = count_windows(df, ["seq"], size=200, keep=F.col("seq") % 50 == 0, collect=True).orderBy("window_no")
    got = [(r.window_no, [x.seq for x in r.rows]) for r in lists.collect()]
    assert got == [(0, [0, 50, 100, 150]), (1, [200, 250, 300, 350])]
