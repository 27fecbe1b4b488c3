from pyspark.sql import functions as F

from fixtures import RAW_LINES, REPLY_TEXT
from textpulse import schemas
from textpulse.functions import bucket_ms
from textpulse.operators.aggregate import hot_words, sentiment_counts
from textpulse.operators.lexicon import classify, drop_blacklisted, lexicon
from textpulse.operators.shape import explode_messages
from textpulse.operators.tokenize import tokenize
from textpulse.sources.records import blacklist, parse_records, word_values


def _records(spark):
    raw = spark.createDataFrame([(line,) for line in RAW_LINES], "value STRING")
    return parse_records(raw, schemas.VIDEO_RECORD)


def _messages(spark, **kw):
    good, _ = _records(spark)
    return explode_messages(good, **kw)


def test_quarantine_splits_empty_and_malformed(spark):
    good, bad = _records(spark)
    assert sorted(r.av for r in good.collect()) == ["av1", "av2"]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "malformed"]


def test_flatten_drops_special_bullets_only(spark):
    rows = sorted(tuple(r) for r in _messages(spark).select("av", "origin", "sec", "text").collect())
    assert rows == sorted([
        ("av1", "bullet", 1577836800, "good show, good"),
        ("av1", "bullet", 1577837100, "bad [end]"),
        ("av1", "reply", 1577837099, REPLY_TEXT),
        ("av1", "reply", 1577837100, "a"),
    ])


def _tokens(spark, **kw):
    msgs = _messages(spark).withColumn("bucket_ms", bucket_ms("sec"))
    return tokenize(msgs, keep=["av", "origin", "bucket_ms"], **kw)


def _counts(df):
    return {(r.bucket_ms, r.word): r.cnt for r in df.collect()}


def test_hot_words_golden(spark):
    toks = _tokens(spark, min_len=2)
    got = _counts(hot_words(toks, threshold=None))
    assert got == {
        (1577836800000, "av"): 1, (1577836800000, "good"): 3, (1577836800000, "nn"): 1,
        (1577836800000, "ok"): 1, (1577836800000, "show"): 1,
        (1577837100000, "bad"): 1, (1577837100000, "end"): 1,
    }
    filtered = drop_blacklisted(toks, blacklist(spark), scope="reply")
    got_bl = _counts(hot_words(filtered, threshold=None))
    assert got_bl == {
        (1577836800000, "good"): 3, (1577836800000, "ok"): 1, (1577836800000, "show"): 1,
        (1577837100000, "bad"): 1, (1577837100000, "end"): 1,
    }
    assert hot_words(toks, threshold=3).count() == 1
    assert hot_words(toks, threshold=3, op=">").count() == 0


def test_sentiment_golden(spark):
    toks = _tokens(spark)
    lex = lexicon(word_values(spark, ["bad"]), word_values(spark, ["good"]))
    got = {(r.bucket_ms, r.av, r.emotion): r.cnt for r in sentiment_counts(classify(toks, lex)).collect()}
    assert got == {
        (1577836800000, "av1", "positive"): 3, (1577836800000, "av1", "unknown"): 4,
        (1577837100000, "av1", "negative"): 1, (1577837100000, "av1", "unknown"): 2,
    }


def test_word_in_both_lists_is_negative(spark):
    lex = lexicon(word_values(spark, ["x"]), word_values(spark, ["x", "y"]))
    assert {r.word: r.polarity for r in lex.collect()} == {"x": "negative", "y": "positive"}


def test_sentiment_sums_to_token_count(spark):
    toks = _tokens(spark)
    lex = lexicon(word_values(spark, ["bad"]), word_values(spark, ["good"]))
    total = sentiment_counts(classify(toks, lex)).agg(F.sum("cnt")).first()[0]
    assert total == toks.count()


def test_escaped_mode_reproduces_escape_artefacts(spark):
    msgs = _messages(spark, escaped=True).where("origin = 'reply' AND sec = 1577837099")
    toks = tokenize(msgs, keep=["av"], mode="dictionary", dictionary=word_values(spark, ["good"]))
    assert [r.word for r in toks.orderBy("pos").collect()] == ["goodnnnavok"]


def test_duplicate_map_keys_last_wins(spark):
    raw = spark.createDataFrame(
        [('{"av":"a","bullet_screen":[{"p":1,"cid":1,"part":"x","bullet":{"s":{"1":"x","1":"y"}}}],"replies":[]}',)],
        "value STRING",
    )
    good, bad = parse_records(raw, schemas.VIDEO_RECORD)
    assert bad.count() == 0
    # nested maps keep both entries of a repeated key; dedupe=True applies the last-wins rule
    assert sorted(r.text for r in explode_messages(good).collect()) == ["x", "y"]
    assert [r.text for r in explode_messages(good, dedupe=True).collect()] == ["y"]


def test_dedupe_keeps_distinct_replies_and_records(spark):
    rec = ('{"av":"a","bullet_screen":[{"p":1,"cid":1,"part":"x","bullet":{"s":{"1":"x","1":"y","2":"z"}}}],'
           '"replies":[{"time":5,"name":"n","message":"same"},{"time":5,"name":"n","message":"same"}]}')
    raw = spark.createDataFrame([(rec,), (rec,)], "value STRING")
    good, _ = parse_records(raw, schemas.VIDEO_RECORD)
    rows = sorted((r.origin, r.text) for r in explode_messages(good, dedupe=True).collect())
    # per record: bullets y, z (x overwritten) and both identical replies; two records
    assert rows == sorted([("bullet", "y"), ("bullet", "z"), ("reply", "same"), ("reply", "same")] * 2)


def test_malformed_second_key_does_not_fail_the_job(spark):
    raw = spark.createDataFrame(
        [('{"av":"a","bullet_screen":[{"p":1,"cid":1,"part":"x","bullet":{"s":{"12x":"t","5":"u"}}}],"replies":[]}',)],
        "value STRING",
    )
    good, _ = parse_records(raw, schemas.VIDEO_RECORD)
    assert {r.text: r.sec for r in explode_messages(good).collect()} == {"u": 5, "t": None}


def test_ids_are_cleaned_on_request(spark):
    record = '{"av":"\\"av 1\\"","bullet_screen":[],"replies":[{"time":1,"name":"n","message":"m"}]}'
    good, _ = parse_records(spark.createDataFrame([(record,)], "value STRING"), schemas.VIDEO_RECORD)
    assert [r.av for r in explode_messages(good, clean_ids=True).collect()] == ["av1"]
    assert [r.av for r in explode_messages(good).collect()] == ['"av 1"']
