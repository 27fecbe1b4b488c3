import pytest
from pyspark.sql import functions as F

from textpulse.functions import set_json_field
from textpulse.sinks.store import TableStore

HOT = "day STRING, word STRING, count BIGINT"


def _sums(store, table="hot"):
    return {(r.day, r.word): r["count"] for r in store.accumulated(table, ["word"], "count").collect()}


def test_replays_and_two_streams(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    batch = lambda day, n: spark.createDataFrame([(day, "w", n)], HOT)
    store.accumulate(batch("d1", 3), "hot", ["word"], "count", 0)
    store.accumulate(batch("d1", 10), "hot", ["word"], "count", 0, stream="second")
    assert _sums(store) == {("d1", "w"): 13}
    store.accumulate(batch("d1", 3), "hot", ["word"], "count", 0)
    store.accumulate(batch("d2", 5), "hot", ["word"], "count", 1)
    store.accumulate(batch("d2", 5), "hot", ["word"], "count", 1)
    assert _sums(store) == {("d1", "w"): 13, ("d2", "w"): 5}
    assert sorted(r.day for r in store.list_days("hot").collect()) == ["d1", "d2"]
    with pytest.raises(ValueError):
        store.delete("hot", F.col("word") == "w")


def test_tables_are_listed_by_pattern(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    for name in ("hot_word_1", "hot_word_2", "other"):
        store.ensure_table(name, HOT)
    assert store.list_tables("hot_word*") == ["hot_word_1", "hot_word_2"] and store.exists("other") and not store.exists("none")


def test_rewrites_of_listed_days_leave_the_others(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    store.append(spark.createDataFrame([("d1", "w", 3), ("d1", "v", 1), ("d2", "w", 4)], HOT), "hot")
    store.update("hot", F.col("word") == "w", {"count": 9}, days=["d1"])
    assert {tuple(r) for r in store.read("hot").select("day", "word", "count").collect()} == {("d1", "w", 9), ("d1", "v", 1), ("d2", "w", 4)}
    store.delete("hot", F.lit(True), days=["d1"])
    assert [r.day for r in store.list_days("hot").collect()] == ["d2"]
    store.delete("hot", F.col("word") == "w")
    assert store.read("hot").count() == 0 and store.read("hot").columns == ["word", "count", "day"]


def test_upsert_by_the_callers_key_over_days(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    schema = "id STRING, data STRING, seq BIGINT, day STRING"
    store.replace(spark.createDataFrame([("a", "1", 1, "d1"), ("b", "1", 1, "d1")], schema), "raw", ["id"], "seq")
    store.replace(spark.createDataFrame([("a", "2", 2, "d2"), ("b", "0", 0, "d9"), (None, "n", 1, "d1")], schema), "raw", ["id"], "seq")
    assert {(r.id, r.data, r.day) for r in store.read("raw").collect()} == {("a", "2", "d2"), ("b", "1", "d1"), (None, "n", "d1")}
    assert {r.day for r in store.list_days("raw").collect()} == {"d1", "d2"}
    store.replace(spark.createDataFrame([("a", "9", 9, "d9")], schema), "raw", ["id"], "seq", keep="first")
    store.update_one("raw", F.col("day") == "d1", {"data": "one"}, "id")
    store.delete("raw", F.col("id").isNull())
    assert {(r.id, r.data) for r in store.read("raw").collect()} == {("a", "2"), ("b", "one")}


def test_upsert_by_id_on_an_appended_day_table(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    schema = "id STRING, seq BIGINT, day STRING"
    store.append(spark.createDataFrame([("a", 1, "d1"), ("b", 1, "d1"), ("c", 1, "d2")], schema), "t")
    store.replace(spark.createDataFrame([("a", 2, "d3"), ("c", 2, "d3")], schema), "t", ["id"], "seq")
    assert {(r.id, r.day) for r in store.read("t").collect()} == {("a", "d3"), ("b", "d1"), ("c", "d3")}
    assert sorted(r.day for r in store.list_days("t").collect()) == ["d1", "d3"]
    store.delete_one("t", F.col("day") == "d3", "id")
    assert {r.id for r in store.read("t").collect()} == {"b", "c"}


def test_an_empty_table_reads_and_keeps_its_schema(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    store.ensure_table("hot", HOT, accumulate=True)
    store.ensure_table("hot", HOT, accumulate=True)
    assert store.read("hot").count() == 0 and set(store.read("hot").columns) == {"day", "word", "count", "stream", "batch_id"}
    store.accumulate(spark.createDataFrame([("d1", "w", 3)], HOT), "hot", ["word"], "count", 0)
    assert store.exists("hot") and _sums(store) == {("d1", "w"): 3}
    with pytest.raises(ValueError):
        store.read("none")


def test_set_keeps_the_other_fields_types(spark):
    doc = '{"mid":1,"ok":true,"n":{"a":[1,2.50]},"s":"x\\"y","big":12345678901234567890}'
    row = spark.createDataFrame([(doc,)], "d STRING").select(
        set_json_field("d", "mid", 7).alias("i"), set_json_field("d", "new", "t\"q").alias("s"), set_json_field("d", "ok", F.lit(False)).alias("b"))
    r = row.first()
    import json
    base = json.loads(doc)
    assert json.loads(r.i) == {**base, "mid": 7} and json.loads(r.s) == {**base, "new": 't"q'} and json.loads(r.b) == {**base, "ok": False}
    assert "12345678901234567890" in r.i
