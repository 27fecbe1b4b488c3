from pyspark.sql import functions as F

from textpulse.operators.upsert import delete_first, delete_where, update_where, upsert_accumulate, upsert_replace
from textpulse.sinks.store import TableStore


def _docs(spark):
    return spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "c", 3)], "id STRING, data STRING, seq BIGINT")


def test_keep_last_and_first(spark):
    docs = _docs(spark)
    last = {r.id: r.data for r in upsert_replace(docs, ["id"], "seq").collect()}
    first = {r.id: r.data for r in upsert_replace(docs, ["id"], "seq", keep="first").collect()}
    assert last == {"u1": "b", "u2": "c"} and first == {"u1": "a", "u2": "c"}
    incoming = spark.createDataFrame([("u2", "d", 9)], "id STRING, data STRING, seq BIGINT")
    merged = {r.id: r.data for r in upsert_replace(incoming, ["id"], "seq", existing=docs).collect()}
    assert merged == {"u1": "b", "u2": "d"}


def test_update_delete(spark):
    docs = _docs(spark)
    upd = update_where(docs, F.col("id") == "u1", {"data": "z"})
    assert sorted(r.data for r in upd.collect()) == ["c", "z", "z"]
    assert delete_where(docs, F.col("id") == "u1").count() == 1
    assert sorted(r.seq for r in delete_first(docs, F.col("id") == "u1", "seq").collect()) == [2, 3]
    assert delete_first(docs, F.col("id") == "nobody", "seq").count() == 3


def test_accumulate_is_idempotent_per_batch(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    b0 = spark.createDataFrame([("20240101", "w", 3), ("20240101", "v", 1)], "day STRING, word STRING, count BIGINT")
    b1 = spark.createDataFrame([("20240101", "w", 2), ("20240102", "w", 5)], "day STRING, word STRING, count BIGINT")
    store.accumulate(b0, "hot_word", ["word"], "count", batch_id=0)
    store.accumulate(b1, "hot_word", ["word"], "count", batch_id=1)
    store.accumulate(b1, "hot_word", ["word"], "count", batch_id=1)  # replay
    got = {(r.day, r.word): r["count"] for r in store.accumulated("hot_word", ["word"], "count").collect()}
    assert got == {("20240101", "w"): 5, ("20240101", "v"): 1, ("20240102", "w"): 5}
    assert sorted(r.day for r in store.list_days("hot_word").collect()) == ["20240101", "20240102"]
    exp = upsert_accumulate(b1, ["day", "word"], "count", existing=b0.select("day", "word", "count"))
    assert {(r.day, r.word): r["count"] for r in exp.collect()} == got


def test_store_replace_update_delete(spark, tmp_dir):
    store = TableStore(spark, tmp_dir)
    schema = "id STRING, data STRING, seq BIGINT, day STRING"
    store.ensure_table("raw", schema)
    store.ensure_table("raw", schema)  # create-if-not-exists
    store.replace(spark.createDataFrame([("u1", "a", 1, "d1"), ("u2", "b", 2, "d2")], schema), "raw", ["id"], "seq")
    store.replace(spark.createDataFrame([("u1", "c", 5, "d1")], schema), "raw", ["id"], "seq")
    assert {r.id: r.data for r in store.read("raw").collect()} == {"u1": "c", "u2": "b"}
    store.update("raw", F.col("id") == "u2", {"data": "z"}, days=["d2"])
    assert {r.id: r.data for r in store.read("raw").collect()} == {"u1": "c", "u2": "z"}
    store.delete("raw", F.col("id") == "u2", days=["d2"])
    assert [r.id for r in store.read("raw").collect()] == ["u1"]
    top = store.scan("raw", columns=["id", "seq"], where=F.col("day") == "d1", order_by=[F.col("seq").desc()], limit=1)
    assert [tuple(r) for r in top.collect()] == [("u1", 5)]


def test_document_set_field_and_find(spark, tmp_dir):
    from textpulse.functions import set_json_field

    store = TableStore(spark, tmp_dir)
    docs = spark.createDataFrame([("1", '{"mid":"1","name":"a"}', 1, "d"), ("2", '{"mid":"2"}', 2, "d")],
                                 "id STRING, data STRING, seq BIGINT, day STRING")
    store.append(docs, "raw_documents")
    store.update("raw_documents", F.col("id") == "2", {"data": set_json_field("data", "name", "b")})
    got = {r.id: r.data for r in store.read("raw_documents").collect()}
    assert got == {"1": '{"mid":"1","name":"a"}', "2": '{"mid":"2","name":"b"}'}
    assert [r.id for r in store.find("raw_documents", "name", "b").collect()] == ["2"]
