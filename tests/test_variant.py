import json

from pyspark.sql import functions as F

from textpulse import schemas
from textpulse.operators.shape import explode_messages
from textpulse.sources.records import parse_records
from textpulse.sources.variant import variant_fields, variant_messages, variant_records

RECORD = {"av": "av1", "bullet_screen": [{"p": 1, "bullet": {"u": {"10": "hi", "x": "no second"}, "v": {}}}, {"p": 2, "bullet": {}}, {"p": 3, "bullet": {"w": {"11": "[tag]"}}}],
          "replies": [{"time": 5, "name": "n", "message": "m", "like": 1}, {"time": 6, "name": None, "message": None}], "title": "t"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, values):
    return spark.createDataFrame([(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)], "id long, value string")


def test_messages_equal_those_of_typed_records(spark):
    df = table(spark, [RECORD, {**RECORD, "av": "av2", "replies": []}, {"av": "av3"}, {"av": "av4", "bullet_screen": None, "replies": None}])
    typed, _ = parse_records(df, schemas.VIDEO_RECORD)
    free, bad = variant_records(df)
    assert bad.count() == 0
    columns = ["id", "av", "origin", "sender", "sec", "text"]
    for special in ("bullet", None):
        want = rows(explode_messages(typed, keep=["id"], drop_special=special).select(*columns))
        assert rows(variant_messages(free, keep=["id"], drop_special=special is not None).select(*columns)) == want and want


def test_fields_of_other_types_do_not_fail_a_record(spark):
    odd = {**RECORD, "bullet_screen": "none", "replies": [{"time": "soon", "name": 7, "message": ["x"]}, 3, {"message": 4.5}], "new": {"a": [1, "b"]}}
    free, bad = variant_records(table(spark, [odd, "{broken", "[1]", None, "{}", '{"av":null}', '"text"']))
    assert sorted((r.id, r.reason) for r in bad.collect()) == [(1, "malformed"), (2, "empty"), (3, "malformed"), (4, "empty"), (5, "empty"), (6, "empty")]
    got = variant_messages(free).collect()
    assert sorted((str(r.sender), str(r.sec), str(r.text)) for r in got) == [("7", "None", '["x"]'), ("None", "None", "4.5"), ("None", "None", "None")]
    unknown = variant_fields(free, [f.name for f in schemas.VIDEO_RECORD.fields], ["av"]).collect()
    assert [(r.av, r.field, json.loads(r.json)) for r in unknown] == [("av1", "new", {"a": [1, "b"]})] and "OBJECT" in unknown[0].kind


def test_changing_types_and_empty_tables(spark):
    free, _ = variant_records(table(spark, [{"av": str(k), "x": v} for k, v in enumerate([1, "a", None, [1], 1.5, True])]))
    kinds = {r.av: r.kind for r in variant_fields(free, ["av"], ["av"]).collect()}
    assert kinds["0"] == "BIGINT" and kinds["1"] == "STRING" and kinds["3"] == "ARRAY<BIGINT>" and len(kinds) == 6
    none = table(spark, [RECORD]).where(F.lit(False))
    assert variant_messages(variant_records(none)[0]).count() == 0
