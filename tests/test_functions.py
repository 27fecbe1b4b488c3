
from textpulse.functions import bucket_ms, clean, crc32_of, day_of_ms, escaped_form, is_special, previous_day


def one(spark, expr, value, schema="v STRING"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_bucket_truncates_toward_zero(spark):
    assert one(spark, bucket_ms("v"), 1577836999, "v BIGINT") == 1577836800000
    assert one(spark, bucket_ms("v"), -1, "v BIGINT") == 0
    assert one(spark, bucket_ms("v"), -301, "v BIGINT") == -300000


def test_clean_strips_punctuation_symbols_separators(spark):
    text = 'a-b, c 你好！é $5 "x"\n\\n'
    assert one(spark, clean("v"), text) == "abc你好é5x\nn"
    assert one(spark, clean("v", strip_latin=True), "good 好, ok") == "好"


def test_special_message_predicate(spark):
    cases = {"[": False, "]": False, "[]": True, "[1,2]": True, "a[b]": False, "[x": False, "": False}
    for text, expected in cases.items():
        assert one(spark, is_special("v"), text) is expected, text


def test_escaped_form_keeps_json_escapes(spark):
    assert one(spark, escaped_form("v"), 'a"b\nc') == 'a\\"b\\nc'
    assert one(spark, clean(escaped_form("v")), "good\nnn av ok") == "goodnnnavok"


def test_crc32_unsigned(spark):
    assert one(spark, crc32_of("v"), "12345") == 3421846044
    assert format(3421846044, "08x") == "cbf53a1c"


def test_day_keys(spark):
    assert one(spark, day_of_ms("v"), 1704067199999, "v BIGINT") == "20231231"
    assert one(spark, day_of_ms("v"), 1704067200000, "v BIGINT") == "20240101"
    assert one(spark, previous_day("v"), "20240301") == "20240229"
