import json
import os

import pytest

from textpulse import fixed, schemas
from textpulse.sinks.publish import json_payload, publish_json
from textpulse.sources.records import blacklist, file_source, kafka_options, parse_records, word_list


def test_word_list_file_and_missing_file(spark, tmp_dir):
    path = os.path.join(tmp_dir, "words.txt")
    with open(path, "w", encoding="utf-8") as f:
        f.write("好的\nbad\n\nbad\n")
    assert sorted(r.word for r in word_list(spark, path).collect()) == ["bad", "好的"]
    assert word_list(spark, os.path.join(tmp_dir, "missing.txt")).count() == 0
    assert sorted(r.word for r in blacklist(spark).collect()) == sorted(fixed.BLACKLIST_WORDS)


def test_kafka_options():
    assert kafka_options("Word_Count", "b:9092", start="earliest")["startingOffsets"] == "earliest"
    opts = kafka_options("user_info", "b:9092", group_id="g")
    assert opts["subscribe"] == "user_info" and opts["kafka.group.id"] == "g"
    with pytest.raises(ValueError):
        kafka_options("t", "b", start="yesterday")


def test_failfast_mode_raises_on_malformed(spark):
    raw = spark.createDataFrame([("{bad",)], "value STRING")
    good, _ = parse_records(raw, schemas.VIDEO_RECORD, mode="FAILFAST")
    with pytest.raises(Exception):
        good.collect()


def test_file_source_envelope_and_publish_round_trip(spark, tmp_dir):
    src = spark.createDataFrame([("av1", 3), ("av2", 4)], "av STRING, view BIGINT")
    out = os.path.join(tmp_dir, "out")
    publish_json(src, "av", "text", path=out)
    env = file_source(spark, out, stream=False)
    assert set(env.columns) >= {"key", "value", "topic", "offset"}
    back = sorted(json.loads(r.value)["view"] for r in env.collect())
    assert back == [3, 4]
    keys = sorted(r.key for r in json_payload(src, "av").collect())
    assert keys == ["av1", "av2"]


def test_scale_conf_sizes_partitions():
    from textpulse.session import scale_conf

    conf = scale_conf(100 * (1 << 40), cores=8000)  # 100 TiB
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * (1 << 40) // (256 << 20)
    assert scale_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"] == "16"


def test_jdbc_options_partitioned_read():
    from textpulse.sources.records import jdbc_options

    opts = jdbc_options("jdbc:mysql://db/x", "hot_word", "times_stamp", 0, 100, 4, {"user": "u"})
    assert opts["partitionColumn"] == "times_stamp" and opts["numPartitions"] == "4"
    assert opts["pushDownAggregate"] == "true" and opts["user"] == "u"
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "t", "c")
