import base64
import hashlib

import pytest

from textpulse.llm.warc import archive_round_trip, read_archive, record_headers, write_archive

PAGES = [(5, "http://a/", "<p>x</p>", "e"), (2, "http://b/", "<p>x</p>", "e"), (9, None, "<p>x</p>", "e"), (1, "http://c/é", "", "e"), (4, "u", None, "e"), (7, "http://d/\r\nWARC-Type: fake", "é" * 100000, "e"), (2, "http://b/", "<p>x</p>", "e"), (None, "http://n/", "<p>x</p>", "e"), (None, "only null", "alone", "e")]
SCHEMA = "page_id long, url string, html string, digest string"


def want(pages):
    least = {}
    for i, _, h, _ in pages:
        least[h or ""] = min((x for x in (least.get(h or ""), i) if x is not None), default=None)
    out = []
    for i, _, h, _ in pages:
        body = (h or "").encode()
        first = least[h or ""]
        revisit = first is not None and i != first
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_dir):
    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(3)
    back = archive_round_trip(pages, f"{tmp_dir}/archive")
    got = sorted((tuple(r) for r in back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    assert got == want(PAGES)
    assert back.where("header_digest <> payload_digest").count() == 0
    stored = spark.read.parquet(f"{tmp_dir}/archive/payloads")
    assert stored.count() == len({h or "" for _, _, h, _ in PAGES})


def test_records_are_rebuilt_byte_for_byte(spark, tmp_dir):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    write_archive(pages, f"{tmp_dir}/archive")
    headers = sorted(r.header for r in record_headers(pages).collect())
    rows = read_archive(spark, f"{tmp_dir}/archive").collect()
    assert sorted(bytes(r.record).split(b"\r\n\r\n")[0].decode() + "\r\n\r\n" for r in rows) == headers
    for r in rows:
        body = b"" if r.record_type == "revisit" else bytes(r.payload)
        assert bytes(r.record).endswith(b"\r\n\r\n" + body + b"\r\n\r\n")
        assert f"Content-Length: {len(body)}\r\n".encode() in bytes(r.record)
    assert sorted(bytes(r.payload).decode() for r in rows) == sorted(h or "" for _, _, h, _ in PAGES)
    assert {r.url for r in rows if r.payload_bytes == 200000} == {"http://d/%0D%0AWARC-Type: fake"}


def test_small_payloads_are_not_shared_above_a_minimum(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    kinds = [r.header.split("WARC-Type: ")[1].split("\r")[0] for r in record_headers(pages, min_bytes=10).collect()]
    assert kinds.count("revisit") == 0


def test_a_damaged_payload_fails_the_read(spark, tmp_dir):
    import zlib

    from pyspark.sql import functions as F

    write_archive(spark.createDataFrame(PAGES[:1], SCHEMA), f"{tmp_dir}/a")
    spark.read.parquet(f"{tmp_dir}/a/payloads").withColumn("blob", F.lit(zlib.compress(b"other"))).write.parquet(f"{tmp_dir}/b/payloads")
    spark.read.parquet(f"{tmp_dir}/a/records").write.parquet(f"{tmp_dir}/b/records")
    with pytest.raises(Exception, match="does not match"):
        read_archive(spark, f"{tmp_dir}/b").collect()


def test_empty(spark, tmp_dir):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/empty").count() == 0


def test_identifiers_as_text(spark, tmp_dir):
    ids = ["", "a\r\nb", "50%0A", "<x>", None, "plain"]
    pages = spark.createDataFrame([(i, "u", "same", "e") for i in ids], "page_id string, url string, html string, digest string")
    back = archive_round_trip(pages, f"{tmp_dir}/ids").collect()
    assert sorted(map(str, (r.page_id for r in back))) == sorted(map(str, ids)) and {r.refers_to for r in back if r.record_type == "revisit"} == {""}


@pytest.mark.parametrize("wrong", [("Content-Length: 8", "Content-Length: 9"), ("sha1:", "sha1:A")])
def test_a_header_that_disagrees_fails_the_read(spark, tmp_dir, wrong):
    from pyspark.sql import functions as F

    write_archive(spark.createDataFrame(PAGES[:2], SCHEMA), f"{tmp_dir}/a")
    spark.read.parquet(f"{tmp_dir}/a/payloads").write.parquet(f"{tmp_dir}/b/payloads")
    spark.read.parquet(f"{tmp_dir}/a/records").withColumn("header", F.replace("header", F.lit(wrong[0]), F.lit(wrong[1]))).write.parquet(f"{tmp_dir}/b/records")
    with pytest.raises(Exception, match="header does not match"):
        read_archive(spark, f"{tmp_dir}/b", with_payload=False).collect()


def test_payloads_are_stored_once_whatever_their_compression(spark, monkeypatch):
    from textpulse.llm import warc

    pages = spark.createDataFrame(PAGES, SCHEMA).repartition(6)
    levels = {"n": 0}
    squeeze = warc.zlib.compress

    class Builds:
        decompress = staticmethod(warc.zlib.decompress)

        @staticmethod
        def compress(data):
            levels["n"] += 1
            import os

            return squeeze(data, 1 + os.getpid() % 9)

    monkeypatch.setattr(warc, "zlib", Builds)
    stored = warc.payload_store(pages).collect()
    assert len(stored) == len({h or "" for _, _, h, _ in PAGES}) == len({r.digest for r in stored})
