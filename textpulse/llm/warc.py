"""Content-addressed web archive: every payload once, record headers apart, records by joins.

An archive is a folder with two Parquet tables:

* ``payloads`` (digest, blob): each distinct payload once, compressed, keyed by its SHA-256
  (equal keys are checked by length and a second digest of the bytes);
* ``records`` (page_id, digest, header): the exact header block of every WARC record.

Reading joins headers and payloads back into the original records and verifies each: payload
against its key, the header's length and digest against the bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.llm.text import as_bytes, id_type, slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least this many bytes are written once and revisited.
MIN_BYTES = 0


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: 10 hex digits are 40 bits are 8 base-32 digits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(name: str, value: Column) -> Column:
    """One header line; a null value gives none. Line ends inside a value are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))


_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))


def _record_id(page: Column) -> Column:
    """The record's URI; a null identifier has one of its own. Line ends are percent-encoded."""
    text = page.cast("string")
    for plain, escaped in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return F.coalesce(F.concat(F.lit("<urn:page:"), text, F.lit(">")), F.lit("<urn:no-page>"))


def _page_of(uri: Column, kind: str) -> Column:
    """The identifier in a record's URI; null if it has none."""
    text = F.regexp_extract(uri, r"(?s)^<urn:page:(.*)>$", 1)
    for plain, escaped in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return F.when(F.startswith(uri, F.lit("<urn:page:")), text).cast(kind)


def record_headers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, digest, header) of every page.

    Of the pages with equal payloads of at least ``min_bytes`` the one with the smallest
    identifier is the response and the others are revisits of it; rows that share that
    identifier are all responses. Without any identifier all are responses.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), base32_sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"))
    first = rows.groupBy("digest").agg(F.min("page_id").alias("first_id"))
    both = rows.join(first, "digest")
    revisit = (F.col("size") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_id")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit("\r\n"),
    )
    return both.select("page_id", "digest", header.alias("header"))


def payload_store(pages: DataFrame, payload_col: str = "html") -> DataFrame:
    """(digest, blob) of every distinct payload: null is empty.

    Payloads are grouped by their SHA-256; the group's length and BLAKE2 digest must agree, else
    the job fails. Copies meet within a slice and in the partial aggregation, so a payload that a
    third of the pages share is one row per task. The compressed bytes are no key: any
    compression of a payload will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            payloads = list(dict.fromkeys(as_bytes(batch.column(0))))
            digests = pa.array([hashlib.sha256(p).hexdigest() for p in payloads])
            checks = pa.array([f"{len(p)}:{hashlib.blake2b(p, digest_size=32).hexdigest()}" for p in payloads])
            yield pa.RecordBatch.from_arrays([digests, checks, pa.array([zlib.compress(p) for p in payloads], pa.binary())], ["digest", "check", "blob"])

    rows = pages.select(F.col(f"`{payload_col}`").cast("string")).mapInArrow(run, "digest string, check string, blob binary")
    one = rows.groupBy("digest").agg(F.min("blob").alias("blob"), F.min("check").alias("least"), F.max("check").alias("most"))
    clash = F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest")))
    return one.select("digest", F.when(F.col("least") == F.col("most"), F.col("blob")).otherwise(clash.cast("binary")).alias("blob"))


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """Write both tables of an archive below ``path`` (a folder that executors share)."""
    payload_store(pages, columns.get("payload_col", "html")).write.option("compression", "uncompressed").parquet(f"{path}/payloads")
    record_headers(pages, **columns).write.parquet(f"{path}/records")


def header_field(name: str) -> Column:
    """A header's value; null if the line is absent."""
    value = F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), value)


_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)\r\n")
_DIGEST = re.compile(rb"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n")
_REVISIT = b"\r\nWARC-Type: revisit\r\n"


def rebuild(digest: str, header: str, blob: bytes | None) -> tuple[bytes, str, bytes]:
    """(payload, its SHA-1, record) of one record; raises if any of its parts disagree."""
    if blob is None:
        raise ValueError(f"no stored payload for {digest}")
    payload = zlib.decompress(blob)
    if hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"stored payload does not match its digest {digest}")
    sha1 = base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()
    head = header.encode()
    block = b"" if _REVISIT in head else payload
    length, named = _LENGTH.search(head), _DIGEST.search(head)
    if length is None or int(length[1]) != len(block) or named is None or named[1].decode() != sha1:
        raise ValueError(f"a header does not match its payload {digest}")
    return payload, sha1, head + block + b"\r\n\r\n"


def read_archive(spark: SparkSession, path: str, with_payload: bool = True, id_kind: str = "bigint") -> DataFrame:
    """Every record, rebuilt and verified: the fields of its header and the size and digest of its
    payload's bytes. With ``with_payload`` also ``payload`` and ``record``, the original record's
    bytes (header block, block, two line ends; a revisit's block is empty, its payload comes by
    the join). The payloads are joined compressed.
    """
    names = ["header", "payload_bytes", "payload_digest", *(["payload", "record"] if with_payload else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 1 << 20):
            rows = [rebuild(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            columns = [batch.column(1), pa.array([len(p) for p, _, _ in rows], pa.int64()), pa.array([d for _, d, _ in rows])]
            if with_payload:
                columns += [pa.array([p for p, _, _ in rows], pa.binary()), pa.array([r for _, _, r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    records = spark.read.parquet(f"{path}/records").select("digest", "header")
    joined = records.join(spark.read.parquet(f"{path}/payloads"), "digest", "left").select("digest", "header", "blob")
    rebuilt = joined.mapInArrow(run, "header string, payload_bytes long, payload_digest string" + ", payload binary, record binary" * with_payload)
    return rebuilt.select(
        _page_of(header_field("WARC-Record-ID"), id_kind).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        header_field("WARC-Type").alias("record_type"),
        _page_of(header_field("WARC-Refers-To"), id_kind).alias("refers_to"),
        header_field("WARC-Target-URI").alias("url"),
        F.regexp_replace(header_field("WARC-Payload-Digest"), "^sha1:", "").alias("header_digest"),
        *(["payload", "record"] if with_payload else []),
    )


def archive_round_trip(pages: DataFrame, path: str, id_col: str = "page_id") -> DataFrame:
    """Write ``pages`` as an archive below ``path``, read its records back and rebuild each.

    One row per page. Null payloads are empty; a null url has no header line; null identifiers
    stay null, empty ones empty, and line ends in them come back; repeated rows are kept; an empty
    table gives an empty archive; other columns are not archived. A record whose header disagrees
    with its payload's bytes fails the read.
    """
    write_archive(pages, path, id_col=id_col)
    return read_archive(pages.sparkSession, path, with_payload=False, id_kind=id_type(pages, id_col))
