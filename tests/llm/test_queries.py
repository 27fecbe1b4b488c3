"""The registered queries that SQL cannot express, on a whole small table against brute force."""

import hashlib

import duckdb
import pytest
import test_line_chunks
import test_pii
import test_simhash
import test_url_rules
from tokenizers import Tokenizer

import __spark_entry__
from textpulse.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()


def run(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encoding_and_counts(spark, documents):
    library = Tokenizer.from_file(tokenizer_path())
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in documents}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op10_bpe")}
    assert got == {i: (len(ids[i]), sha(",".join(map(str, ids[i]))), sha(library.decode(ids[i], skip_special_tokens=False))) for i, _ in documents}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op8_token_counts")}
    assert counts == {i: (len((t or "").encode()), len(ids[i]), len(ids[i]) > 512) for i, t in documents}


def test_near_duplicates(spark, documents):
    fps = [test_simhash.brute_fp(t) for _, t in documents]
    root = test_simhash.brute_groups(fps)
    least = {}
    for (i, _), r in zip(documents, root, strict=True):
        least[r] = min(least.get(r, i), i)
    want = {i: (f"{fp:016x}", least[r]) for (i, _), fp, r in zip(documents, fps, root, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in run(spark, "op7_simhash")} == want


def test_line_dedup(spark, documents):
    want = {i: sha(t or "") for i, t in test_line_chunks.brute(documents)}
    assert {str(r.doc_id): r.text_sha256 for r in run(spark, "op3_line_chunks")} == want


def test_personal_data(spark, documents):
    got = {r.doc_id: r for r in run(spark, "op5_personal_data")}
    for i, t in documents:
        base = test_pii.brute(t)
        listed = [f"{k}:{a}:{b}" for k in test_pii.PATTERNS for a, b in base[k]]
        assert got[i].base_sha256 == sha(",".join(listed)) and set(listed) <= set(filter(None, got[i].spans.split(",")))


def test_urls(spark):
    pages = duckdb.sql(f"select page_id, url from '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in run(spark, "op1_url_rules")}
    assert len(got) == len(pages)
    for i, url in pages:
        host, path, rule, verdict = test_url_rules.brute(url)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.mined_rule else "allow"))
