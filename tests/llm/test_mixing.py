import re
from collections import defaultdict

import pytest

from textpulse.llm.mixing import mix_sources, water_fill, write_out_mix


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes, pattern=(5, 2, 1), epochs=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: pattern[k % len(pattern)] for k, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in clamped]
        left, w = total - sum(clamped.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] > epochs * sizes[s] * w]
        if not over:
            return {s: float(clamped[s]) if s in clamped else left * weight[s] / w for s in order}
        clamped |= {s: epochs * sizes[s] for s in over}


@pytest.fixture()
def corpus(spark):
    def make(rows, parts=4):
        return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, target string, key string, `_source` string, row string").repartition(parts)

    return make


def document(i, n, source):
    return (i, " ".join(f"w{k}" for k in range(n)) if n is not None else None, source, "x", "y", "z", "s", "r")


def rows_of(sizes):
    """Sources of different sizes, in documents of 1 to 40 words."""
    out, i = [], 0
    for source, n in sizes.items():
        while n > 0:
            take = min(n, 1 + (i * 7) % 40)
            out.append(document(i, take, source))
            i, n = i + 1, n - take
    return out


@pytest.mark.parametrize("sizes", [{"a": 900, "b": 900, "c": 900}, {"a": 30, "b": 4000, "c": 500, None: 60, "ä": 10, "Z": 1}, {"hot": 3000, "x": 1, "y": 2}, {"one": 77}])
def test_targets_and_taken_words(corpus, sizes):
    got = mix_sources(corpus(rows_of(sizes))).collect()
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-12) and r.source_size == sizes[r.source]
        assert r.taken == r.size * r.repeats <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20  # half of the longest document


def test_same_mix_from_other_partitions_and_another_seed_differs(corpus):
    rows = rows_of({"a": 700, "b": 2500, "c": 400})
    mixes = [sorted((r.doc_id, r.repeats) for r in mix_sources(corpus(rows, parts), seed=seed).collect()) for parts, seed in ((1, 1), (7, 1), (3, 2))]
    assert mixes[0] == mixes[1] != mixes[2]


def test_nulls_copies_and_empty_tables(corpus):
    rows = [document(1, None, "a"), document(2, 0, "a"), document(None, 5, None), document(None, 6, None), document(3, 8, "b"), document(3, 8, "b"), document(4, None, "empty")]
    got = mix_sources(corpus(rows)).collect()
    assert len(got) == len(rows) and {r.taken for r in got if r.size == 0} == {0}
    assert {r.target for r in got if r.source in ("a", "empty")} == {0.0}
    assert len({r.repeats for r in got if r.doc_id == 3}) == 1
    assert mix_sources(corpus(rows).limit(0)).count() == 0
    assert {r.taken for r in mix_sources(corpus([document(1, None, None)])).collect()} == {0}


def test_weights_from_a_table(spark, corpus):
    weights = spark.createDataFrame([("a", 1), (None, 1)], "source string, weight int")
    got = {r.source: r.target for r in mix_sources(corpus(rows_of({"a": 100, None: 300})), weights).collect()}
    assert got == {"a": 200.0, None: 200.0}


def test_many_rounds_of_clamping(spark):
    sizes = {f"s{k:02}": 4**k for k in range(20)}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, weight long")
    got = {r.source: r.target for r in water_fill(table).collect()}
    assert got == pytest.approx(brute_targets(sizes, (1,)), rel=1e-12)


def test_mix_is_written_out(corpus):
    docs = corpus(rows_of({"a": 60, "b": 900, "c": 300}))
    mixed = mix_sources(docs)
    out = write_out_mix(docs, mixed)
    assert out.columns == docs.columns
    count = defaultdict(int)
    for r in out.collect():
        count[r.doc_id] += 1
    assert dict(count) == {r.doc_id: r.repeats for r in mixed.collect() if r.repeats}
