import random

import numpy as np
from pyspark.sql import functions as F

from textpulse.llm.line_chunks import Chunking, Lines, dedup_lines


def brute(rows, how=Chunking()):
    """Text left of each row: every anchor against its first occurrence (by id, then text key
    order), grown while the bytes of the lines around are equal; short runs stay."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    keys = {t: k for t, k in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t")).collect()}
    first = {}
    for i, t in {(i, t or "") for i, t in rows}:
        lines = t.split("\n")
        found = Lines([x.encode() for x in lines], how)
        body = [lines[k] for k in found.filled]
        for c in found.anchors():
            place = ((i is None, i or 0, keys[t], c.at), body, c)
            own = tuple(body[c.at - c.size + 1 : c.at + 1])
            if own not in first or place[0] < first[own][0]:
                first[own] = place
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        found = Lines([x.encode() for x in lines], how)
        body, covered, joined = [lines[k] for k in found.filled], set(), set()
        for c in found.anchors():
            place, there, f = first[tuple(body[c.at - c.size + 1 : c.at + 1])]
            if place == (i is None, i or 0, keys[t or ""], c.at):
                continue
            mine = [c.at - k for k in range(c.size)]
            for around, other in ((c.before, f.before), (c.after, f.after)):
                for x, y in zip(around, other):
                    if body[x] != there[y]:
                        break
                    mine.append(x)
            covered |= set(mine)
            joined |= {x for x in mine if x + 1 in mine}  # x and x + 1 lie in one match
        gone, run = set(), []
        for x in [*sorted(covered), None]:
            if run and (x is None or run[-1] not in joined or x != run[-1] + 1):
                if sum(len(body[k].split()) for k in run) >= how.min_words:
                    gone |= {n for k in run for n in range(found.starts[k], found.starts[k + 1])}
                run = []
            run.append(x)
        out.append((str(i), t if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    shared = ["\n".join(f"shared {p} line {k}" for k in range(rng.randrange(6, 14))) for p in range(4)]
    rows = []
    for i in range(40):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else "\n".join(f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 8))))
        rows.append((i, ("\n\n" if i % 3 else "\n").join(parts)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "single line"), (104, "single line"), (3, rows[3][1]), (200, rows[3][1]), (None, shared[0])], shared


def test_equals_brute_force(frame):
    rows, _ = corpus()
    got = dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text").collect()
    assert sorted(((str(r.i), r.text) for r in got), key=str) == brute(rows)


def test_boundaries_are_shift_resistant():
    rng = random.Random(1)
    passage = [f"line {k} {rng.random()}".encode() for k in range(60)]
    alone = set(Lines(passage, Chunking()).cuts)
    moved = {n - 5 for n in Lines([f"new {k}".encode() for k in range(5)] + passage, Chunking()).cuts if n >= 6}
    assert len(alone) < 30 and alone == moved - {0}


def test_passages_of_over_50_words_hold_a_boundary():
    rng = random.Random(4)
    held = total = 0
    for size in range(2, 13):
        for p in range(300):
            lines = [" ".join(f"w{rng.random()}" for _ in range(-(-51 // size))).encode() for _ in range(size)]
            held += bool(Lines(lines, Chunking()).anchors())
            total += 1
    assert held >= 0.95 * total


def test_shared_passage_goes_from_later_documents_and_unique_lines_stay(frame):
    passage = "\n".join(f"boilerplate {k} of a page" for k in range(30))
    rows = [(i, f"start {i}\n{passage}\nend {i}") for i in range(5)]
    left = {r.i: (r.text, r.n_removed_lines) for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text", "n_removed_lines").collect()}
    assert left[0] == (rows[0][1], 0)
    for i in range(1, 5):
        assert f"start {i}" in left[i][0] and f"end {i}" in left[i][0] and left[i][1] >= 24


def test_emptied_documents_and_empty_table(frame):
    text = "\n".join(f"copy {k} of a line with some words" for k in range(20)) + "\n"
    rows = [(1, text), (2, text), (3, "")]
    left = {r.i: r.text for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text").collect()}
    kept = {r.i for r in dedup_lines(frame(rows), keep_emptied=False).select(F.col("row.doc_id").alias("i")).collect()}
    assert left[1] == text and kept >= {1, 3} and (2 in kept) == bool(left[2].strip())
    assert dedup_lines(frame(rows).limit(0)).count() == 0


def test_long_texts_have_bounded_chunks():
    assert max(b - a for a, b in Lines([b"same"] * 5000, Chunking()).chunks()) <= 64


def test_short_repeats_stay(frame):
    chorus = "la la la la\nand so it goes"
    rows = [(k, f"verse {k} one\n{chorus}\nverse {k} two\n{chorus}\n}}\n}}") for k in range(6)]
    assert {(r.i, r.text) for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text").collect()} == set(rows)


def test_short_passages_between_foreign_lines_go_whole(frame):
    for size in range(2, 7):
        passages = [[f"passage {p} line {k} " + " ".join(f"w{p}{k}{n}" for n in range(28)) for k in range(size)] for p in range(12)]
        rows = [(100 * c + p, "\n".join([f"before {c} {p}", *passage, f"after {c} {p}"])) for p, passage in enumerate(passages) for c in range(3)]
        left = {r.i: r.text for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text").collect()}
        assert left == {i: t if i < 100 else "\n".join((t.split("\n")[0], t.split("\n")[-1])) for i, t in rows}


def test_every_line_stays_once(frame):
    rng = random.Random(5)
    rows = [(i, "\n".join(f"line {rng.randrange(12)}" for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    left = dedup_lines(frame(rows)).select("text").collect()
    assert {x for _, t in rows for x in t.split("\n")} == {x for r in left for x in r.text.split("\n") if x}


def test_lines_whose_digests_clash_stay(frame, monkeypatch):
    from textpulse.llm import line_chunks

    lines = [" ".join(f"copied{k}x{n}" for n in range(30)) for k in range(6)]
    text = "\n".join(lines)
    monkeypatch.setattr(line_chunks, "clashing_digests", lambda *_: [line_chunks._digest(lines[3].encode())])
    left = {r.i: r.text for r in dedup_lines(frame([(1, text), (2, text)])).select(F.col("row.doc_id").alias("i"), "text").collect()}
    assert left == {1: text, 2: lines[3]}


def test_a_long_line_repeated_across_documents_goes(frame):
    long = " ".join(f"word{k}" for k in range(51))
    short = " ".join(f"term{k}" for k in range(50))
    rows = [(i, f"before {i}\n{long}\nbetween {i}\n{short}\nafter {i}") for i in range(4)]
    left = {r.i: (r.text, r.n_removed_lines) for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text", "n_removed_lines").collect()}
    assert left == {0: (rows[0][1], 0)} | {i: (f"before {i}\nbetween {i}\n{short}\nafter {i}", 1) for i in range(1, 4)}


def test_lines_of_equal_digest_and_other_bytes_are_found(frame, monkeypatch):
    from textpulse.llm import line_chunks

    rows = [(1, "aa 1\nbb 2"), (2, "aa 3\ncc 4"), (3, "cc 4\n\n")]
    assert line_chunks.clashing_digests(frame(rows)) == []
    monkeypatch.setattr(line_chunks, "_digest", lambda line: line[:2])
    assert line_chunks.clashing_digests(frame(rows)) == [b"aa"]
    bits = np.zeros(1 << (line_chunks.MAP_BITS - 6), np.int64)
    assert line_chunks.clashing_digests(frame(rows), "text", bits) == []
    bit = int.from_bytes(b"aa") >> (32 - line_chunks.MAP_BITS)
    bits[bit >> 6] = np.int64(1) << (bit & 63)
    assert line_chunks.clashing_digests(frame(rows), "text", bits) == [b"aa"]


def test_lines_of_one_digest_stay_by_the_whole_run(frame, monkeypatch):
    """Digests that clash: no line goes that has no equal line elsewhere."""
    from textpulse.llm import line_chunks

    digest = line_chunks._digest
    monkeypatch.setattr(line_chunks, "_digest", lambda line: digest(b"1" if line.startswith(b"odd") else line))
    same = "\n".join(" ".join(f"same{k}x{n}" for n in range(30)) for k in range(3))
    rows = [(k, f"odd {k} " + "word " * 60 + "\n" + same) for k in range(3)]
    left = {r.i: r.text for r in dedup_lines(frame(rows)).select(F.col("row.doc_id").alias("i"), "text").collect()}
    assert left == {0: rows[0][1]} | {k: rows[k][1].split("\n")[0] for k in (1, 2)}
