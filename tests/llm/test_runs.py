import random
import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from textpulse.llm.runs import Positions, find_runs, longest_run, periodic_runs, text_runs


def brute_runs(words, min_length=12):
    out = set()
    for period in range(1, len(words) // 2 + 1):
        start = 0
        while start + period < len(words):
            stop = start
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            length = stop + period - start
            if stop > start and length >= max(min_length, 2 * period):
                stretch = words[start : start + length]
                if not any(all(stretch[k] == stretch[k + q] for k in range(length - q)) for q in range(1, period)):
                    out.add((start, length, period))
            start = max(stop, start) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    return [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]


def texts():
    rng = random.Random(5)
    out = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 4 + "a y", " é 中 " * 12, "p q " * 20 + "z " + "p q " * 20]
    for letters in (1, 2, 3, 6):
        out += [" ".join(rng.choice("abcdefgh"[:letters]) for _ in range(rng.randrange(10, 90))) for _ in range(30)]
    for _ in range(20):  # periodic stretches between and inside each other
        unit = [rng.choice("abc") for _ in range(rng.randrange(1, 8))]
        inner = unit * rng.randrange(2, 7)
        out.append(" ".join((["s"] * rng.randrange(0, 3) + inner + [rng.choice("abc")]) * rng.randrange(1, 4) + unit))
    return out


def test_runs_and_collapsed_texts_equal_brute_force():
    every = texts()
    for text, (n, runs, collapsed) in zip(every, text_runs([(t or "").encode() for t in every]), strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert (n, runs) == (len(words), brute_runs(words)), text
        assert collapsed.decode() == " ".join(collapse(words, runs))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(2, 14))
def test_any_words_and_shortest_length(words, least):
    assert sorted(find_runs(np.array([*words, 0]), least), key=lambda r: (r[0], r[2])) == brute_runs(words, least)


def test_ordered_positions():
    rng = random.Random(1)
    values = rng.sample(range(100000), 5000)
    held = Positions(values[0])
    for v in values[1:]:
        held.add(v)
    ordered = sorted(values)
    assert list(held) == ordered and held.count == 5000
    assert [held.neighbours(v) for v in ordered] == list(zip([-1, *ordered[:-1]], [*ordered[1:], -1], strict=True))


def test_very_long_texts():
    start = time.time()
    assert text_runs([b"word " * 400000]) == [(400000, [(0, 400000, 1)], b"word")]
    unit = " ".join(f"u{k}" for k in range(5000))
    ((_, runs, _),) = text_runs([f"x {' '.join([unit] * 40)} y".encode()])
    assert runs == [(1, 200000, 5000)] and time.time() - start < 60


def test_operator_over_a_table(frame):
    rows = list(enumerate(texts())) + [(None, "a " * 13), (3, "one")]
    docs = frame(rows)
    got = periodic_runs(docs).select("doc_id", "n_words", "runs", longest_run("runs").alias("best"), "collapsed").collect()
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
        want.append((str(i), len(words), [tuple(r) for r in runs], best, " ".join(collapse(words, runs))))
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.best and tuple(r.best), r.collapsed) for r in got) == sorted(want, key=lambda w: (w[0], w[1], w[2], w[4]))
    assert periodic_runs(docs.limit(0)).count() == 0
