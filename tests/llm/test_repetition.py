import random
import re

import numpy as np

from textpulse.llm.repetition import Limits, keep_good, measure, repetition_report, verdicts
from textpulse.llm.suffix import SuffixArray, repeat_lengths, word_groups


def brute(text, limits=Limits()):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)

    def repeats(width):
        seen = {}
        for i in range(n - width + 1):
            seen.setdefault(tuple(words[i : i + width]), []).append(i)
        return {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)}

    longest = max((w for w in range(3, n) if repeats(w)), default=0)
    m = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeats(3)), "n_covered": len(repeats(limits.min_repeat)), "longest_repeat": longest}
    failed = n < 50 or 100 * m["n_repeat_words"] > 50 * n
    kept = not failed and 100 * m["n_covered"] <= limits.max_covered_percent * n and not (longest > limits.max_repeat_words and 100 * longest > limits.max_repeat_percent * n)
    return {**m, "base_failed": failed, "kept": kept}


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "one", "a a a a a a a a a a", "x # $ <b> | &\n\nx\nx \n", "é ß 中 " * 30]
    for size in (2, 4, 30):
        for _ in range(25):
            out.append(" ".join(rng.choice(["a", "bb", "c\n", "d", "é"] + [f"w{k}" for k in range(size)]) for _ in range(rng.randrange(0, 90))))
    passage = " ".join(f"p{k}" for k in range(130))
    out += [f"{passage} middle {passage} end", " ".join(f"u{k}" for k in range(200)), "word " * 30000]
    return out


def test_measures_equal_brute_force():
    all_texts = texts()[:-1]
    m = measure([(t or "").encode() for t in all_texts], Limits().min_repeat)
    for k, t in enumerate(all_texts):
        want = brute(t)
        assert {f: int(m[f][k]) for f in m if f in want} == {f: v for f, v in want.items() if f in m}, t


def test_report_and_filter(frame):
    rows = list(enumerate(texts()[:-1])) + [(None, "null id"), (3, "one")]
    docs = frame(rows)
    report = repetition_report(docs)
    want = sorted((str(i), *brute(t).values()) for i, t in rows)
    names = list(brute("").keys())
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in report.collect()) == want
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, t in rows if brute(t)["kept"])
    assert keep_good(docs.limit(0)).count() == 0


def test_method_rejects_one_long_repeat_that_the_base_rule_lets_pass():
    passage = " ".join(f"p{k}" for k in range(220))
    text = passage + " " + " ".join(f"u{k}" for k in range(1400)) + " " + passage
    m = measure([text.encode()], 10)
    failed, kept = verdicts(m, Limits())
    assert m["longest_repeat"][0] == 220 and m["n_covered"][0] < 0.3 * m["n_words"][0] and not failed[0] and not kept[0]
    scattered = " ".join(" ".join(f"{w}{k}" for w in "abcdefghijkl") + f" x{k} y{k} " * (k % 3) for k in [*range(40), *range(20)])
    m = measure([scattered.encode()], 10)
    failed, kept = verdicts(m, Limits())
    assert m["longest_repeat"][0] < 300 and not kept[0]


def test_one_long_repeat_rejects_a_text_of_any_length(frame):
    def text(size, words=20_000):
        passage = " ".join(f"p{k}" for k in range(size))
        return passage + " " + " ".join(f"u{k}" for k in range(words)) + " " + passage

    docs = frame([(1, text(120)), (2, text(101)), (3, text(100)), (4, text(0)), (5, text(60, 1500))])
    report = {r.doc_id: (r.base_failed, r.kept, r.longest_repeat) for r in repetition_report(docs).collect()}
    assert report == {1: (False, False, 120), 2: (False, False, 101), 3: (False, True, 100), 4: (False, True, 0), 5: (False, True, 60)}


def test_very_repetitive_long_text_is_not_quadratic():
    m = measure([b"word " * 300_000], 10)
    assert m["longest_repeat"][0] == 299_999 and m["n_covered"][0] == 300_000


def test_suffix_array_search_equals_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        a = np.array([rng.choice([0, 1, 1, 2, 2, 3, 4]) for _ in range(rng.randrange(1, 60))] + [0])
        q = np.array([rng.choice([0, 1, 2, 2, 3, 5]) for _ in range(30)] + [0])
        size = np.zeros(31, int)
        for i in range(29, -1, -1):
            size[i] = size[i + 1] + 1 if q[i] else 0
        starts = np.flatnonzero(q)
        windows = np.minimum(size[starts], 3)
        best, where, lo, hi = SuffixArray(a, 31).search(q, starts, size[starts], windows)
        for k, s in enumerate(starts):
            match = [next((d for d in range(size[s] + 1) if d == size[s] or j + d >= len(a) or a[j + d] != q[s + d]), 0) for j in range(len(a))]
            assert best[k] == max(match) and hi[k] - lo[k] == sum(m >= windows[k] for m in match)
            assert best[k] == 0 or match[where[k]] == best[k]


def test_repeats_of_small_alphabets():
    rng = random.Random(6)
    for _ in range(80):
        a = np.array([rng.randrange(1, 3) for _ in range(rng.randrange(0, 40))] + [0])
        order, longest = repeat_lengths(a, *word_groups(a))
        got = dict(zip(order.tolist(), longest.tolist(), strict=True))
        for i in range(len(a)):
            runs = [next(d for d in range(len(a)) if i + d >= len(a) or j + d >= len(a) or a[i + d] != a[j + d] or not a[i + d]) for j in range(len(a)) if j != i]
            top = max(runs, default=0)
            assert got.get(i, 0) == (top if top >= 3 else 0)
