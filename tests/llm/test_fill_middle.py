import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textpulse.llm.fill_middle import MAX_CHUNK, MIN_CHUNK, ChunkMemory, chunk_ends, cut_places, fill_in_middle, restore, transform_text


def brute(doc_id, text, seed=1):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts():
    rng = random.Random(4)
    out = [None, "", "a", "<P>", "x <M> y", "<", "<S", "P>", "é", "中" * 3000, "a" * 20000, "ab " * 5000, "\n\n\r\n", "😀é a" * 900, "<<S<P" * 700]
    for size in (5, 80, 600, 9000):
        out += ["".join(rng.choice("ab Zé中😀\n.<P>") for _ in range(rng.randrange(size))) for _ in range(12)]
        out += ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(size))) for _ in range(12)]
    return out


def test_outputs_equal_brute_force():
    memory = ChunkMemory()
    for i, text in enumerate(texts()):
        n, form, prefix, middle, output = transform_text((text or "").encode(), memory, i)
        assert (n, form, prefix, middle, output.decode()) == brute(i, text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé中 <>PSM\n😀", max_size=400), st.integers(0, 1 << 32), st.integers(0, 1 << 32))
def test_cuts_of_any_text(text, h1, h2):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, places = cut_places(text.encode(), ChunkMemory(), (h1, h2))
    parts = ["".join(units[:k]) for k in sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))]
    assert n == len(units) and places == [(len(p.encode()), len(p)) for p in parts]


def test_chunks_follow_the_content():
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh é中\n") for _ in range(20000))
    for text in texts():
        data = (text or "").encode()
        ends = chunk_ends(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
        assert all(b - a <= MAX_CHUNK for a, b in zip([0, *ends][: len(ends)], ends, strict=True))
        for a, b in zip([0, *ends][: len(ends)], ends, strict=True):
            data[a:b].decode()
    memory = ChunkMemory()
    cut_places(passage.encode(), memory, (0, 0))
    alone = memory.worked_out
    cut_places(("another beginning " + passage + " and end").encode(), memory, (1, 2))
    assert alone > 20 and memory.worked_out - alone <= 4  # only the chunks at the edges are new
    assert MIN_CHUNK < len(passage.encode()) / alone


def test_memory_is_bounded_and_full_memory_changes_nothing():
    memory = ChunkMemory(limit=2000)
    for i, text in enumerate(texts()):
        assert transform_text((text or "").encode(), memory, i)[4].decode() == brute(i, text)[4]
        assert memory.held <= 2000 + MAX_CHUNK + 100


def test_operator_over_a_table(frame):
    rows = [*enumerate(texts()), (None, "null id"), (7, "twice"), (7, "twice"), (-3, "minus three")]
    docs = frame(rows)
    out = fill_in_middle(docs).select("*", restore(F.col("form"), F.col("output")).alias("back"))
    got = sorted((str(r.doc_id), r.n, r.form, str(r.prefix_chars), str(r.middle_chars), r.output, r.back) for r in out.collect())
    want = [(i, *brute(i, t), t or "") for i, t in rows]
    assert got == sorted((str(i), n, f, str(p), str(m), o, t) for i, n, f, p, m, o, t in want)
    assert fill_in_middle(docs.limit(0)).count() == 0

