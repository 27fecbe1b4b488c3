import hashlib
import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textpulse.llm.bpe import encode_documents, load_bpe
from textpulse.llm.token_counts import Counter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "it's we'll 're x''s  y\n\n z \t", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "héllo wörld 中文字 😀", "\x1c\x1d a\x85b　c", "0123456789" * 3000, "ab" * 4000, " " * 5000 + "x", "the quick brown fox " * 3000]


def random_texts(n):
    rng = random.Random(5)
    pool = "ab c'stremvlld  0129\n\t\r\x0b\x1c\x85\xa0　éß中😀·!?''s're'll"
    return ["".join(rng.choice(pool) if rng.random() < 0.9 else chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(0, 90))) + "<|endoftext|>" * (rng.random() < 0.1) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_and_counts_equal_the_library_on_random_texts(library):
    texts = random_texts(1500)
    bpe, counter = load_bpe(PATH).compile(), Counter(load_bpe(PATH))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [ids for ids, _ in bpe.encode(texts)]
    assert got == want
    assert [bpe.decode(ids) for ids in got] == [library.decode(ids, skip_special_tokens=False) for ids in want]
    assert counter.totals(texts).tolist() == [len(ids) for ids in want]


def test_full_caches_change_nothing(library, monkeypatch):
    import textpulse.llm.bpe as b
    import textpulse.llm.token_counts as c

    monkeypatch.setattr(b, "MAX_WORDS", 5)
    monkeypatch.setattr(b, "MAX_PAIRS", 7)
    monkeypatch.setattr(c, "MAX_WORDS", 3)
    monkeypatch.setattr(c, "MAX_STATES", 10)
    texts = random_texts(60)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    bpe = load_bpe(PATH).compile()
    assert [ids for t in texts for ids, _ in bpe.encode([t])] == want
    assert Counter(load_bpe(PATH)).totals(texts).tolist() == [len(x) for x in want]


def test_documents(spark, frame, library):
    rows = list(enumerate(TEXTS)) + [(3, "a"), (None, "null id")]
    docs = frame(rows)
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in encode_documents(docs, PATH).collect()}
    want, sizes = set(), []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.add((i, len(ids), *digest))
        sizes.append((i, len((t or "").encode()), len(ids), len(ids) > 512))
    assert got == want
    counted = [tuple(r) for r in token_counts(docs, PATH, 512).collect()]
    assert sorted(counted, key=str) == sorted(sizes, key=str)
    empty = docs.limit(0)
    assert encode_documents(empty, PATH).count() == 0 and token_counts(empty, PATH, 512).count() == 0


def test_ids_column(frame, library):
    r = encode_documents(frame([(1, "hello world")]), PATH, with_ids=True).first()
    assert r.ids == library.encode("hello world").ids


def test_unsupported_tokenizer_is_refused():
    with pytest.raises(ValueError):
        load_bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_states_are_bounded_inside_one_word(monkeypatch):
    from textpulse.llm import token_counts as module

    rng = random.Random(11)
    bpe = load_bpe(PATH).compile()
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    free = module.CountTransducer(bpe)
    want = free.count(word)
    monkeypatch.setattr(module, "MAX_STATES", 5000)
    bounded = module.CountTransducer(bpe)
    assert bounded.count(word) == want == len(Tokenizer.from_file(PATH).encode(word, add_special_tokens=False).ids)
    assert len(bounded.states) <= 5002 < len(free.states)


@pytest.mark.parametrize("setting", ["dropout", "byte_fallback", "ignore_merges", "end_of_word_suffix", "lstrip", "single_word", "decoder", "normalizer"])
def test_settings_that_would_change_the_result_are_refused(setting, tmp_path):
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    if setting == "decoder":
        spec["decoder"] = None
    elif setting == "normalizer":
        spec["normalizer"] = {"type": "NFC"}
    elif setting in ("lstrip", "single_word"):
        spec["added_tokens"][0][setting] = True
    else:
        spec["model"][setting] = {"dropout": 0.1, "end_of_word_suffix": "</w>"}.get(setting, True)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        load_bpe(str(path))
