import math
import random
import time

from textpulse.operators import segment
from textpulse.operators.tokenize import tokenize
from textpulse.sources.records import word_values


def test_regex_mode_splits_on_punctuation_and_spaces(spark):
    df = spark.createDataFrame([("Hello, wörld 42 ça-va!",)], "text STRING")
    assert [r.word for r in tokenize(df).orderBy("pos").collect()] == ["Hello", "wörld", "42", "ça", "va"]
    assert [r.word for r in tokenize(df, min_len=3).orderBy("pos").collect()] == ["Hello", "wörld"]


def test_dictionary_mode_longest_match_with_single_char_fallback(spark):
    df = spark.createDataFrame([("我们喜欢这个视频，弹幕好看！ok99",)], "text STRING")
    dictionary = word_values(spark, ["我们", "喜欢", "这个", "视频", "弹幕", "好看", "视频弹幕"])
    got = [r.word for r in tokenize(df, mode="dictionary", dictionary=dictionary).orderBy("pos").collect()]
    # punctuation is stripped first, so 视频 and 弹幕 meet and the longer entry wins
    assert got == ["我们", "喜欢", "这个", "视频弹幕", "好看", "ok99"]
    unknown = spark.createDataFrame([("未知词",)], "text STRING")
    assert [r.word for r in tokenize(unknown, mode="dictionary", dictionary=dictionary).orderBy("pos").collect()] == [
        "未", "知", "词"]


def test_strip_latin_and_utf16_length(spark):
    df = spark.createDataFrame([("abc 好的 x1 𠀋a",)], "text STRING")
    assert [r.word for r in tokenize(df, strip_latin=True).orderBy("pos").collect()] == ["好的", "1", "𠀋"]
    # a supplementary character is one code point but two UTF-16 units
    assert [r.word for r in tokenize(df, strip_latin=True, min_len=2, utf16_length=True).orderBy("pos").collect()] == [
        "好的", "𠀋"]


def _brute(run, costs, unknown):
    """Every way to cut the run: least cost, then the longest last word at every place."""
    from functools import cache

    @cache
    def best(end):
        if not end:
            return 0, ()
        ways = [(best(end - 1)[0] + unknown, -1, 1)]
        ways += [(best(end - len(w))[0] + c, -len(w), len(w)) for w, c in costs.items() if run[:end].endswith(w)]
        cost, _, n = min(ways)
        return cost, (*best(end - n)[1], run[end - n : end])

    return list(best(len(run))[1])


def test_likeliest_words_equal_brute_force_in_both_forms(spark, monkeypatch):
    rng = random.Random(3)
    letters = "天地玄黄"
    counts = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))): rng.randrange(1, 40) for _ in range(25)}
    total = sum(counts.values())
    costs = {w: round(1000 * math.log(total / n)) for w, n in counts.items()}
    texts = ["".join(rng.choice(letters + "宇") for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "", "天 ok 地，9"])], "id long, text string")
    dictionary = spark.createDataFrame([*counts.items(), (None, 3), ("", 4), ("zero", 0)], "word string, n long")
    want = {i: _brute(t, costs, round(1000 * math.log(2 * total))) for i, t in enumerate(texts)}
    for bound in (segment.MAX_WORDS, 0):  # 0: the dictionary is joined, not broadcast
        monkeypatch.setattr(segment, "MAX_WORDS", bound)
        for mode in ("lattice", "dictionary"):
            got = {}
            for r in tokenize(df, mode=mode, dictionary=dictionary, keep=["id"]).orderBy("id", "pos").collect():
                got.setdefault(r.id, []).append(r.word)
            assert "".join(got[len(texts) + 2]) == "天ok地9" and len(texts) not in got and len(texts) + 1 not in got
            if mode == "lattice":
                assert {i: got[i] for i in want} == want
            else:
                assert all("".join(got[i]) == t for i, t in enumerate(texts))
                first = got if bound else first  # noqa: F821
                assert got == first


def test_time_is_linear_in_the_run():
    words = [("天", 500), ("天地", 700), ("地天地", 900), ("玄" * 1000, 10), ("玄黄", 300)]
    automaton, took = segment.Automaton(words), {}
    for n in (10_000, 100_000):
        run = "天地玄黄宇" * (n // 5)
        start = time.perf_counter()
        assert "".join(segment.likeliest(run, automaton.matches(run), 5000)) == run
        took[n] = time.perf_counter() - start
    assert took[100_000] < 30 * took[10_000] and took[100_000] < 5
    run = "玄" * 5000
    assert segment.likeliest(run, automaton.matches(run), 5000) == ["玄" * 1000] * 5


def test_empty_dictionary(spark):
    df = spark.createDataFrame([("天地",)], "text string")
    none = spark.createDataFrame([], "word string, n long")
    for mode in ("lattice", "dictionary"):
        assert [r.word for r in tokenize(df, mode=mode, dictionary=none).orderBy("pos").collect()] == ["天", "地"]


def test_segmenting_many_texts_holds_few_python_objects():
    import tracemalloc

    import pyarrow as pa

    from textpulse.operators import segment

    text = [{"run": f"天地{i % 50}", "segmented": i % 2 == 0} for i in range(300)]
    texts = pa.array([text] * 2_000, pa.list_(pa.struct([("run", pa.string()), ("segmented", pa.bool_())])))
    tracemalloc.start()
    got = segment._all_terms(texts, list)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = [t for p in text for t in (list(p["run"]) if p["segmented"] else [p["run"]])]
    assert len(got) == 2_000 and got[0].as_py() == want and got[1_999].as_py() == want
    assert peak < 60e6  # the runs as dicts alone are 600,000 of over 200 bytes


def test_pieces_of_a_batch_equal_the_whole(monkeypatch):
    import pyarrow as pa

    from textpulse.operators import segment

    kind = pa.list_(pa.struct([("run", pa.string()), ("segmented", pa.bool_())]))
    rows = [[("abc", True), ("xy", False)], None, [], [("xy", True), (None, False)], [("abc", True)]]
    texts = pa.array([None if r is None else [{"run": a, "segmented": b} for a, b in r] for r in rows], kind)
    want = [["a", "b", "c", "xy"], None, [], ["x", "y", None], ["a", "b", "c"]]
    for most in (1, 4, 1 << 20):
        monkeypatch.setattr(segment, "PIECE_BYTES", most)
        assert segment._all_terms(texts, list).to_pylist() == want
        assert segment._all_terms(texts.slice(1, 3), list).to_pylist() == want[1:4]
    assert segment._all_terms(texts.slice(0, 0), list).to_pylist() == []


def test_terms_of_a_batch_are_handed_back_in_pieces(monkeypatch):
    import pyarrow as pa

    from textpulse.operators import segment

    kind = pa.list_(pa.struct([("run", pa.string()), ("segmented", pa.bool_())]))
    rows = [None if i % 7 == 3 else [{"run": f"ab{i}", "segmented": i % 2 == 0}] * (i % 5) for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(rows, kind)], names=["id", "runs"])
    monkeypatch.setattr(segment, "PIECE_BYTES", 100)
    done = list(segment._replaced(iter([batch, batch.slice(0, 0), batch.slice(50, 20)]), list))
    assert len(done) > 10 and max(map(len, done)) < 40  # not one for every batch
    want = {i: None if r is None else [t for x in r for t in (list(x["run"]) if x["segmented"] else [x["run"]])] for i, r in enumerate(rows)}
    got = [(r["id"], r["runs"]) for b in done for r in b.to_pylist()]
    assert got == [(i, want[i]) for i in [*range(200), *range(50, 70)]]


def test_columns_that_are_kept_stay_as_they_are(spark):
    df = spark.sql("select 1 as id, timestamp '2024-01-01 00:00:00' as at, cast(null as decimal(9,2)) as d, array('x', null) as a, named_struct('b', 2) as s, '天地ab' as text union all select 2, null, 1.5, null, null, null")
    dictionary = spark.createDataFrame([("天地",)], "word string")
    out = tokenize(df, mode="dictionary", dictionary=dictionary)
    assert out.dtypes[:5] == df.dtypes[:5]
    assert sorted(map(str, out.collect())) == sorted(map(str, df.where("id = 1").selectExpr("id", "at", "d", "a", "s", "posexplode(array('天地', 'ab')) as (pos, word)").selectExpr("id", "at", "d", "a", "s", "bigint(pos) as pos", "word").collect()))
