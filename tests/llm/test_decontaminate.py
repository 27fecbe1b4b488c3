import pickle
import random
import re

from pyspark.sql import functions as F

from textpulse.llm.decontaminate import ItemBlock, Shard, contaminated, find_contamination, longest_matches, n_hit, remove_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        x = words(t)
        k = min(13, len(x))
        for j in range(len(x) - k + 1 if x else 0):
            for i in range(len(w) - k + 1):
                if w[i : i + k] == x[j : j + k]:
                    hit |= set(range(i, i + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def cases():
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([3, 12, 13, 14, 30])))) for k in range(12)]
    items += [(90, "Solo"), (91, ""), (92, None), (93, items[4][1]), (94, "aa aa " * 10), (4, items[4][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, "solo"), (4, "aa " * 40)]
    for k in range(10, 60):
        body = rng.choices(vocabulary, k=rng.randrange(0, 120))
        for _ in range(rng.randrange(0, 3)):
            x = words(rng.choice(items)[1])
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = x[rng.randrange(0, 3) :]
        docs.append((k, ", ".join(body).upper() if k % 2 else " ".join(body)))
    return docs + [(10, docs[5][1]), (None, items[5][1])], items


def rows_of(found):
    return sorted(((str(r.doc_id), r.n_words, r.n_hit, r.its, r.bad) for r in found.select(F.col("row.doc_id").alias("doc_id"), "found.n_words", n_hit().alias("n_hit"), F.col("found.items").alias("its"), contaminated().alias("bad")).collect()), key=str)


def test_equals_brute_force_in_one_block_and_in_many(spark, frame):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((str(i), *brute(t, items)) for i, t in docs), key=str)
    assert rows_of(find_contamination(frame(docs), bench)) == want
    assert rows_of(find_contamination(frame(docs), bench, block_bytes=200)) == want


def test_filter_keeps_clean_rows_and_columns(spark, frame):
    docs, items = cases()
    table = frame(docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = remove_contaminated(table, bench)
    assert clean.columns == table.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, t in docs if not brute(t, items)[3])
    assert remove_contaminated(table, bench.limit(0)).count() == len(docs)
    assert remove_contaminated(table.limit(0), bench).count() == 0


def test_longest_matches(spark, frame):
    item = " ".join(f"t{k}" for k in range(40))
    docs = [(1, "x y " + " ".join(f"t{k}" for k in range(5, 35)) + " z"), (2, " ".join(f"t{k}" for k in range(0, 20)))]
    bench = spark.createDataFrame([("a", item)], "item_id string, text string")
    got = {r.item_pos: (r.n_words, r.place.doc_id, r.place.word_pos) for r in longest_matches(frame(docs, 2), bench).collect()}
    assert got[5] == (30, 1, 2) and got[0] == (20, 2, 0) and got[22] == (13, 1, 19) and 23 not in got


def test_only_suffixes_whose_first_words_lie_in_a_shard_are_searched():
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=60)).encode()) for k in range(400)] + [("short", b"w1 w2"), ("none", b"...")]
    block = ItemBlock(items, 13)
    assert len(pickle.dumps(block)) < sum(len(t) for _, t in items) + 100_000 and not block.derived
    texts = [" ".join(rng.choices(vocabulary, k=200)).encode() for _ in range(20)]
    texts[3] += b" " + items[7][1] + b" stop"
    texts[5] += b" w1 w2"
    shard = Shard(texts, block)
    spans, found = shard.hits()
    assert found[3] == {"7"} and spans[3] == [(200, 260)] and "short" in found[5]
    assert len(shard.searched) < 60 < len(block.starts) == 400 * 48 + 1


def test_null_item_is_the_empty_id(spark, frame):
    bench = spark.createDataFrame([(None, "one two"), ("x", "two")], "item_id string, text string")
    assert [r.its for r in find_contamination(frame([(1, "one two")]), bench).select(F.col("found.items").alias("its")).collect()] == [["", "x"]]
