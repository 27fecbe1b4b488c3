import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textpulse.llm.simhash import BkTree, components, fingerprints, keep_one_of_each, shard_links, simhash_groups, tree_links


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, radius=2):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(fps))]


def near_values(n, seed=1):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        v = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.append(v)
            for _ in range(rng.randrange(0, 4)):
                v ^= 1 << rng.randrange(64)
    return out[:n]


def texts():
    rng = random.Random(7)
    vocabulary = [f"Word{k}" for k in range(300)]
    out = [None, "", " \n", "one", "one two", "One  TWO", "a b c", "É é x y"]
    for _ in range(25):
        w = rng.choices(vocabulary, k=rng.randrange(3, 400))
        out.append(" ".join(w))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = "changed"
            out.append("\t".join(w))
    return out + [out[9], "long " * 70000 + "tail"]


def test_fingerprints():
    all_texts = texts()
    got = fingerprints([(t or "").encode() for t in all_texts]).tolist()
    assert got[:-1] == [brute_fp(t) for t in all_texts[:-1]]
    assert got[-1] == brute_fp(all_texts[-1])
    assert fingerprints([]).tolist() == []


def test_tree_search_follows_all_edges_within_the_radius():
    values = list(dict.fromkeys(near_values(400)))
    tree = BkTree()
    for v in values:
        tree.add(v)
    for q in values[::7] + near_values(20, 9):
        assert sorted(tree.values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def groups_of(spark, values, **how):
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(v,) for v in signed], "fp long").distinct()
    roots = {r.node: r.root for r in components(shard_links(rows, **how)).collect()}
    return [roots.get(v, v) for v in signed], signed


def same_partition(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_links_equal_brute_force_with_large_and_with_tiny_shards(spark):
    values = near_values(500) + [0, 1, 3, 7, 15, 31, 1 << 63, (1 << 64) - 1]
    rng = random.Random(5)
    base = rng.getrandbits(64)
    values += [base ^ rng.getrandbits(8) for _ in range(200)]  # a dense group that shares most bits
    want = brute_groups(values)
    for size in (4096, 8):
        got, _ = groups_of(spark, values, shard_size=size)
        assert same_partition(got, want)


def test_a_tree_emits_at_most_one_link_per_fingerprint():
    values = list(range(256))
    assert len(tree_links(values, 2)) == 255


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 500: 400}


def test_documents(spark, frame):
    rows = list(enumerate(texts()[:-1])) + [(5, "other text of id five"), (None, "null id"), (None, texts()[9])]
    docs = frame(rows)
    fps = [brute_fp(t) for _, t in rows]
    root = brute_groups(fps)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = sorted(((str(i), f"{fp:016x}", str(least[r])) for (i, _), fp, r in zip(rows, fps, root, strict=True)))
    got = simhash_groups(docs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got.collect()) == want
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    stay = {i for (i, _), r in zip(rows, root, strict=True) if i == least[r]}
    assert sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, _ in rows if i in stay)
    assert simhash_groups(docs.limit(0)).count() == 0 and keep_one_of_each(docs.limit(0)).count() == 0


def test_string_identifiers(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), ("c", "p q r s t")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in simhash_groups(docs).select("doc_id", "component_id").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    assert docs.select(F.max("doc_id")).first()[0] == "c"
