import itertools
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textpulse.llm.queries import ALLOW, BLOCK
from textpulse.llm.url_rules import Mining, judge_urls, match_rules, mine_rules, url_tokens

URLS = [None, "", "nothing", "http://", "http://EXAMPLE.org", "http://example.org/es/x?q=1", "https://a.b.Example.ORG/es/1#t", "http://notexample.org/es/", "http://example.org/en/17", "http://example.org/en/2", "x://y.com/fr/a://b", "http://com/fr/", "http://x.com/de/1", "http://x.com/de", "http://x.net?a=b&c1=2", "ftp://h.org#f/e", "http://u@h.org:80/p", "http://é.com/fr/ü", "a\nb://c.org/x\ny"]


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = re.sub("[A-Z]", lambda m: m[0].lower(), rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
    fits = []
    for rule in [*ALLOW, *BLOCK]:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append(rule)
    rule = max(fits, key=len, default=None)
    return host, path, rule, None if rule is None else "allow" if rule in ALLOW else "block"


def labelled(n=400):
    rng = random.Random(3)
    out = []
    for k in range(n):
        host = rng.choice(["spam.example.net", "www.good.com", "m.other.org"])
        section = rng.choice(["en", "win", "free"])
        query = rng.choice(["", "?utm=1", "?id=7"])
        bad = rng.random() < (0.95 if host.startswith("spam") and section == "win" else 0.05)
        out.append((f"http://{host}/{section}/{k}{query}", bad))
    return out


def test_explicit_rules(spark, frame):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(None, URLS[5], "x"), (5, URLS[5], "x")], "page_id long, url string, host string").repartition(3)
    got = judge_urls(pages, mine_rules(spark.createDataFrame([], "url string, bad boolean")), ALLOW, BLOCK)
    rows = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    want = {(k, *brute(u)[:3], brute(u)[3] or "allow") for k, u in [*enumerate(URLS), (None, URLS[5])]}
    assert rows == want and got.count() == len(URLS) + 2
    assert judge_urls(pages.limit(0), mine_rules(spark.createDataFrame([], "url string, bad boolean")), ALLOW, BLOCK).count() == 0


def test_mined_rules_equal_brute_force(spark):
    data = labelled()
    table = spark.createDataFrame(data, "url string, bad boolean").repartition(3)
    how = Mining(min_support=0.05, min_confidence=0.6, min_lift=1.2)
    tokens = [(set(r.t), r.bad) for r in table.select(url_tokens(F.col("url")).alias("t"), "bad").collect()]
    total, bad = len(tokens), sum(b for _, b in tokens)
    frequent = [t for t in {x for s, _ in tokens for x in s} if sum(t in s for s, _ in tokens) >= how.min_support * total]
    rules = {}
    for size in range(1, 12):
        for combo in itertools.combinations(sorted(frequent), size):
            with_it = [b for s, b in tokens if s >= set(combo)]
            if sum(with_it) >= how.min_support * total and sum(with_it) / len(with_it) >= max(how.min_confidence, how.min_lift * bad / total):
                rules[combo] = sum(with_it) / len(with_it)
    kept = {c: f for c, f in rules.items() if not any(rules.get(tuple(x for x in c if x != t), -1) >= f for t in c)}
    mined = mine_rules(table, how)
    got = {tuple(r.tokens): r.confidence for r in mined.collect()}
    assert got.keys() == kept.keys() and all(abs(got[c] - kept[c]) < 1e-9 for c in kept) and got
    matched = {r.url: r.confidence for r in match_rules(table, mined).collect()}
    for (url, _), (s, _) in zip(data, [(set(r.t), 0) for r in spark.createDataFrame(data, "url string, bad boolean").select(url_tokens(F.col("url")).alias("t")).collect()], strict=True):
        best = max((f for c, f in kept.items() if s >= set(c)), default=None)
        assert (matched.get(url) is None) == (best is None) and (best is None or abs(matched[url] - best) < 1e-9)


def test_mined_verdict(spark):
    mined = mine_rules(spark.createDataFrame(labelled(), "url string, bad boolean"), Mining(min_support=0.05))
    pages = spark.createDataFrame([(1, "http://spam.example.net/win/9"), (2, "http://www.good.com/en/9"), (3, None)], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(pages, mined, ALLOW, BLOCK).collect()} == {1: "block", 2: "allow", 3: "allow"}
    few = spark.createDataFrame([("http://a.b/c", True)], "url string, bad boolean")
    assert mine_rules(few).count() == 0


def brute_rules(data, how, base_tokens):
    """Mined rules of the production method by counting every combination of tokens of bad pages."""
    total, bad = len(data), sum(data)
    floor = max(how.min_support * total, how.min_count)
    combos = {c for s, b in zip(base_tokens, data, strict=True) if b for n in range(1, len(s) + 1) for c in itertools.combinations(sorted(s), n)}
    counts = {c: [sum(b for s, b in zip(base_tokens, data, strict=True) if s >= set(c)), sum(s >= set(c) for s in base_tokens)] for c in combos}
    counts = {c: v for c, v in counts.items() if v[0] >= floor}
    rules = {}
    for c, (k, n) in counts.items():
        f, base = k / n, bad / total
        if f < max(how.min_confidence, how.min_lift * base):
            continue
        surprise = f * math.log(f / base) + ((1 - f) * math.log((1 - f) / (1 - base)) if f < 1 else 0)
        if n * surprise >= math.log(len(counts) / how.max_error):
            rules[c] = f
    return {c: f for c, f in rules.items() if not any(rules.get(tuple(x for x in c if x != t), -1) >= f for t in c)}


def test_rules_of_rare_hosts_by_the_production_mining(spark):
    # 9 of 3000 pages are bad, 7 of them all the pages of one host: 0.2% of the pages
    data = [(f"http://www.good{k % 5}.com/en/{k}", k in (9, 700)) for k in range(2993)] + [(f"http://spam.example.net/win/{k}", True) for k in range(7)]
    table = spark.createDataFrame(data, "url string, bad boolean").repartition(3)
    rows = table.select(url_tokens(F.col("url")).alias("t"), "bad").collect()
    want = brute_rules([r.bad for r in rows], Mining(), [set(r.t) for r in rows])
    got = {tuple(r.tokens): r.confidence for r in mine_rules(table).collect()}
    assert got.keys() == want.keys() and ("host:spam.example.net",) in got and all(abs(got[c] - want[c]) < 1e-9 for c in got)


def test_labels_without_relation_to_urls_give_no_rules(spark):
    rng = random.Random(6)
    data = [(f"http://h{rng.randrange(40)}.org/{rng.choice(['en', 'fr', 'de'])}/{k}", rng.random() < 0.26) for k in range(1000)]
    assert mine_rules(spark.createDataFrame(data, "url string, bad boolean")).count() == 0


def test_long_urls_keep_all_their_tokens(spark):
    # 13 tokens more frequent than "rare", which alone tells bad pages from good ones
    long = "http://a.b.c.example.com/s1x/s2x/s3x/s4x/s5x/s6x/page.html?k=1&m=2"
    data = [(long, False)] * 40 + [(long + "&rare=1", True)] * 12 + [(f"http://other.org/{k % 7}", False) for k in range(40)]
    mined = mine_rules(spark.createDataFrame(data, "url string, bad boolean").repartition(3))
    got = {tuple(r.tokens): r.confidence for r in mined.collect()}
    assert got == {("query:rare",): 1.0}


def test_more_distinct_tokens_than_fit_in_a_list(spark):
    names = [f"{a}{b}{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijklmnopqrstu"]
    data = [(f"http://good.com/{x}", True) for x in names] * 14 + [("http://spam.net/zz", True)] * 13 + [("http://good.com/clean", False)] * 60000
    got = {tuple(r.tokens) for r in mine_rules(spark.createDataFrame(data, "url string, bad boolean").repartition(3)).collect()}
    assert ("host:spam.net",) in got and ("path:zz",) in got and ("path:aaa",) in got and len([t for t in got if t[0].startswith("path:")]) == 2101


@pytest.mark.parametrize("copies", [5, 5000])
def test_many_tokens_of_the_same_pages(spark, copies):
    long = "http://bad.example.net/" + "/".join(f"seg{k}x" for k in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQR")
    data = [(long, True)] * copies + [(f"http://good{k % 7}.com/en/{k}", False) for k in range(60 + 4 * copies)]
    table = spark.createDataFrame(data, "url string, bad boolean").repartition(3)
    start = time.perf_counter()
    got = {tuple(r.tokens): r.confidence for r in mine_rules(table).collect()}
    assert time.perf_counter() - start < 30
    assert ("host:bad.example.net",) in got and ("path:segax",) in got and all(len(t) == 1 and c == 1.0 for t, c in got.items()) and len(got) >= 40


def test_classes_of_tokens_are_spread_again(spark):
    data = [("http://x.org/a/b?c=1", True)] * 30 + [("http://x.org/a/b", False)] * 40 + [("http://y.org/z?c=1", False)] * 40
    table = spark.createDataFrame(data, "url string, bad boolean").repartition(2)
    got = {tuple(r.tokens) for r in mine_rules(table).collect()}
    assert got == {("host:x.org", "query:c"), ("path:a", "query:c"), ("path:b", "query:c")}
    matched = {r.url for r in match_rules(spark.createDataFrame([("http://x.org/?c=2",), ("http://q.org/b?c",), ("http://q.org/b",)], "url string"), mine_rules(table)).collect()}
    assert matched == {"http://x.org/?c=2", "http://q.org/b?c"}


def test_registered_query_blocks_by_a_mined_rule(spark, tmp_path):
    from textpulse.llm.queries import op1_url_rules

    urls = [f"http://spam.example.net/win/{k}" for k in range(40)] + [f"http://good{k % 5}.net/en/{k}" for k in range(200)]
    spark.createDataFrame([(k, u, "") for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(k, 1, int(k < 30)) for k in range(220) if not 30 <= k < 40]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in op1_url_rules(spark, str(tmp_path)).collect()}
    assert all(got[k].verdict == "block" and got[k].rule is None for k in range(40))  # unlabelled ones too
    assert all(got[k].verdict == "allow" for k in range(40, 240))
