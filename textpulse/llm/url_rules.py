"""URL filters: explicit host and path rules, and association rules mined from labels.

FP-growth mines the combinations of URL tokens that enough bad pages share, and each is counted
over all labelled pages. Rules are pruned by confidence, lift and significance, and a rule goes if a shorter rule inside it is as confident.
An inverted index holds each rule under its rarest token; a URL's tokens look up the rules, and
a rule matches if the URL has all its tokens.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.session import materialize

#: Rules sent to every task; more rules are joined by a shuffle.
MAX_BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Mining:
    """min_count: bad pages of a rule at least, whatever the table's size, and min_support: their
    share of the labelled pages at least; min_confidence: share of a rule's pages that are bad;
    min_lift: confidence over the overall share of bad pages; max_error: chance that any rule at all
    is mined if labels do not depend on URLs (shared among all combinations tested); partitions: 0 for Spark's own choice."""

    min_support: float = 0.0
    min_count: int = 5
    min_confidence: float = 0.6
    min_lift: float = 1.2
    max_error: float = 0.05
    partitions: int = 0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The longest of ``rules`` (``host/path``) that fits: its host or a subdomain, and a path
    that starts with the rule's. Null if none does. The rules are a short configured list."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit("/" + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path segments and extension, query keys,
    fragment. Digits become ``#``, so ids share a token."""
    plain = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -F.least(k, F.greatest(F.size(labels), F.lit(1))), F.greatest(k, F.lit(1))), ".")))
    path = F.regexp_replace(path_of(url), r"[0-9]+", "#")
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    extension = F.regexp_extract(path, r"\.([A-Za-z#]+)$", 1)
    query = F.regexp_extract(plain, r"(?s)\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_replace(F.substring_index(x, "=", 1), r"[0-9]+", "#")))
    scheme = F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    single = F.filter(
        F.array(
            F.when(scheme != "", F.concat(F.lit("scheme:"), F.lower(scheme))),
            F.when(extension != "", F.concat(F.lit("ext:"), extension)),
            F.when(plain.contains("#"), F.lit("fragment")),
        ),
        lambda x: x.isNotNull(),
    )
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), segments, keys, single))


def mine_rules(labelled: DataFrame, how: Mining = Mining()) -> DataFrame:  # noqa: B008
    """Rules (rule_id, tokens, anchor, confidence, lift, support) from (url, bad).

    ``anchor`` is the rule's rarest token among the labelled pages. Tokens that lie in the same
    pages are one item while mining, so a long URL that many bad pages share costs one item.
    Nothing is mined if no page is labelled bad.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    schema = "rule_id string, tokens array<string>, anchor string, confidence double, lift double, support double"
    pages = labelled.select(url_tokens(F.col("url")).alias("tokens"), F.coalesce(F.col("bad"), F.lit(False)).alias("bad"))
    total, bad = pages.agg(F.count(F.lit(1)), F.count(F.when(F.col("bad"), 1))).first()
    if not bad:
        return spark.createDataFrame([], schema)
    floor = max(math.ceil(how.min_support * total - 1e-9), how.min_count)
    if floor > bad:
        return spark.createDataFrame([], schema)
    # tokens of fewer bad pages cannot be in a rule
    often = pages.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"), F.count(F.when(F.col("bad"), 1)).alias("bad")).where(F.col("bad") >= floor)
    counts = materialize(often)
    if counts.isEmpty():
        return spark.createDataFrame([], schema)
    baskets = materialize(_baskets(pages, counts))
    classes = _token_classes(baskets)
    baskets = materialize(_one_of_each(baskets, classes))
    bad_pages = baskets.where("bad").select("items", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k")).select("items")
    # half a page less, so that no rounding moves the floor
    miner = FPGrowth(itemsCol="items", minSupport=(floor - 0.5) / bad_pages.count())
    if how.partitions:
        miner = miner.setNumPartitions(how.partitions)
    sets = materialize(miner.fit(bad_pages).freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("bad")))
    # Chernoff: n independent pages are bad in at least a share c with a chance of at most exp(-n KL(c, base))
    base = bad / total
    needed = math.log(max(sets.count(), 1) / how.max_error)
    hopeful = _anchored(sets.where(F.col("bad") * -math.log(base) >= needed).withColumn("rule_id", F.array_join("tokens", " ")), counts)
    rules = _counted(hopeful, baskets).withColumn("confidence", F.col("bad") / F.col("pages")).where(F.col("confidence") >= max(how.min_confidence, how.min_lift * base))
    c = F.col("confidence")
    surprise = c * F.log(c / base) + F.when(c < 1, (1 - c) * F.log((1 - c) / (1 - base))).otherwise(0.0)
    rules = materialize(rules.where(F.col("pages") * surprise >= needed).select("rule_id", "tokens", "anchor", "confidence", (c / base).alias("lift"), (F.col("bad") / total).alias("support")))
    # a rule goes if a part of it, one token shorter, is a rule of at least its confidence
    parts = rules.where(F.size("tokens") > 1).select("rule_id", "confidence", F.explode("tokens").alias("left_out"), "tokens")
    parts = parts.select("rule_id", "confidence", F.array_join(F.array_remove("tokens", F.col("left_out")), " ").alias("part"))
    beaten = parts.join(rules.select(F.col("rule_id").alias("part"), F.col("confidence").alias("part_confidence")), "part").where("part_confidence >= confidence")
    kept = rules.join(beaten.select("rule_id").distinct(), "rule_id", "left_anti")
    return _anchored(_in_all_words(kept.drop("anchor"), classes), counts).select("rule_id", "tokens", "anchor", "confidence", "lift", "support")


def _token_classes(baskets: DataFrame) -> DataFrame:
    """(token, item, size): tokens that lie in the same pages, under the least of them.

    Tokens of equal pages are one item for mining: a rule with two of them covers the pages of the
    shorter rule with one, which stays. Classes are found by count and two digests of the row
    numbers and verified: in every row all of a class's tokens must be there, or none; the
    tokens of a class that fails are classes of their own.
    """
    rows = baskets.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode("items").alias("token"))
    marks = rows.groupBy("token").agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    least = marks.groupBy("rows", "x", "y").agg(F.min("token").alias("item"), F.count(F.lit(1)).alias("size"))
    classes = materialize(marks.join(least, ["rows", "x", "y"]).select("token", "item", "size"))
    shared = classes.where("size > 1")
    broken = rows.join(shared, "token").groupBy("row", "item").agg(F.count(F.lit(1)).alias("there"), F.first("size").alias("size")).where("there <> size").select("item").distinct()
    checked = classes.join(broken.withColumn("broken", F.lit(True)), "item", "left")
    alone = F.coalesce("broken", F.lit(False))
    return materialize(checked.select("token", F.when(alone, F.col("token")).otherwise(F.col("item")).alias("item"), F.when(alone, F.lit(1)).otherwise(F.col("size")).alias("size")))


def _one_of_each(baskets: DataFrame, classes: DataFrame) -> DataFrame:
    """``baskets`` with one item for each class of tokens."""
    items = F.broadcast(classes) if classes.count() <= MAX_BROADCAST_RULES else classes
    rows = baskets.withColumn("row", F.monotonically_increasing_id())
    merged = rows.select("row", F.explode("items").alias("token")).join(items, "token").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return rows.select("row", "bad", "n").join(merged, "row").select("items", "bad", "n")


def _in_all_words(rules: DataFrame, classes: DataFrame) -> DataFrame:
    """Each rule once for every choice of a token from each of its classes."""
    members = classes.groupBy("item").agg(F.collect_list("token").alias("words"))
    listed = rules.select("rule_id", F.explode("tokens").alias("item")).join(members, "item").groupBy("rule_id").agg(F.collect_list("words").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    every = F.aggregate("choices", none, lambda acc, words: F.flatten(F.transform(acc, lambda chosen: F.transform(words, lambda w: F.array_append(chosen, w)))))
    spread = rules.drop("tokens").join(listed, "rule_id").withColumn("tokens", F.explode(every)).withColumn("tokens", F.array_sort("tokens"))
    return spread.withColumn("rule_id", F.array_join("tokens", " ")).drop("choices")


def _baskets(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(items, bad, n): the pages' tokens that are in ``counts``, all of them, with the number of
    pages that share them. Pages of equal tokens are joined with ``counts`` as one row."""
    alike = materialize(pages.groupBy(F.array_sort("tokens").alias("tokens"), "bad").agg(F.count(F.lit(1)).alias("n")).withColumn("row", F.monotonically_increasing_id()))
    known = counts.select("token")
    if counts.count() <= MAX_BROADCAST_RULES:
        known = F.broadcast(known)
    items = alike.select("row", F.explode("tokens").alias("token")).join(known, "token").groupBy("row").agg(F.array_sort(F.collect_list("token")).alias("items"))
    return alike.select("row", "bad", "n").join(items, "row").select("items", "bad", "n")


def _anchored(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` with ``anchor``, each rule's rarest token by ``counts``."""
    anchors = rules.select("rule_id", F.explode("tokens").alias("token")).join(counts.select("token", "count"), "token").groupBy("rule_id").agg(F.min(F.struct("count", "token")).getField("token").alias("anchor"))
    return rules.join(anchors, "rule_id")


def _counted(rules: DataFrame, baskets: DataFrame) -> DataFrame:
    """``rules`` with ``pages``, the number of pages in ``baskets`` that have all their tokens."""
    rules = materialize(rules)
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("wanted"), "rule_id")
    if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    alike = baskets.groupBy("items").agg(F.sum("n").alias("n"))
    hits = alike.select("items", "n", F.explode("items").alias("token")).join(index, "token").where(F.size(F.array_except("wanted", "items")) == 0)
    return rules.join(hits.groupBy("rule_id").agg(F.sum("n").alias("pages")), "rule_id")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, rule_id, confidence): the most confident mined rule of every url that has one.

    The rules lie under their anchors; only rules whose anchor a URL has are compared with it.
    """
    rules = materialize(rules)
    index = rules.select(F.col("anchor").alias("token"), F.col("tokens").alias("wanted"), "rule_id", "confidence")
    if rules.limit(MAX_BROADCAST_RULES + 1).count() <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    tokens = url_tokens(F.col("url"))
    looked_up = urls.select("url").where("url is not null").select("url", tokens.alias("tokens"), F.explode(tokens).alias("token"))
    hits = looked_up.join(index, "token").where(F.size(F.array_except("wanted", "tokens")) == 0)
    best = F.max(F.struct("confidence", "rule_id"))
    return hits.groupBy("url").agg(best.alias("best")).select("url", F.col("best.rule_id").alias("rule_id"), F.col("best.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, mined: DataFrame, allow: Sequence[str], block: Sequence[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, the explicit rule that fits (or null) and the verdict.

    The explicit rule decides; without one a mined rule that matches blocks, else the url is
    allowed. ``mined_rule`` and ``confidence`` tell the mined match. A null url, or one without
    ``://``, has empty host and path; repeated rows and null identifiers are kept.
    """
    url = F.col("url")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")).select("id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    best = match_rules(rows, mined)
    rule = matching_rule(F.col("host"), F.col("path"), [*allow, *block])
    verdict = F.when(F.col("rule").isin(list(allow)), "allow").when(F.col("rule").isNotNull(), "block").when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")
    joined = rows.join(best.withColumnRenamed("rule_id", "mined_rule"), "url", "left").withColumn("rule", rule)
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "confidence")
