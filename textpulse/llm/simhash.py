"""SimHash near-duplicates: fingerprints, BK-trees over routed shards, connected components.

Fingerprints within ``radius`` bits agree exactly on at least one of ``radius + 1`` blocks of
their bits, so each distinct fingerprint is sent to one shard per block (the shard of all that
share the block's value). A shard is a BK-tree: children are keyed by the Hamming distance to
their parent, and a search follows only edges within the radius of the query's distance. A
shard above ``shard_size`` is routed again on blocks of its remaining bits, so no tree or task
grows with a hot value, and no tree is sent to tasks that cannot need it.

A tree never emits all pairs of a group: every fingerprint gets one link, to the root of the
links found in its tree so far. Components of those links are found by alternating large-star
and small-star steps, which keep one row per link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.llm.text import as_bytes, id_and_text, id_type, slices
from textpulse.session import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Distinct fingerprints in one tree; a larger shard is routed again.
SHARD_SIZE = 4096

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprints(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if over half of the shingles' hashes set it.

    A text of fewer words than a shingle is one shingle; a text without words has fingerprint 0.
    """
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    sizes = []
    for text in texts:
        words = text.translate(_LOWER).split()
        if len(words) <= shingle:
            joined = [b" ".join(words)] if words else []
        else:
            joined = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        before = len(hashes)
        hashes += [xxh64_intdigest(s, seed) for s in joined]
        sizes.append(len(hashes) - before)
    sizes = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    ends = np.cumsum(sizes)
    bits = np.array(hashes, np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(BITS, dtype=np.uint64))
    start = 0
    while start < len(texts):  # as many texts at a time as have about 65,536 shingles
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + 65536, side="right")))
        some = np.arange(start, stop)[sizes[start:stop] > 0]
        if len(some):
            votes = np.zeros((len(some), BITS), np.int64)
            for a in range(int(base), int(ends[stop - 1]), 1 << 20):  # one very long text in parts
                part = bits[a : min(a + (1 << 20), int(ends[stop - 1]))]
                ones = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                lo = np.clip(ends[some] - sizes[some] - a, 0, len(part))
                hi = np.clip(ends[some] - a, 0, len(part))
                here = np.flatnonzero(hi > lo)
                votes[here] += np.add.reduceat(ones, lo[here], axis=0, dtype=np.int32)
            out[some] = ((votes * 2 > sizes[some, None]) * weights).sum(axis=1, dtype=np.uint64)
        start = stop
    return out


class BkTree:
    """Fingerprints in a tree whose children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[int]:
        """Node numbers within ``radius`` bits; only edges that can lead to one are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= radius:
                found.append(node)
            children = self.children[node]
            for edge in range(max(1, distance - radius), distance + radius + 1):
                child = children.get(edge)
                if child is not None:
                    todo.append(child)
        return found

    def add(self, value: int) -> int:
        number = len(self.values)
        node = 0
        while self.values:
            distance = (self.values[node] ^ value).bit_count()
            if not distance:
                return node
            child = self.children[node].get(distance)
            if child is None:
                self.children[node][distance] = number
                break
            node = child
        self.values.append(value)
        self.children.append({})
        return number


def tree_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root value) for every fingerprint of one shard that is linked to another."""
    tree, root = BkTree(), []

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for value in values:
        near = tree.within(value, radius)
        number = tree.add(value)
        if number < len(root):
            continue
        root.append(number)
        for other in near:
            a, b = find(other), find(number)
            root[max(a, b)] = min(a, b)
    return [(tree.values[k], tree.values[find(k)]) for k in range(len(root)) if find(k) != k]


def _blocks(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[k * len(bits) // parts : (k + 1) * len(bits) // parts] for k in range(parts)]


def _value_of(fp: Column, bits: list[int]) -> Column:
    """The bits of a run of positions as a number (runs are contiguous or a few pieces)."""
    runs: list[list[int]] = []
    for b in bits:
        if runs and b == runs[-1][-1] + 1:
            runs[-1].append(b)
        else:
            runs.append([b])
    out, shift = F.lit(0).cast("long"), 0
    for run in runs:
        piece = F.shiftrightunsigned(fp, run[0]).bitwiseAND(F.lit((1 << len(run)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, shift))
        shift += len(run)
    return out


def shard_links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp``; at most one per fingerprint and tree."""
    parts = radius + 1

    def route(rows: DataFrame, pieces: list[tuple[str, list[int]]]) -> DataFrame:
        keys = F.array(*(F.struct(F.concat(F.lit(name + ":"), _value_of(F.col("fp"), bits).cast("string")).alias("k"), F.lit(name).alias("name")) for name, bits in pieces))
        return rows.select("fp", "prefix", F.explode(keys).alias("key")).select("fp", F.concat_ws("/", "prefix", "key.k").alias("shard"), F.col("key.name").alias("name"))

    level = [("", list(range(BITS)))]  # (route so far, bits that may still differ)
    rows = distinct.select("fp", F.lit(None).cast("string").alias("prefix"), F.lit("").alias("path"))
    links = None
    while True:
        routed = None
        names: dict[str, list[int]] = {}
        for path, bits in level:
            pieces = [(f"{path}{k}", block) for k, block in enumerate(_blocks(bits, parts)) if block]
            names |= {name: [b for b in bits if b not in block] for name, block in pieces}
            part = route(rows.where(F.col("path") == path), pieces)
            routed = part if routed is None else routed.unionByName(part)
        sizes = routed.groupBy("shard").count().where("count > 1")
        sized = materialize(routed.join(sizes, "shard"))
        small, large = sized.where(F.col("count") <= shard_size), sized.where(F.col("count") > shard_size)
        found = _tree_stage(small, radius)
        links = found if links is None else links.unionByName(found)
        paths = [r[0] for r in large.select("name").distinct().collect()]  # at most parts ** depth names
        level = [(name, names[name]) for name in sorted(paths) if len(names[name]) >= parts]
        stuck = [name for name in paths if len(names[name]) < parts]
        if stuck:  # too few bits left to tell apart more than a tree's worth
            links = links.unionByName(_tree_stage(large.where(F.col("name").isin(stuck)), radius))
        if not level:
            return links
        rows = large.select("fp", F.col("shard").alias("prefix"), F.col("name").alias("path"))


def _tree_stage(rows: DataFrame, radius: int) -> DataFrame:
    """Build and search the tree of every shard; rows are sorted by shard within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values, out = None, [], []

        def finish() -> None:
            if len(values) > 1:
                out.extend(tree_links(values, radius))

        def result() -> pa.RecordBatch:
            sides = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(np.array(list(x), np.uint64).view(np.int64)) for x in sides], ["a", "b"])

        for batch in batches:
            for name, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist(), strict=True):
                if name != shard:
                    finish()
                    shard, values = name, []
                values.append(fp)
            if len(out) > 10_000:
                yield result()
                out.clear()
        finish()
        yield result()

    return rows.select("shard", "fp").repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component of every linked node.

    Alternating steps: large-star links every larger neighbour of a node to the smallest one
    around it, small-star does the same with the smaller neighbours; both keep components and
    end in stars. Each round is written to the checkpoint folder.
    """

    def star(pairs: DataFrame) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        return pairs.join(least, "u")

    pairs = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        joined = star(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = materialize(small)
        # stars: every node has one smaller neighbour, and that one has none
        moved = after.join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or after.groupBy("u").count().where("count > 1").limit(1).count()
        pairs = after
        if not moved:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """One row per document: its ``fingerprint`` (16 hex digits) and ``component_id``, the smallest
    identifier reachable over links of at most ``radius`` differing bits.

    Equal fingerprints are one node, so a group of copies costs one row in the search. Null and
    empty texts have fingerprint zero and are linked like any other; repeated rows are kept; a
    null identifier is not the smallest unless its component has no other; an empty table gives
    no rows.
    """
    kind = id_type(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            fps = fingerprints(as_bytes(batch.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    marked = materialize(id_and_text(docs, id_col, text_col).mapInArrow(run, f"id {kind}, fp long"))
    distinct = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(shard_links(distinct, radius, shard_size))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` (all their columns) whose identifier is its component's smallest.

    Rows that share an identifier count as one document and stay or go together.
    """
    groups = simhash_groups(docs, id_col, **options)
    stay = groups.where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{id_col}`").alias("stay")).distinct()
    return docs.join(stay, docs[f"`{id_col}`"].eqNullSafe(stay["stay"]), "left_semi")
