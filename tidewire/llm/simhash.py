"""SimHash near-duplicates: fingerprints, BK-trees of shards, components."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, parts, stored, texts

BITS = 64
#: Nodes of one BK-tree at most, and queries that go down a tree together.
TREE, TOGETHER = 8192, 2048
#: Rows of the shards that one task takes together, about.
ROWS = 200_000


def fingerprint(text: str, words: int = 4) -> int:
    """64 bits: 1 where over half of the hashes of the word shingles have a 1."""
    found = text.encode().lower().split()
    if len(found) > words:
        shingles = map(b" ".join, zip(*(found[k:] for k in range(words))))
    else:
        shingles = iter([b" ".join(found)] if found else [])
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter([of(s, 42) for s in shingles], "<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for begin in range(0, len(hashes), 1 << 16):
        part = hashes[begin : begin + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, text_hash and ``bits`` (the fingerprint as a signed long) of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), words) for t in batch["text"]], "<u8")
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(bits.view("<i8"))],
                names=["doc_id", "text_hash", "bits"],
            )

    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    return texts(docs, text_hash).mapInArrow(lean(compute), "doc_id long, text_hash long, bits long")


class BKTree:
    """Distinct fingerprints; a child hangs on its parent by their integer distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for new in range(1, len(values)):
            at, value = 0, int(values[new])
            while True:
                distance = (int(values[at]) ^ value).bit_count()
                child = self.children[at].get(distance)
                if child is None:
                    self.children[at][distance] = new
                    break
                at = child

    def within(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, int]]:
        """(indexes of the queries, node) for each node near any of the queries.

        The queries go down together; each follows only edges within
        ``radius`` of its distance to the node.
        """
        waiting = [(0, np.arange(len(queries)))] if len(self.values) else []
        while waiting:
            node, asking = waiting.pop()
            distances = np.bitwise_count(queries[asking] ^ self.values[node]).astype(np.int64)
            near = distances <= radius
            if near.any():
                yield asking[near], node
            for edge, child in self.children[node].items():
                follow = asking[np.abs(distances - edge) <= radius]
                if len(follow):
                    waiting.append((child, follow))


class Groups:
    """Union-find with the smallest index as root."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def shard_links(values: np.ndarray, radius: int, tree: int = TREE) -> list[tuple[int, int]]:
    """A spanning forest of the links among a shard's fingerprints (sorted, distinct).

    Trees of at most ``tree`` nodes; every fingerprint asks every tree from its
    own on. Nodes already in one group with all that ask are still visited, but
    give no further row: a group of n gives n - 1 rows, not its pairs.
    """
    groups = Groups(len(values))
    for begin in range(0, len(values), tree):
        nodes = BKTree(values[begin : begin + tree])
        for first in range(begin, len(values), TOGETHER):
            queries = values[first : first + TOGETHER]
            for asking, node in nodes.within(queries, radius):
                for one in asking.tolist():
                    groups.join(first + one, begin + node)
    return [(x, groups.root(x)) for x in range(len(values)) if groups.root(x) != x]


def _bands(count: int, radius: int) -> list[int]:
    """Masks such that two fingerprints within ``radius`` bits agree under one at least.

    The bits are cut into radius + k blocks; k of them are left untouched by
    ``radius`` differences. k grows with the number of fingerprints, so that a
    shard of random ones stays small.
    """
    kept = 1
    while kept < 4 and (count >> (BITS * kept // (radius + kept))) > 64:
        kept += 1
    cuts = [round(BITS * k / (radius + kept)) for k in range(radius + kept + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(blocks, kept)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that join what is within ``radius`` bits, b the smaller, no group's pairs.

    ``distinct``: one column ``bits``. Shards by the masks of ``_bands``; each
    shard builds its BK-trees and lets its fingerprints go down them.
    """
    count = distinct.count()
    masks = _bands(count, radius)
    tasks = max(parts(distinct), count * len(masks) // ROWS)
    shard: Column = F.explode(
        F.array(
            *(
                F.struct(F.lit(k).alias("band"), F.col("bits").bitwiseAND(_signed(m)).alias("kept"))
                for k, m in enumerate(masks)
            )
        )
    )

    def join_shards(table: pd.DataFrame) -> pd.DataFrame:
        bits = table["bits"].to_numpy().view(np.uint64)
        order = np.lexsort((bits, table["kept"], table["band"]))
        bits, kept, band = bits[order], table["kept"].to_numpy()[order], table["band"].to_numpy()[order]
        new = np.flatnonzero((np.diff(kept) != 0) | (np.diff(band) != 0)) + 1
        found = [np.zeros((0, 2), np.uint64)]
        for begin, end in itertools.pairwise([0, *new.tolist(), len(bits)]):
            if end - begin > 1:
                values = bits[begin:end]
                forest = shard_links(values, radius)
                found.append(values[np.array(forest, np.int64).reshape(-1, 2)])
        ends = np.concatenate(found).view(np.int64)
        return pd.DataFrame({"a": ends[:, 0], "b": ends[:, 1]})

    return (
        distinct.select("bits", shard.alias("shard"))
        .select("bits", "shard.*")
        .withColumn("task", F.pmod(F.xxhash64("band", "kept"), F.lit(tasks)))
        .groupBy("task")
        .applyInPandas(lean(join_shards), "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every end of an edge: the smallest value of its component.

    Large-star and small-star steps in turn, until no edge changes. Each round
    is written to the shared folder, the smallest neighbours too: a join of two
    tables is one whose hot keys Spark can split. ``edges``: a, b.
    """
    now = stored(
        edges.where("a != b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ),
        "links",
    )
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("least")), "least")
        large = stored(
            both.join(least, "a")
            .select("a", "b", F.least("a", "least").alias("least"))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("least").alias("b"))
            .distinct(),
            "links",
        )
        # Every a now has only smaller b; all of them, and a, move to the smallest.
        smallest = stored(large.groupBy("a").agg(F.min("b").alias("least")), "least")
        small = (
            large.join(smallest, "a")
            .select(
                F.explode(
                    F.array(
                        F.struct(F.col("b").alias("a"), F.col("least").alias("b")),
                        F.struct("a", F.col("least").alias("b")),
                    )
                ).alias("edge")
            )
            .select("edge.*")
            .where("a != b")
            .distinct()
        )
        now = stored(small, "links")
        state = now.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if state == before:
            return now.select("a", F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """doc_id, text_hash, bits, component_id: documents linked when fingerprints differ in few bits.

    Documents with one fingerprint are one node. Nodes are sharded by the bits
    that differences can't all touch, so every link lies in a shard; BK-trees
    find it there. A shard reports a spanning forest, never its pairs. The
    components are found by star contraction over tables in the shared folder;
    each takes its smallest doc_id.

    A text without words has fingerprint zero and links like any other. Null
    text: empty. Null doc_id: a document of its own row, never the smallest of
    a component that has an id. Repeated rows: the same component. No rows: no
    rows.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    ends = components(links(nodes.select("bits"), radius))
    rooted = stored(
        nodes.join(ends.withColumnRenamed("a", "bits"), "bits", "left").select(
            "bits", "first", F.coalesce("root", "bits").alias("root")
        ),
        "rooted",
    )
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    return marked.join(rooted.join(named, "root").select("bits", "component_id"), "bits").select(
        "doc_id", "text_hash", "bits", "component_id"
    )


def one_of_each_group(docs: DataFrame, radius: int = 4, words: int = 4) -> DataFrame:
    """The documents without near duplicates of a smaller doc_id, all their columns.

    Near duplicates are those of ``near_duplicates``: one component by
    fingerprints. Documents without id stay; so do rows repeated with the id
    that stays.
    """
    dropped = stored(
        near_duplicates(docs, radius, words)
        .where("doc_id IS NOT NULL AND doc_id != component_id")
        .select(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash"))
        .distinct(),
        "dropped",
    )
    same = (docs["doc_id"] == dropped["dropped_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == dropped["dropped_hash"]
    )
    return docs.join(dropped, same, "left_anti")
