"""Exact top-k inner products by best-first search in M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.llm.common import lean, stored
from tidewire.llm.repeats import packed, unpacked

#: Vectors of one tree, queries of one block, entries of one page, routing vectors at most.
TREE, BLOCK, PAGE, ROUTES = 16_384, 256, 512, 64
#: Whole numbers up to this give exact sums of products as doubles.
EXACT = 2**53


def whole_numbers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and ``whole``: the components as floor(scale * x), of rows that can take part.

    Left out are null ids, null or empty vectors, and vectors with null or
    non-finite components. Values beyond 64 bits become the last ones in it.
    Equal rows count once.
    """
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(
            ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)
        ),
    )
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return (
        vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite)
        .select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("whole"))
        .distinct()
    )


@dataclass
class Tree:
    """An M-tree in arrays. Inner nodes have nodes below them, leaves vectors.

    The metric is the Euclidean distance after a coordinate is added to every
    vector that brings it to the length of the longest, and a zero to the
    query: the nearer, the larger the inner product.
    """

    ids: np.ndarray
    whole: np.ndarray
    #: Distance of each vector to the pivot of its leaf.
    to_leaf: np.ndarray
    #: Per node: pivot (a vector), covering radius, distance to the parent's pivot, what is below.
    pivot: np.ndarray
    radius: np.ndarray
    to_parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray
    length: np.ndarray

    def pack(self) -> bytes:
        shape = np.array(self.whole.shape, "<i8")
        return packed(shape, *(getattr(self, f.name) for f in fields(self)))

    @staticmethod
    def unpack(data: bytes) -> Tree:
        kinds = ("<i8", "<i8", "<i8", "<f8", "<i8", "<f8", "<f8", "<i8", "<i8", "?", "<f8")
        shape, ids, whole, *rest = unpacked(data, *kinds)
        return Tree(ids, whole.reshape(shape), *rest)


def build(ids: np.ndarray, whole: np.ndarray) -> Tree:
    """Bulk-load: evenly spaced vectors of a node are the pivots below it, each takes its nearest."""
    raw = whole.astype(np.float64)
    squares = (raw * raw).sum(axis=1)
    length = float(np.sqrt(squares.max()))
    points = np.column_stack([raw, np.sqrt(np.maximum(length**2 - squares, 0))])

    def distances(members: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        squared = (
            2 * length**2 - 2 * (points[members] @ points[pivots].T)
        )
        return np.sqrt(np.maximum(squared, 0))

    order: list[np.ndarray] = []
    to_leaf: list[np.ndarray] = []
    nodes: list[list] = [[0, 0.0, 0.0, 0, 0, False]]
    waiting = [(0, np.arange(len(ids)))]
    placed = 0
    while waiting:
        number, members = waiting.pop(0)
        pivot = nodes[number][0]
        away = distances(members, np.array([pivot]))[:, 0]
        nodes[number][1] = float(away.max())
        if len(members) <= PAGE:
            order.append(members)
            to_leaf.append(away)
            nodes[number][3:] = [placed, placed + len(members), True]
            placed += len(members)
            continue
        count = min(PAGE, -(-len(members) // PAGE) * 2)
        pivots = members[np.linspace(0, len(members) - 1, count).astype(int)]
        nearest = distances(members, pivots).argmin(axis=1)
        if np.bincount(nearest, minlength=count).max() == len(members):
            nearest = np.arange(len(members)) * count // len(members)  # all alike
        used = np.unique(nearest)
        nodes[number][3:] = [len(nodes), len(nodes) + len(used), False]
        between = distances(pivots, np.array([pivot]))[:, 0]
        for k in used.tolist():
            waiting.append((len(nodes), members[nearest == k]))
            nodes.append([int(pivots[k]), 0.0, float(between[k]), 0, 0, False])
    moved = np.concatenate(order)
    place = np.empty(len(moved), np.int64)
    place[moved] = np.arange(len(moved))
    pivot, radius, to_parent, first, last, leaf = (np.array(c) for c in zip(*nodes))
    return Tree(
        ids[moved],
        whole[moved],
        np.concatenate(to_leaf),
        place[pivot],
        radius,
        to_parent,
        first,
        last,
        leaf,
        np.array([length]),
    )


class Search:
    """Best-first search of one tree for several queries."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.raw = tree.whole.astype(np.float64)
        self.largest = int(np.abs(tree.whole).max(initial=0))
        self.slack = 1e-6 * (1 + float(tree.length[0]))
        self.computed = 0

    def products(self, query: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
        if self.largest * int(np.abs(query).max(initial=0)) * len(query) < EXACT:
            return self.raw[at] @ query.astype(np.float64)
        exact = self.tree.whole[at].astype(object) @ query.astype(object)
        return np.clip(exact, -(2**63), 2**63 - 1)

    def top(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The ``k`` best (score, vec_id) but those with the query's id, ties to smaller ids.

        Nodes wait in order of the least distance they can hold. An entry's
        distance isn't computed where the stored distances to the parent's
        pivot already keep it out.
        """
        tree, slack = self.tree, self.slack
        squares = float((query.astype(np.float64) ** 2).sum()) + float(tree.length[0]) ** 2
        slack = slack + 1e-6 * squares**0.5

        def distance(products: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(squares - 2 * products.astype(np.float64), 0))

        best: list[tuple[int, int]] = []
        reach = np.inf
        start = float(distance(self.products(query, tree.pivot[:1]))[0])
        waiting = [(max(start - float(tree.radius[0]), 0.0), 0, start)]
        while waiting:
            least, node, to_pivot = heapq.heappop(waiting)
            if least > reach:
                break
            below = np.arange(tree.first[node], tree.last[node])
            if tree.leaf[node]:
                near = below[np.abs(to_pivot - tree.to_leaf[below]) <= reach]
                near = near[tree.ids[near] != own]
                if not len(near):
                    continue
                scores = self.products(query, near)
                self.computed += len(near)
                if len(best) == k:
                    able = scores >= best[-1][0]
                    near, scores = near[able], scores[able]
                found = [(int(s), int(i)) for s, i in zip(scores, tree.ids[near])]
                best = sorted(best + found, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    reach = float(np.sqrt(max(squares - 2.0 * best[-1][0], 0.0))) + slack
            else:
                bound = np.abs(to_pivot - tree.to_parent[below]) - tree.radius[below]
                below = below[bound <= reach]
                if not len(below):
                    continue
                away = distance(self.products(query, tree.pivot[below]))
                self.computed += len(below)
                for child, d in zip(below.tolist(), away.tolist()):
                    bound_below = max(d - float(tree.radius[child]), 0.0)
                    if bound_below <= reach:
                        heapq.heappush(waiting, (bound_below, child, d))
        return best


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(-1, size)


def _by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, ids, vectors) of at most ``most`` rows with vectors of one size."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        sizes = np.array([len(w) for w in batch["whole"]])
        ids = batch["vec_id"].to_numpy()
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            vectors = _matrix(batch["whole"].take(pa.array(rows)), size)
            own = held.setdefault(size, [])
            own.append((ids[rows], vectors))
            while sum(len(i) for i, _ in own) >= most:
                all_ids, all_vectors = (np.concatenate(c) for c in zip(*own))
                yield size, all_ids[:most], all_vectors[:most]
                own[:] = [(all_ids[most:], all_vectors[most:])]
    for size, own in held.items():
        all_ids, all_vectors = (np.concatenate(c) for c in zip(*own))
        if len(all_ids):
            yield size, all_ids, all_vectors


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for size, ids, vectors in _by_size(batches, TREE):
        body = build(ids, vectors).pack()
        yield pa.RecordBatch.from_pydict(
            {
                "tree": pa.array([xxhash.xxh3_128_hexdigest(body)]),
                "size": pa.array([size], pa.int32()),
                "nodes": pa.array([body]),
            }
        )


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for size, ids, vectors in _by_size(batches, BLOCK):
        body = packed(ids.astype("<i8"), vectors.astype("<i8"))
        yield pa.RecordBatch.from_pydict(
            {"size": pa.array([size], pa.int32()), "asked": pa.array([body])}
        )


def _routed(vectors: DataFrame) -> DataFrame:
    """Add ``route``, the nearest of a bounded sample of vectors, to keep trees compact."""
    sample = vectors.orderBy(F.xxhash64("vec_id", "whole")).limit(ROUTES).collect()
    by_size: dict[int, np.ndarray] = {}
    for size in {len(r["whole"]) for r in sample}:
        by_size[size] = np.array([r["whole"] for r in sample if len(r["whole"]) == size], float)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(w) for w in batch["whole"]])
            found = np.zeros(len(sizes), np.int64)
            for size in np.unique(sizes).tolist():
                if size in by_size:
                    rows = np.flatnonzero(sizes == size)
                    own = _matrix(batch["whole"].take(pa.array(rows)), size).astype(float)
                    centers = by_size[size]
                    away = (centers**2).sum(axis=1) - 2 * own @ centers.T
                    found[rows] = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["whole"], pa.array(sizes * ROUTES + found)],
                names=["vec_id", "whole", "route"],
            )

    return vectors.mapInArrow(route, "vec_id long, whole array<long>, route long")


def nearest(
    vectors: DataFrame, asked: Column, k: int = 5, scale: int = 256
) -> DataFrame:
    """query_id, rank, vec_id, score: for rows where ``asked`` the ``k`` largest inner products.

    ``vectors``: vec_id, embedding. Components become floor(scale * x), scores
    are exact. Vectors are range-sorted by the nearest of a few sampled ones
    and cut into M-trees; queries into blocks. Each pair of tree and block is a
    row: the block's queries search the tree best first, with the tree's bounds,
    and give k rows each; the best k over all trees remain. Nothing is sampled
    but the routing vectors, which only decide which vectors share a tree.

    Ties go to the smaller vec_id. A row never finds rows with its own vec_id.
    Vectors of different sizes don't meet. Null or empty vectors, null ids, and
    null or non-finite components take no part. Equal rows count once; different
    vectors with one id are each a candidate and each a query. Fewer than k
    candidates: all. No rows: no rows.
    """
    whole = stored(whole_numbers(vectors, scale), "vectors")
    count = whole.count()
    trees = stored(
        _routed(whole)
        .repartitionByRange(max(1, -(-count // TREE)), "route", "vec_id")
        .sortWithinPartitions("route", "vec_id")
        .select("vec_id", "whole")
        .mapInArrow(_trees, "tree string, size int, nodes binary"),
        "trees",
    )
    blocks = stored(
        whole.where(asked).mapInArrow(_query_blocks, "size int, asked binary").select(
            "size", "asked", F.sha2("asked", 256).alias("block")
        ),
        "queries",
    )
    pairs = trees.select("tree", "size").join(blocks.select("block", "size"), "size")
    work = (
        pairs.repartition(F.col("tree"), F.col("block"))
        .join(blocks.select("block", "asked"), "block")
        .join(trees.select("tree", "nodes"), "tree")
        .select("nodes", "asked")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, asking in zip(batch["nodes"], batch["asked"]):
                engine = Search(Tree.unpack(nodes.as_py()))
                ids, flat = unpacked(asking.as_py(), "<i8", "<i8")
                out = []
                for own, query in zip(ids.tolist(), flat.reshape(len(ids), -1)):
                    key = xxhash.xxh3_64_intdigest(query.tobytes()) >> 1
                    out += [(own, key, i, s) for s, i in engine.top(own, query, k)]
                columns = zip(*out) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in columns],
                    names=["query_id", "query", "vec_id", "score"],
                )

    found = work.mapInArrow(lean(search), "query_id long, query long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
