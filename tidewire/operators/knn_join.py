"""Nearest neighbours of many questions: both sides shuffled to Voronoi cells, in two phases.

Rows belong to the cell of their nearest pivot, and in it to a band of angles
from the pivot: a block. A block lies at least ``|a - b|`` away from a question
that is ``a`` away from its pivot while the block's rows are ``b`` away from it
(the triangle inequality of angles), and at least as far as the plane half way
between two pivots that the question is beyond. Phase one sends a question to
the blocks nearest by these bounds until they hold k rows; that settles the
score others would have to beat. Phase two sends it to all blocks whose bound
allows such a score. So the result is exact. Neighbouring blocks make a group; a
question goes to a group once, with a bit for each block of it that it reads, and
gets k rows of a group back, however many of its blocks were read. Neither the rows nor the questions
are collected or broadcast: only pivots and one line per block are, and both
have a fixed largest number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.ranking import top_n
from tidewire.operators.search import (
    BOUND_SLACK,
    SCORE_CELLS,
    SCORE_DIGITS,
    TOP_K,
    Block,
    Ranking,
    Vectors,
    _Kept,
    _norms,
    _units,
)
from tidewire.plans.session import shared_folder

# Rows per pivot wanted, and the most pivots: 1,024 x 384 doubles are 3 MB.
CELL_ROWS, MOST_CELLS = 256, 1024
# Rows the pivots are trained on, at most.
SAMPLE_ROWS = 8192
# Bands of one cell; with MOST_CELLS at most 8,192 blocks.
BANDS = 8
# Rows and questions that meet in one group, at most about.
GROUP_ROWS, GROUP_QUESTIONS = 8192, 2048
# Questions for a group that a task hands over at a time.
SENT_ROWS = 8192
# Angles come from rounded cosines; near 1 a cosine of 53 bits fixes them to some 1e-8.
ANGLE_SLACK = 1e-7


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / _norms(matrix)[:, None]


def _angles(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivots.T, -1, 1))


def trained_pivots(sample: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Unit vectors in the middle of groups of a sample (spherical k-means, fixed start)."""
    unit = _unit(sample)
    distinct = np.unique(unit.round(6), axis=0, return_index=True)[1]
    draw = np.random.default_rng(7).permutation(np.sort(distinct))[:count]
    pivots = unit[draw]
    for _ in range(rounds):
        home = np.argmax(unit @ pivots.T, axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, home, unit)
        lengths = _norms(sums)
        moved = lengths > 1e-9
        pivots[moved] = sums[moved] / lengths[moved, None]
    return pivots


@dataclass(frozen=True)
class Blocks:
    """Pivots, and per block its cell, the least and largest angle in it, and its rows."""

    pivots: np.ndarray
    cell: np.ndarray
    near: np.ndarray
    far: np.ndarray
    rows: np.ndarray

    def bounds(self, vectors: np.ndarray) -> np.ndarray:
        """(question, block): an angle that no row of the block is nearer than."""
        unit = _unit(vectors)
        angles = _angles(unit, self.pivots)
        away = np.maximum(angles[:, self.cell] - self.far, self.near - angles[:, self.cell])
        # From beyond the plane between two pivots the angle to it is a bound, too.
        cosines = unit @ self.pivots.T
        home = np.argmax(cosines, axis=1)
        gap = np.sqrt(np.clip(2 - 2 * (self.pivots[home] @ self.pivots.T), 0, None))
        over = cosines[np.arange(len(unit)), home][:, None] - cosines
        plane = np.arcsin(np.clip(np.divide(over, gap, out=np.zeros_like(over), where=gap > 1e-6), 0, 1))
        return np.clip(np.maximum(away, plane[:, self.cell]) - ANGLE_SLACK, 0, None)

    def first(self, bounds: np.ndarray, k: int) -> np.ndarray:
        """Mask of each question's nearest blocks that hold ``k`` rows together."""
        order = np.argsort(bounds, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        taken = held - self.rows[order] < k
        mask = np.zeros(bounds.shape, bool)
        np.put_along_axis(mask, order, taken, axis=1)
        return mask

    def groups(self) -> np.ndarray:
        """The first block of each group, and the number of blocks: GROUP_ROWS rows together, or one block."""
        starts, held = [], 0
        for at, rows in enumerate(self.rows.tolist()):
            if not starts or held + rows > GROUP_ROWS:
                starts.append(at)
                held = 0
            held += rows
        return np.array([*starts, len(self.rows)])


def _stored(rows: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _with_direction(rows: DataFrame, vectors: Vectors) -> DataFrame:
    """Rows with a vector that isn't all zero; another size than stated is an error."""
    squares = F.aggregate(
        vectors.column, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return vectors.usable(rows).where(squares > 0)


def _in_cells(rows: DataFrame, vectors: Vectors, pivots: np.ndarray) -> DataFrame:
    """Add ``_cell`` and ``_angle``: the nearest pivot and how far it is."""
    schema = T.StructType(
        [*rows.schema, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, SCORE_CELLS // len(pivots))
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                angles = _angles(_unit(vectors.matrix(part[vectors.column])), pivots)
                cell = np.argmin(angles, axis=1)
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angles.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(assign, schema)


def _in_blocks(rows: DataFrame, pivots: np.ndarray) -> tuple[DataFrame, Blocks]:
    """Add ``_block`` to rows in cells; a cell's angles are cut into BANDS equal bands."""
    spans = rows.groupBy("_cell").agg(
        F.min("_angle").alias("_least"), F.max("_angle").alias("_most")
    )  # one row per pivot
    width = (F.col("_most") - F.col("_least")) / BANDS
    band = F.least(
        F.coalesce(F.floor(F.try_divide(F.col("_angle") - F.col("_least"), width)), F.lit(0)),
        F.lit(BANDS - 1),
    )
    banded = rows.join(F.broadcast(spans), "_cell").select(
        *rows.columns, (F.col("_cell") * BANDS + band).cast("int").alias("_block")
    )
    found = (
        banded.groupBy("_block")
        .agg(F.min("_angle"), F.max("_angle"), F.count(F.lit(1)))
        .orderBy("_block")
        .collect()
    )  # at most MOST_CELLS * BANDS rows
    number, near, far, count = np.array(found, float).reshape(-1, 4).T
    cell = (number // BANDS).astype(int)
    table = rows.sparkSession.createDataFrame(
        [(int(b), i) for i, b in enumerate(number)], "_block int, _at int"
    )
    numbered = banded.join(F.broadcast(table), "_block").drop("_block", "_cell", "_angle")
    return numbered, Blocks(pivots, cell, near, far, count.astype(np.int64))


def _asked(
    questions: DataFrame, vectors: Vectors, blocks: Blocks, k: int, score: str | None
) -> DataFrame:
    """The groups of blocks a question is sent to in phase one, or in phase two with column ``score``.

    Question columns, ``_group``, ``_wanted`` (bits of the group's blocks), ``_pairs`` (their rows).
    """
    kept = [c for c in questions.columns if c != score]
    sent = [
        T.StructField("_group", T.IntegerType()),
        T.StructField("_wanted", T.BinaryType()),
        T.StructField("_pairs", T.LongType()),
    ]
    schema = T.StructType([*(questions.schema[c] for c in kept), *sent])
    starts = blocks.groups()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORE_CELLS // max(1, len(blocks.cell)))
        for batch in batches:
            for begin in range(0, batch.num_rows, step):
                part = batch.slice(begin, step)
                bounds = blocks.bounds(vectors.matrix(part[vectors.column]))
                mask = blocks.first(bounds, k)
                if score is not None:
                    reached = part[score].fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    mask = ~mask & (np.cos(bounds) >= reached[:, None] - BOUND_SLACK)
                asking = part.select(kept)
                for group, (first, end) in enumerate(zip(starts[:-1], starts[1:])):
                    at = np.flatnonzero(mask[:, first:end].any(axis=1))
                    for some in (at[i : i + SENT_ROWS] for i in range(0, len(at), SENT_ROWS)):
                        wanted = mask[some, first:end]
                        columns = [
                            pa.array(np.full(len(some), group, np.int32)),
                            pa.array([bits.tobytes() for bits in np.packbits(wanted, axis=1)], pa.binary()),
                            pa.array(wanted @ blocks.rows[first:end]),
                        ]
                        columns = [*asking.take(pa.array(some)).columns, *columns]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return questions.mapInArrow(choose, schema)


def _meet(
    rows: DataFrame, asked: DataFrame, vectors: Vectors, blocks: Blocks, ranking: Ranking, id_name: str
) -> tuple[DataFrame, int]:
    """The k best of each group for each question sent to it, and the number of pairs scored.

    A group of one large block is cut by a hash of its rows, and the questions of
    a group that many ask by a hash of theirs; each piece of one meets each piece
    of the other.
    """
    spark, starts = rows.sparkSession, blocks.groups()
    asking, pairs = np.zeros(len(starts) - 1, np.int64), 0
    counted = asked.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.sum("_pairs").alias("pairs"))
    for row in counted.collect():  # one row per group
        asking[row["_group"]] = row["n"]
        pairs += row["pairs"]
    pieces = -(-np.add.reduceat(blocks.rows, starts[:-1]) // GROUP_ROWS)
    parts = np.maximum(1, -(-asking // GROUP_QUESTIONS))
    known = [(g, int(p), int(q)) for g, (p, q) in enumerate(zip(pieces, parts)) if asking[g]]
    of_group = spark.createDataFrame(known, "_group int, _pieces int, _parts int")
    cuts = spark.createDataFrame(
        [(at, *of) for of in known for at in range(starts[of[0]], starts[of[0] + 1])],
        "_at int, _group int, _pieces int, _parts int",
    )
    carried = [c for c in rows.columns if c not in (vectors.column, "_at")]
    # Both sides' keys are ints: an int and a bigint of one value have other hashes and wouldn't meet.
    left = rows.join(F.broadcast(cuts), "_at").select(
        *carried,
        vectors.column,
        "_at",
        "_group",
        F.pmod(F.xxhash64(*carried), F.col("_pieces")).cast("int").alias("_piece"),
        F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
    )
    right = asked.join(F.broadcast(of_group), "_group").select(
        "_no",
        id_name,
        F.col(vectors.column).alias("_vector"),
        "_wanted",
        "_group",
        F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"),
        F.pmod(F.xxhash64("_no"), F.col("_parts")).cast("int").alias("_part"),
    )
    schema = T.StructType(
        [
            T.StructField("_no", T.LongType()),
            asked.schema[id_name],
            T.StructField("score", T.DoubleType()),
            *(rows.schema[c] for c in carried),
        ]
    )
    asked_vectors = Vectors("_vector", vectors.dimensions)

    def score(here: pa.Table, there: pa.Table) -> pa.Table:
        kept = None
        if here.num_rows and there.num_rows:
            first, end = starts[there["_group"][0].as_py() :][:2]
            bits = np.frombuffer(b"".join(there["_wanted"].to_pylist()), np.uint8)
            bits = np.unpackbits(bits.reshape(there.num_rows, -1), axis=1, count=end - first)
            asking = asked_vectors.matrix(there["_vector"].combine_chunks())
            block = Block(there["_no"].combine_chunks(), asking, bits.astype(bool))
            kept = _Kept(block, ranking, carried)
            here = here.take(pa.array(np.argsort(here["_at"].to_numpy(), kind="stable")))
            matrix = vectors.matrix(here[vectors.column].combine_chunks())
            cells = here["_at"].to_numpy() - first
            kept.see(here, matrix, cells, None, SCORE_DIGITS, _norms(matrix), _units(matrix))
            kept.rank()
        if kept is None or kept.best is None:
            return pa.table({f.name: pa.array([], _arrow(f)) for f in schema})
        who, best = kept.best["_question"].combine_chunks(), kept.best
        columns = [there["_no"].take(who), there[id_name].take(who), best["score"]]
        return pa.table([*columns, *(best[c] for c in carried)], names=schema.names)

    keys = ["_group", "_piece", "_part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)
    return met, pairs


def _arrow(field: T.StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def nearest_by_pivots(
    rows: DataFrame,
    questions: DataFrame,
    vectors: Vectors,
    k: int = TOP_K,
    *,
    ties: tuple[str, ...],
    cells: int | None = None,
) -> tuple[DataFrame, float]:
    """The ``k`` rows nearest to each question by cosine, exactly, and the share of pairs scored.

    Like ``search.nearest``, for questions too many to send to every task. The
    question's id comes first in ``questions`` and its vector second; a
    repeated id is a question of its own. Rows and questions without a vector,
    or with one that is all zero, take no part. ``cells``: the number of
    pivots, by default one for CELL_ROWS rows and MOST_CELLS at most, trained on
    a sample of SAMPLE_ROWS rows; they decide the speed, not the result.

    Jobs run when this is called: rows and questions are written to the shared
    folder, so a lost executor costs a read of it.
    """
    if vectors.words:
        raise ValueError("word lists have no fixed vectors; count them first")
    id_name, vector_name = questions.columns[:2]
    carried = [c for c in rows.columns if c != vectors.column]
    usable = _stored(_with_direction(rows.select(*carried, vectors.column), vectors), "rows")
    total = usable.count()
    own = Vectors("_asked", vectors.dimensions)
    asked = questions.select(F.col(id_name), F.col(vector_name).cast("array<double>").alias("_asked"))
    asked = _stored(
        _with_direction(asked, own).withColumn("_no", F.monotonically_increasing_id()), "questions"
    )
    schema = T.StructType(
        [
            T.StructField(id_name, asked.schema[id_name].dataType),
            T.StructField("score", T.DoubleType()),
            *(usable.schema[c] for c in carried),
            T.StructField("rank", T.IntegerType()),
        ]
    )
    count = asked.count()
    if not total or not count:
        return rows.sparkSession.createDataFrame([], schema), 0.0
    wanted = cells or min(MOST_CELLS, math.ceil(total / CELL_ROWS))
    sample = usable.select(vectors.column).orderBy(F.xxhash64(vectors.column)).limit(SAMPLE_ROWS)
    matrix = vectors.matrix(sample.toArrow()[vectors.column].combine_chunks())
    pivots = trained_pivots(matrix, min(wanted, MOST_CELLS))
    placed, blocks = _in_blocks(_stored(_in_cells(usable, vectors, pivots), "cells"), pivots)
    ranking = Ranking(k, ties)
    order = [F.col("score").desc(), *[F.col(name).asc() for name in ties]]

    def best(found: DataFrame) -> DataFrame:
        return top_n(found.select("_no", id_name, "score", *carried), ["_no"], order, k)

    def phase(score: str | None, asking: DataFrame) -> tuple[DataFrame, int]:
        sent = _stored(
            _asked(asking, own, blocks, k, score).withColumnRenamed("_asked", vectors.column), "asked"
        )
        met, pairs = _meet(placed, sent, vectors, blocks, ranking, id_name)
        return _stored(best(met), "near"), pairs

    near, pairs = phase(None, asked)
    reached = near.where(F.col("rank") == k).select("_no", F.col("score").alias("_reached"))
    more, further = phase("_reached", asked.join(reached, "_no", "left"))
    hits = best(near.drop("rank").unionByName(more.drop("rank"))).drop("_no")
    return hits.select(*schema.names), (pairs + further) / (total * count)
