"""Approximate neighbours: trained cells, one byte for each few numbers, exact re-ranking.

Every vector is stored as a code: its direction is cut into parts, and a part is
named by the nearest of 256 trained ones. The codes lie by cell, the nearest of
some trained pivots. A search reads the codes of the cells it probes, ranks what
they decode to, and scores the best of these again by their whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.vectors import cosine
from tidewire.operators.knn_join import SAMPLE_ROWS, _unit, trained_pivots
from tidewire.operators.ranking import top_n
from tidewire.operators.search import (
    BLOCK_ROWS,
    SCORE_DIGITS,
    TOP_K,
    Block,
    Ranking,
    Vectors,
    _asking,
    _question_blocks,
    _search_blocks,
)
from tidewire.plans.session import shared_folder

# Values of a part: one byte.
VALUES = 256
# Candidates scored exactly, for each result wanted.
AGAIN = 10


@dataclass(frozen=True)
class Codes(Vectors):
    """A column of codes, read as the vectors they stand for."""

    books: np.ndarray | None = None

    def matrix(self, values: pa.Array) -> np.ndarray:
        codes = np.frombuffer(b"".join(values.to_pylist()), np.uint8).reshape(-1, len(self.books))
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.books)], axis=1)

    def usable(self, rows: DataFrame) -> DataFrame:
        return rows


@dataclass(frozen=True)
class Quantiser:
    """Trained on a bounded sample: ``pivots`` of the cells, ``books`` (part, value, number)."""

    pivots: np.ndarray
    books: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.pivots.shape[1]

    def encode(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of each row; rows without direction are not asked for."""
        unit = _unit(matrix)
        width = self.books.shape[2]
        codes = np.empty((len(unit), len(self.books)), np.uint8)
        for m, book in enumerate(self.books):
            part = unit[:, m * width : (m + 1) * width]
            codes[:, m] = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
        return np.argmax(unit @ self.pivots.T, axis=1), codes

    def probes(self, vectors: np.ndarray, n_probe: int) -> np.ndarray:
        """Mask of the ``n_probe`` cells whose pivots are nearest to each question."""
        chosen = np.argsort(-(_unit(vectors) @ self.pivots.T), axis=1, kind="stable")[:, :n_probe]
        mask = np.zeros((len(vectors), len(self.pivots)), bool)
        np.put_along_axis(mask, chosen, True, axis=1)
        return mask


def _book(part: np.ndarray, rounds: int = 10) -> np.ndarray:
    """At most 256 middles of the sample's parts, by k-means from a fixed start."""
    start = np.unique(part.round(6), axis=0, return_index=True)[1]
    book = part[np.random.default_rng(3).permutation(np.sort(start))[:VALUES]]
    for _ in range(rounds):
        own = np.argmin((book**2).sum(axis=1) - 2 * part @ book.T, axis=1)
        count = np.bincount(own, minlength=len(book))
        sums = np.stack([np.bincount(own, column, len(book)) for column in part.T], axis=1)
        book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], book)
    return np.concatenate([book, np.repeat(book[:1], VALUES - len(book), axis=0)])


def trained(rows: DataFrame, vectors: Vectors, cells: int = 32, width: int = 2) -> Quantiser:
    """A quantiser for ``rows``, trained on the SAMPLE_ROWS vectors of the smallest hashes.

    ``width``: numbers of a vector that share a byte; it has to divide the dimensions.
    """
    if vectors.dimensions % width:
        raise ValueError("the width of a part has to divide the dimensions")
    sample = (
        vectors.usable(rows)
        .where(F.exists(vectors.column, lambda x: x != 0))
        .select(vectors.column)
        .orderBy(F.xxhash64(vectors.column))
        .limit(SAMPLE_ROWS)
        .toArrow()
    )
    if not sample.num_rows:
        raise ValueError("no vectors to train on")
    unit = _unit(vectors.matrix(sample[vectors.column].combine_chunks()))
    parts = unit.reshape(len(unit), -1, width)
    books = np.stack([_book(parts[:, m]) for m in range(parts.shape[1])])
    return Quantiser(trained_pivots(unit, cells), books)


def write_codes(
    rows: DataFrame, vectors: Vectors, quantiser: Quantiser, keys: tuple[str, ...], path: str
) -> None:
    """Store keys and codes by cell; vectors without direction have no code."""
    schema = T.StructType(
        [*(rows.schema[c] for c in keys), T.StructField("code", T.BinaryType()), T.StructField("cell", T.IntegerType())]
    )
    column, wanted = vectors.column, list(keys)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = quantiser.encode(vectors.matrix(batch[column]))
                stored = pa.array([code.tobytes() for code in codes], pa.binary())
                columns = [*batch.select(wanted).columns, stored, pa.array(cell.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    usable = vectors.usable(rows).where(F.exists(column, lambda x: x != 0)).select(*keys, column)
    coded = usable.mapInArrow(encode, schema).hint("rebalance", "cell")
    coded.write.mode("overwrite").partitionBy("cell").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def nearest_by_codes(
    codes: DataFrame,
    rows: DataFrame,
    questions: DataFrame,
    vectors: Vectors,
    quantiser: Quantiser,
    n_probe: int,
    k: int = TOP_K,
    *,
    keys: tuple[str, ...],
    again: int = AGAIN,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """About the ``k`` rows nearest to each question: question id, keys, exact score, rank.

    ``codes`` as ``write_codes`` stored them for ``rows``; a question reads those
    of its ``n_probe`` nearest cells, and of them ``again * k`` are scored by
    their vectors. What is missed lies in other cells or was ranked too low by
    its code; measure it against ``search.nearest``. Question ids are distinct.
    """
    questions, asked = _asking(questions, vectors)
    id_field = questions.schema[0]
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "candidates")
    coded = Codes("code", quantiser.dimensions, books=quantiser.books)
    ranking = Ranking(again * k, keys)
    for at, block in enumerate(_question_blocks(questions, asked, block_rows)):
        probes = quantiser.probes(block.vectors, n_probe)
        reached = [int(c) for c in np.flatnonzero(probes.any(axis=0))]
        sent = spark.sparkContext.broadcast(Block(block.ids, block.vectors, probes))
        read = codes.where(F.col("cell").isin(reached))
        found = _search_blocks(read, [sent], coded, ranking, id_field, cells=True)
        found.select(id_field.name, *keys).write.parquet(f"{path}/block={at}")
        sent.destroy()
    schema = T.StructType([id_field, *(codes.schema[c] for c in keys)])
    candidates = spark.read.schema(schema).parquet(path)
    vector = questions.select(F.col(id_field.name), F.col(asked.column).alias("_asked"))
    scored = (
        candidates.join(rows.select(*keys, vectors.column), list(keys))
        .join(vector, id_field.name)
        .select(
            id_field.name,
            F.round(cosine(F.col(vectors.column), F.col("_asked")), SCORE_DIGITS).alias("score"),
            *keys,
        )
    )
    order = [F.col("score").desc(), *[F.col(name).asc() for name in keys]]
    return top_n(scored, [id_field.name], order, k)


def share_of_codes(codes: DataFrame, questions: DataFrame, vectors: Vectors, quantiser: Quantiser, n_probe: int) -> float:
    """Share of the (question, row) pairs whose code was read."""
    sizes = np.zeros(len(quantiser.pivots))
    for row in codes.groupBy("cell").count().collect():  # one row per cell
        sizes[row["cell"]] = row["count"]
    read = asked = 0
    for block in _question_blocks(*_asking(questions, vectors), BLOCK_ROWS):
        read += (quantiser.probes(block.vectors, n_probe) @ sizes).sum()
        asked += len(block.ids)
    return float(read / (asked * sizes.sum())) if asked and sizes.sum() else 0.0
