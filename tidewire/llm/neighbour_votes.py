"""Text quality by the votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, texts

#: Bound of the labelled sample: rows of each class.
TRAIN_ROWS = 2000
#: Dimensions of the latent space, neighbours that vote, and the power of their similarity.
DIMENSIONS, VOTERS, POWER = 32, 8, 8
#: Terms: hashed shapes of 4 bytes, hashed words, words by how often they occur, by length, and
#: words and lines equal to what came before.
SHAPES, WORDS, TIMES, LENGTHS = 2048, 1024, 32, 64
TERMS = SHAPES + WORDS + TIMES + LENGTHS + 2
#: Bytes whose shapes are counted at once, and documents compared at once.
PART, TOGETHER = 1 << 20, 256
#: A repeated line counts as so many terms.
LINE = 5


def _shapes() -> np.ndarray:
    """For each byte: other letters, a-z, A-Z, digits, blanks, line ends, stops, or the sign itself."""
    kinds = np.array([8 + b % 24 for b in range(256)])
    kinds[128:] = 1
    for kind, members in ((2, range(97, 123)), (3, range(65, 91)), (4, range(48, 58)), (5, b" \t"), (6, b"\n\x0b\x0c\r"), (7, b".,")):
        kinds[list(members)] = kind
    return kinds


SHAPE = _shapes()


def term_counts(text: str) -> np.ndarray:
    """How often each of TERMS hashed terms occurs in the whole text."""
    data = text.encode()
    found = np.zeros(TERMS)
    for begin in range(0, max(len(data) - 3, 0), PART):
        shape = SHAPE[np.frombuffer(data[begin : begin + PART + 3], np.uint8)]
        key = ((shape[:-3] * 33 + shape[1:-2]) * 33 + shape[2:-1]) * 33 + shape[3:]
        found[:SHAPES] += np.bincount((key * 0x9E3779B1 >> 7) % SHAPES, minlength=SHAPES)
    words = data.split()
    if words:
        counts = Counter(words)
        often = np.fromiter(counts.values(), np.int64, len(counts))
        hashed = np.fromiter(map(zlib.crc32, counts), np.int64, len(counts)) % WORDS
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        at = SHAPES
        found[at : at + WORDS] = np.bincount(hashed, often, WORDS)
        at += WORDS
        found[at : at + TIMES] = np.bincount(np.log2(often).astype(int), often, TIMES)[:TIMES]
        at += TIMES
        found[at : at + LENGTHS] = np.bincount(np.minimum(sizes, LENGTHS - 1), often, LENGTHS)
        found[-2] = sum(map(bytes.__eq__, words, words[1:]))
    lines = [line for line in data.split(b"\n") if line.strip()]
    found[-1] = LINE * (len(lines) - len(set(lines)))
    return found


def damped(counts: np.ndarray) -> np.ndarray:
    """Rows of counts as roots of their shares."""
    return np.sqrt(counts / (counts.sum(axis=1, keepdims=True) + 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class Model:
    """Where terms lie in the latent space, and the labelled documents in it."""

    terms: np.ndarray
    voters: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    share: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(damped(counts) @ self.terms).astype(np.float32)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The mean label of the VOTERS nearest labelled documents, by similarity.

        The product with all labelled vectors is exact: no index, no candidates.
        Similarities are rounded to millionths; of equal ones the earlier
        labelled document votes. A text that is like none gets ``share``.
        """
        scores = np.full(len(counts), self.share)
        if not len(self.labels):
            return scores
        voters, many = min(VOTERS, len(self.labels)), len(self.labels)
        alike = np.rint((self.vectors(counts) @ self.voters.T).astype(float) * 1e6).astype(np.int64)
        place = np.argpartition(-(alike * many - np.arange(many)), voters - 1, axis=1)[:, :voters]
        place.sort(axis=1)
        vote = np.clip(np.take_along_axis(alike, place, axis=1) / 1e6, 0, 1) ** POWER
        vote = vote * self.weights[place]
        total = vote.sum(axis=1)
        some = total > 1e-12
        scores[some] = (vote * self.labels[place]).sum(axis=1)[some] / total[some]
        return np.clip(scores, 0, 1)


def fit(counts: np.ndarray, labels: np.ndarray, of_class: tuple[int, int]) -> Model:
    """A model from term counts (rows) and labels of the sample; ``of_class``: labelled ids per class.

    Latent directions are the leading right singular vectors of the damped and
    weighted rows, by subspace iteration from a fixed start. A class that the
    sample cuts short votes the more.
    """
    known = sum(of_class)
    share = of_class[1] / known if known else 0.5
    if not len(labels):
        empty = np.zeros((0, DIMENSIONS), np.float32)
        return Model(np.zeros((TERMS, DIMENSIONS)), empty, labels, np.zeros(0), share)
    rare = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.5
    rows = _unit(damped(counts) * rare)
    basis = np.random.default_rng(5).standard_normal((TERMS, DIMENSIONS + 8))
    for _ in range(12):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, turn = np.linalg.svd(rows @ basis, full_matrices=False)
    terms = rare[:, None] * (basis @ turn.T)[:, :DIMENSIONS]
    sampled = np.bincount(labels, minlength=2)
    weights = np.array([n / max(m, 1) for n, m in zip(of_class, sampled)])[labels]
    bare = Model(terms, np.zeros((0, DIMENSIONS), np.float32), labels, weights, share)
    return Model(terms, bare.vectors(counts), labels, weights, share)


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_counts(t.as_py()) for t in batch["text"]]
        places = [np.flatnonzero(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["text_hash"],
                batch["label"],
                pa.array([p.astype("<i2").tobytes() for p in places], pa.binary()),
                pa.array([f[p].astype("<f4").tobytes() for f, p in zip(found, places)], pa.binary()),
            ],
            names=["doc_id", "text_hash", "label", "places", "counts"],
        )


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """Fit a model on a bounded sample of labelled documents.

    ``labels``: doc_id and ``label`` (0 or 1). Of each class the TRAIN_ROWS ids
    with the smallest hashes, of each id the row with the smallest text hash;
    of each the term counts of its whole text, at most 6 bytes a term, reach
    the driver. Rows without id or label teach nothing; an id labelled twice
    has its smaller label.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.col(label).cast("int")).alias("label"))
    )
    of_class = known.agg(*(F.count_if(F.col("label") == k) for k in (0, 1))).first()
    picked = [
        known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
        for k in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * TRAIN_ROWS narrow rows
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    rows = (
        texts(docs, text_hash)
        .join(sample, "doc_id")
        .select("doc_id", "text_hash", "text", "label")
        .mapInArrow(lean(_sparse), "doc_id long, text_hash long, label int, places binary, counts binary")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text_hash", "label", "places", "counts")).alias("row"))
        .select("doc_id", "row.*")
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    counts = np.zeros((len(rows), TERMS))
    for own, row in zip(counts, rows):
        own[np.frombuffer(row["places"], "<i2")] = np.frombuffer(row["counts"], "<f4")
    return fit(counts, np.array([r["label"] for r in rows], np.int64), tuple(of_class))


def scores(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, score and predicted of every document, one row for each.

    The labelled vectors (at most 2 * TRAIN_ROWS of DIMENSIONS numbers, 512 kB)
    and the terms (800 kB) are broadcast; blocks of TOGETHER documents are
    multiplied with all of them. No shuffle. Null or empty text: like no
    document, so the share of label 1 among the labels (0.5 without labels).
    Where all labels agree, that label. Null doc_id: kept. Repeated rows: scored
    each. No rows: no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                counts = np.stack([term_counts(t.as_py()) for t in part["text"]])
                found = sent.value.score(counts)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(found), pa.array((found >= threshold).astype(np.int32))],
                    names=["doc_id", "score", "predicted"],
                )

    return texts(docs).mapInArrow(lean(score), "doc_id long, score double, predicted int")
