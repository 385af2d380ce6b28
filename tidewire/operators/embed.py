"""Text to vectors: a pluggable batched model, and the built-in hashed one."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import strip_space
from tidewire.functions.vectors import DIMENSIONS, HASH_DIGITS, sparse_vector
from tidewire.operators.partitioning import computed_once

# Words a Python worker remembers.
REMEMBERED = 200_000

# Takes an array of texts, returns one vector per row.
Predict = Callable[[np.ndarray], np.ndarray]


def hashed_bag_model(dimensions: int = DIMENSIONS) -> Callable[[], Predict]:
    """Factory of the hashed bag-of-words model, the dense twin of ``sparse_vector``.

    It needs no weights. A worker remembers the buckets of its latest words.
    """

    def load() -> Predict:
        @lru_cache(maxsize=REMEMBERED)
        def bucket(word: str) -> int:
            head = hashlib.md5(word.encode()).hexdigest()[:HASH_DIGITS]
            return int(head, 16) % dimensions

        def predict(texts: np.ndarray) -> np.ndarray:
            tokens = [text.split() for text in texts]
            rows = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
            columns = np.fromiter((bucket(w) for t in tokens for w in t), np.int64, len(rows))
            counts = np.bincount(rows * dimensions + columns, minlength=len(tokens) * dimensions)
            vectors = counts.reshape(len(tokens), dimensions).astype(np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            return (vectors / np.where(norms == 0, 1.0, norms)).astype(np.float32)

        return predict

    return load


def budget_calls(lengths: np.ndarray, budget: int) -> list[np.ndarray]:
    """Indexes of the texts of each call, shortest texts first.

    A call holds as many as fit in ``budget`` tokens once all are padded to its
    longest; a text longer than that is a call of its own.
    """
    order = np.argsort(lengths, kind="stable")
    calls, begin = [], 0
    for at, length in enumerate(lengths[order].tolist()):
        if at > begin and (at + 1 - begin) * length > budget:
            calls.append(order[begin:at])
            begin = at
    return [*calls, order[begin:]] if len(order) else calls


def padding_share(lengths: np.ndarray, calls: list[np.ndarray]) -> float:
    """Share of padding among all that the model is given."""
    given = sum(len(call) * int(lengths[call].max()) for call in calls)
    return 1 - float(lengths.sum()) / given if given else 0.0


def word_counts(texts: np.ndarray) -> np.ndarray:
    """Tokens of each text, if the model's tokens are words; at least 1."""
    return np.fromiter((max(1, len(text.split())) for text in texts), np.int64, len(texts))


def in_budget(
    model: Callable[[], Predict] | None = None,
    budget: int = 8_192,
    tokens: Callable[[np.ndarray], np.ndarray] = word_counts,
) -> Callable[[], Predict]:
    """A model called with texts of like length, at most ``budget`` padded tokens at once.

    A model pads the texts of a call to the longest, so mixed lengths waste
    its time and a few long texts its memory. ``tokens`` counts the tokens of
    each text. The vectors come back in the order of the texts. Texts are
    ordered within a batch of ``embed_dense``: give it a large ``batch_size``.
    """

    def load() -> Predict:
        predict = (model or hashed_bag_model())()

        def within(texts: np.ndarray) -> np.ndarray:
            calls = budget_calls(tokens(texts), budget)
            if not calls:
                return predict(texts)
            found = np.concatenate([predict(texts[call]) for call in calls])
            vectors = np.empty_like(found)
            vectors[np.concatenate(calls)] = found
            return vectors

        return within

    return load


def not_blank(rows: DataFrame, text: str = "text") -> DataFrame:
    """Drop rows without text, before any model sees them."""
    return rows.where(F.length(strip_space(F.col(text))) > 0)


def dense_vector(
    text: Column, model: Callable[[], Predict] | None = None, batch_size: int = 1024
) -> Column:
    """Embedding column from a batched model, loaded once per Python worker."""
    embed = predict_batch_udf(
        model or hashed_bag_model(),
        return_type=T.ArrayType(T.FloatType()),
        batch_size=batch_size,
    )
    return embed(text)


def embed_dense(
    rows: DataFrame,
    text: str = "text",
    model: Callable[[], Predict] | None = None,
    batch_size: int = 1024,
) -> DataFrame:
    """Add ``embedding``; blank texts are removed first. The model sees a text once.

    A filter on the vector, or one the optimizer derives from an explode of
    it, would else be pushed below the model and run it a second time.
    """
    return computed_once(
        not_blank(rows, text), "embedding", dense_vector(F.col(text), model, batch_size)
    )


def embed_sparse(
    rows: DataFrame, *keys: str, text: str = "text", dimensions: int = DIMENSIONS
) -> DataFrame:
    """One row per non-zero weight: keys, ``bucket``, ``weight``. No shuffle.

    Blank texts have no weights and give no rows.
    """
    vectors = rows.select(
        *keys, F.explode_outer(sparse_vector(F.col(text), dimensions)).alias("_entry")
    )
    weights = vectors.where(F.col("_entry").isNotNull())
    return weights.select(*keys, "_entry.bucket", "_entry.weight")
