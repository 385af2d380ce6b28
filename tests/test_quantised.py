"""Approximate neighbours by codes: recall against brute force, exact scores."""

import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as registry
from tests.test_search import by_hand, questions, ranked, vector_rows
from tidewire.operators import quantised as Q
from tidewire.operators.search import Vectors


def searched(spark, tmp_path, matrix, asked, cells, n_probe, k=10, **more):
    rows, vectors = vector_rows(spark, matrix), Vectors("v", matrix.shape[1])
    quantiser = Q.trained(rows, vectors, cells)
    Q.write_codes(rows, vectors, quantiser, ("id",), str(tmp_path / "codes"))
    codes = Q.read_codes(spark, str(tmp_path / "codes"))
    asking = questions(spark, asked)
    hits = Q.nearest_by_codes(codes, rows, asking, vectors, quantiser, n_probe, k, keys=("id",), **more)
    return ranked(hits), Q.share_of_codes(codes, asking, vectors, quantiser, n_probe), hits


def recall(found, expected):
    pairs = [(q, i) for q, ids in expected.items() for i in ids]
    return np.mean([i in found.get(q, []) for q, i in pairs])


def test_recall_on_clustered_vectors(spark, tmp_path):
    """A tenth of the cells finds what is near."""
    rng = np.random.default_rng(1)
    matrix = np.repeat(rng.standard_normal((40, 32)), 50, axis=0) + 0.2 * rng.standard_normal((2000, 32))
    asked = matrix[::20]
    found, share, hits = searched(spark, tmp_path, matrix, asked, 40, 6)
    assert recall(found, by_hand(matrix, asked, 10)) >= 0.95 and share < 0.3
    own = np.asarray(matrix, np.float32).astype(float)
    for r in hits.limit(50).collect():
        a, b = own[r.id], own[20 * int(r.q[1:])]
        assert r.score == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-8)


def test_recall_on_the_given_vectors(spark, tables):
    row = registry.queries()["knn_codes_recall"](spark, tables).first()
    assert row.recall >= 0.9 and row.share_of_codes <= 1 and row.share_of_pairs <= 0.25


def test_all_cells_and_enough_candidates_are_exact(spark, tmp_path):
    """Copies, zero vectors, a question without direction, fewer distinct vectors than values."""
    rng = np.random.default_rng(2)
    matrix = rng.standard_normal((120, 8)).round(1)
    matrix[40:80], matrix[100] = matrix[7], 0
    asked = np.vstack([matrix[7], rng.standard_normal((3, 8)), np.zeros(8)])
    found, share, _ = searched(spark, tmp_path, matrix, asked, 5, 5, 12, again=20, block_rows=2)
    expected = by_hand(matrix, asked, 12)
    del expected["q4"]
    assert found == expected and share == 1


def test_codes_stand_for_the_nearest_values():
    rng = np.random.default_rng(3)
    unit = Q._unit(rng.standard_normal((500, 6)))
    books = np.stack([Q._book(unit.reshape(500, 3, 2)[:, m]) for m in range(3)])
    quantiser = Q.Quantiser(unit[:4], books)
    cell, codes = quantiser.encode(3 * unit)
    assert (cell == np.argmax(unit @ unit[:4].T, axis=1)).all()
    for m in range(3):
        away = np.linalg.norm(unit.reshape(500, 3, 2)[:, m, None] - books[m], axis=2)
        assert np.allclose(away[np.arange(500), codes[:, m]], away.min(axis=1))
    column = Q.Codes("code", 6, books=books)
    decoded = column.matrix(pa.array([c.tobytes() for c in codes]))
    assert np.abs(decoded - unit).max() < 0.3 and np.abs(decoded - unit).mean() < 0.03


def test_what_cannot_be_trained(spark):
    rows = vector_rows(spark, np.zeros((3, 4)))
    with pytest.raises(ValueError, match="no vectors"):
        Q.trained(rows, Vectors("v", 4))
    with pytest.raises(ValueError, match="divide"):
        Q.trained(rows, Vectors("v", 4), width=3)
