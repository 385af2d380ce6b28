"""The nearest-neighbour join by pivots against brute force and the scan."""

import numpy as np
import pytest

from tests.test_search import by_hand, questions, ranked, vector_rows
from tidewire.operators import knn_join as K
from tidewire.operators.search import Vectors


def joined(spark, matrix, asked, k, cells=None, **columns):
    return K.nearest_by_pivots(
        vector_rows(spark, matrix, **columns),
        questions(spark, asked),
        Vectors("v", matrix.shape[1]),
        k,
        ties=("id",),
        cells=cells,
    )


@pytest.mark.parametrize("cells", [None, 1, 13])
def test_exact_with_copies_and_zero_vectors(spark, cells):
    """A third of all rows are copies; a question is one of them, another has no direction."""
    rng = np.random.default_rng(5)
    matrix = rng.standard_normal((400, 8)).round(2)
    matrix[100:240], matrix[300] = matrix[7], 0
    asked = np.vstack([rng.standard_normal((6, 8)).round(2), matrix[7], np.zeros(8)])
    hits, share = joined(spark, matrix, asked, 12, cells)
    expected = by_hand(matrix, asked, 12)
    del expected["q7"]
    assert ranked(hits) == expected
    assert 0 < share <= 1


def test_clusters_leave_few_pairs(spark):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((30, 24))
    matrix = np.repeat(centers, 80, axis=0) + 0.15 * rng.standard_normal((2400, 24))
    asked = matrix[::12]
    hits, share = joined(spark, matrix, asked, 10, 48)
    assert ranked(hits) == by_hand(matrix, asked, 10)
    assert share < 0.08


def test_blocks_are_cut_for_many_rows_and_questions(spark, monkeypatch):
    """Rows and questions of a block meet in pieces; the columns of rows are carried."""
    rng = np.random.default_rng(7)
    matrix, asked = rng.standard_normal((300, 6)).round(1), rng.standard_normal((90, 6)).round(1)
    asked[30:] = asked[0]  # most questions are one vector
    monkeypatch.setattr(K, "GROUP_ROWS", 40)
    monkeypatch.setattr(K, "GROUP_QUESTIONS", 11)
    groups, names = [], [f"n{i}" for i in range(300)]
    meet = K._meet

    def counted(*args):
        met, pairs = meet(*args)
        groups.append(met.count())
        return met, pairs

    monkeypatch.setattr(K, "_meet", counted)
    hits, _ = joined(spark, matrix, asked, 5, 2, name=names)
    assert ranked(hits) == by_hand(matrix, asked, 5)
    assert all(r.name == f"n{r.id}" for r in hits.collect())
    assert groups[0] > 90 * 5  # several pieces answered each question


def test_bounds_hold(spark):
    """No row of a block is nearer than the block's bound, for any question."""
    rng = np.random.default_rng(8)
    rows, asked = rng.standard_normal((500, 5)), rng.standard_normal((40, 5))
    unit, pivots = K._unit(rows), K.trained_pivots(rows, 9)
    angles = K._angles(unit, pivots)
    cell = angles.argmin(axis=1)
    own = angles.min(axis=1)
    used = np.unique(cell)
    blocks = K.Blocks(
        pivots,
        used,
        np.array([own[cell == c].min() for c in used]),
        np.array([own[cell == c].max() for c in used]),
        np.array([(cell == c).sum() for c in used]),
    )
    bounds = blocks.bounds(asked)
    away = np.arccos(np.clip(K._unit(asked) @ unit.T, -1, 1))
    for at, c in enumerate(used):
        assert (bounds[:, at] <= away[:, cell == c].min(axis=1)).all()
    held = blocks.first(bounds, 100) @ blocks.rows
    assert (held >= 100).all()


def test_fewer_rows_than_k_and_none(spark):
    matrix = np.eye(4)
    hits, share = joined(spark, matrix, matrix[:2], 10)
    assert {q: len(ids) for q, ids in ranked(hits).items()} == {"q0": 4, "q1": 4} and share == 1
    none = vector_rows(spark, matrix).limit(0)
    for rows, asked in ((none, questions(spark, matrix)), (vector_rows(spark, matrix), questions(spark, matrix).limit(0))):
        hits, share = K.nearest_by_pivots(rows, asked, Vectors("v", 4), ties=("id",))
        assert hits.columns == ["q", "score", "id", "rank"] and hits.count() == 0 and share == 0


def test_repeated_ids_are_questions_of_their_own(spark):
    matrix = np.eye(4)
    asked = spark.createDataFrame([("q", [1.0, 0.0, 0.0, 0.0]), ("q", [0.0, 1.0, 0.0, 0.0])], "q string, v array<float>")
    hits, _ = K.nearest_by_pivots(vector_rows(spark, matrix), asked, Vectors("v", 4), 1, ties=("id",))
    assert sorted((r.q, r.id, r["rank"]) for r in hits.collect()) == [("q", 0, 1), ("q", 1, 1)]


def test_no_broadcast_grows_with_the_questions(spark, monkeypatch, plan_of):
    """What is broadcast in the join of a phase is the line per block, on both sides."""
    plans = []
    meet = K._meet

    def seen(*args):
        met, pairs = meet(*args)
        plans.append(plan_of(met))
        return met, pairs

    monkeypatch.setattr(K, "_meet", seen)
    rng = np.random.default_rng(9)
    joined(spark, rng.standard_normal((200, 4)), rng.standard_normal((50, 4)), 3, 4)
    for plan in plans:
        text = plan.split("\n\n")
        broadcast = [t for t in text if "BroadcastExchange" in t.split("\n")[0]]
        assert broadcast and all("_pieces" in t or "_at" in t or "_least" in t for t in broadcast)
        assert not any("_asked" in t or "[v#" in t for t in broadcast)


def test_both_sides_meet_in_any_number_of_partitions(spark):
    """Rows and questions of a group are dealt to the same task, also if none are joined."""
    rng = np.random.default_rng(10)
    matrix, asked = rng.standard_normal((700, 6)), rng.standard_normal((40, 6))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hits, _ = joined(spark, matrix, asked, 5, 6)
        assert ranked(hits) == by_hand(matrix, asked, 5)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_question_is_sent_once_to_a_group_of_blocks(spark, monkeypatch):
    """Random vectors, whose bounds rule nothing out: copies grow with the rows, not with the blocks."""
    sent, back, ask, meet = [], [], K._asked, K._meet

    def asked_for(*args):
        found = ask(*args)
        sent.append(found.count())
        return found

    def met_for(*args):
        met, pairs = meet(*args)
        back.append(met.count())
        return met, pairs

    monkeypatch.setattr(K, "_asked", asked_for)
    monkeypatch.setattr(K, "_meet", met_for)
    monkeypatch.setattr(K, "GROUP_ROWS", 200)
    rng = np.random.default_rng(11)
    matrix, asked = rng.standard_normal((600, 24)), rng.standard_normal((30, 24))
    hits, share = joined(spark, matrix, asked, 5, 20)  # up to 160 blocks
    assert ranked(hits) == by_hand(matrix, asked, 5) and share > 0.9
    assert sent[1] <= 30 * 6 and back[1] <= 30 * 6 * 5  # at most six groups
