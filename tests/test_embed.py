import numpy as np
from pyspark.sql import functions as F

from tidewire.functions.vectors import bucket_counts, cosine, word_buckets
from tidewire.operators.embed import (
    budget_calls,
    embed_dense,
    embed_sparse,
    hashed_bag_model,
    in_budget,
    padding_share,
    word_counts,
)

TEXTS = ["the cat sat on the mat", "cat", "a  b\tc a", "", "  ", "x " * 500 + "y"]


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")


def test_dense_equals_sparse_and_has_unit_length(spark):
    dense = {r.i: np.array(r.embedding) for r in embed_dense(texts(spark)).collect()}
    assert sorted(dense) == [0, 1, 2, 5]
    sparse = {i: np.zeros(384) for i in dense}
    for row in embed_sparse(texts(spark), "i").collect():
        sparse[row.i][row.bucket] = row.weight
    for i, vector in dense.items():
        assert len(vector) == 384
        assert abs(np.linalg.norm(vector) - 1) < 1e-6
        np.testing.assert_allclose(vector, sparse[i], atol=1e-7)


def test_counts_of_an_array(spark):
    rows = spark.createDataFrame([([3, 1, 3, 3, 0],), ([],), ([7],)], "b array<int>")
    got = [r.c for r in rows.select(bucket_counts(F.col("b")).alias("c")).collect()]
    assert [[tuple(x) for x in g] if g else g for g in got] == [
        [(0, 1), (1, 1), (3, 3)], None, [(7, 1)]
    ]


def test_dimensions_are_a_parameter(spark):
    rows = texts(spark).select(F.explode(word_buckets(F.col("text"), 1 << 18)).alias("b"))
    assert rows.where((F.col("b") < 0) | (F.col("b") >= 1 << 18)).isEmpty()
    assert rows.where(F.col("b") > 384).count() > 0


def test_any_batched_model_plugs_in(spark):
    def load():
        def predict(batch):
            return np.array([[len(t), len(batch)] for t in batch], dtype=np.float32)

        return predict

    rows = embed_dense(texts(spark).coalesce(1), model=load, batch_size=3).collect()
    assert [r.embedding[0] for r in rows] == [len(TEXTS[r.i]) for r in rows]
    # whole batches reach the model, not single rows
    assert max(r.embedding[1] for r in rows) == 3


def test_model_without_spark():
    predict = hashed_bag_model(16)()
    vectors = predict(np.array(["a b", ""], dtype=object))
    assert vectors.shape == (2, 16) and vectors.dtype == np.float32
    assert not vectors[1].any()


def test_cosine_expression(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>"
    )
    got = [r.c for r in rows.select(cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert abs(got[0] - 0.5**0.5) < 1e-9 and got[1] is None


def test_calls_keep_to_the_budget_and_cover_all():
    draw = np.random.default_rng(3)
    for budget in (1, 50, 400, 10**6):
        lengths = draw.integers(1, 300, 500)
        calls = budget_calls(lengths, budget)
        assert sorted(np.concatenate(calls).tolist()) == list(range(500))
        for call in calls:
            assert len(call) == 1 or len(call) * lengths[call].max() <= budget
    assert budget_calls(np.zeros(0, np.int64), 10) == []
    assert budget_calls(np.array([5]), 1)[0].tolist() == [0]


def test_ordered_calls_pad_little():
    lengths = np.random.default_rng(4).integers(1, 300, 4096)
    in_order = [np.arange(k, min(k + 32, 4096)) for k in range(0, 4096, 32)]
    assert padding_share(lengths, in_order) > 0.4
    assert padding_share(lengths, budget_calls(lengths, 8_192)) < 0.03
    assert padding_share(lengths[:0], []) == 0.0


def test_vectors_come_back_in_order_from_calls_in_budget(spark):
    seen = []

    def model():
        inner = hashed_bag_model()()

        def predict(texts):
            seen.append(word_counts(texts))
            return inner(texts)

        return predict

    texts_ = np.array([t for t in TEXTS if t.strip()] * 40 + ["a b c d e"] * 7, object)
    predict = in_budget(model, budget=30)()
    np.testing.assert_array_equal(predict(texts_), hashed_bag_model()()(texts_))
    assert all(len(n) == 1 or len(n) * n.max() <= 30 for n in seen) and len(seen) > 10
    whole = {r.i: list(r.embedding) for r in embed_dense(texts(spark)).collect()}
    rows = embed_dense(texts(spark), model=in_budget(budget=5), batch_size=3).collect()
    assert {r.i: list(r.embedding) for r in rows} == whole
