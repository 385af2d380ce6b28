"""The dictionary trained on toxic texts, and the bound of what it is trained on."""

import numpy as np

from tests.llm.test_rows import labelled
from tidewire.llm import toxicity


def test_toxic_windows_teach_without_telling_stems():
    rows = labelled(45)
    assert toxicity.telling_stems(toxicity._split(rows)[0]) == []
    model = toxicity.fit(rows, 0.3)
    assert model.stems == model.ordinary != model.toxic
    held = labelled(200, seed=1)
    p = toxicity.probability(np.array([toxicity.gains(t, model) for t, _ in held]), model)
    y = np.array([label for _, label in held])
    assert p[y == 1].mean() > p[y == 0].mean() + 0.02


def test_each_class_learns_and_checks():
    for toxic in (1, 2, 5):
        rows = [(f"ordinary text {i} of words", 0) for i in range(60)]
        rows += [(f"grobble snurk {i} zwart", 1) for i in range(toxic)]
        learn, check = toxicity._split(rows)
        assert {y for _, y in learn} == {y for _, y in check} == {0, 1}
        model = toxicity.fit(rows, 0.1)
        assert any(model.weights)


def test_an_id_repeated_often_teaches_one_row(spark, frame, monkeypatch):
    docs = frame([(7, f"text {k} of one id") for k in range(50)] + [(8, "another text"), (8, None)])
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    taught = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, share: taught.extend(rows))
    toxicity.learned(docs, labels)
    assert sorted(label for _, label in taught) == [0, 1]
