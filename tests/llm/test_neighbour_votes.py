"""Votes of labelled neighbours: a plain computation of each score, and held-out labels."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import pairs_of
from tidewire.llm import neighbour_votes as N
from tidewire.llm.queries import op12_neighbour_votes

SF01 = "/root/testdata/sf0.01"


def brute_counts(text):
    """The terms of a text, one by one."""
    data, found = text.encode(), np.zeros(N.TERMS)
    shapes = [int(N.SHAPE[b]) for b in data]
    for four in zip(shapes, shapes[1:], shapes[2:], shapes[3:]):
        key = sum(s * 33 ** (3 - k) for k, s in enumerate(four))
        found[(key * 0x9E3779B1 >> 7) % N.SHAPES] += 1
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    for word, n in Counter(words).items():
        found[N.SHAPES + zlib.crc32(word) % N.WORDS] += n
        found[N.SHAPES + N.WORDS + n.bit_length() - 1] += n
        found[N.SHAPES + N.WORDS + N.TIMES + min(len(word), N.LENGTHS - 1)] += n
    found[-2] = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    found[-1] = N.LINE * (len(lines) - len(set(lines)))
    return found


def brute_score(counts, model):
    """The vote of the nearest labelled vectors, found by sorting all similarities."""
    share = np.sqrt(counts / (counts.sum() + 1)) @ model.terms
    vector = (share / max(np.linalg.norm(share), 1e-9)).astype(np.float32)
    alike = [round(float(vector @ v) * 1e6) / 1e6 for v in model.voters]
    nearest = sorted(range(len(alike)), key=lambda k: (-alike[k], k))[: N.VOTERS]
    votes = [min(max(alike[k], 0), 1) ** N.POWER * model.weights[k] for k in nearest]
    if sum(votes) <= 1e-12:
        return model.share
    return sum(v * model.labels[k] for v, k in zip(votes, nearest)) / sum(votes)


def test_terms_one_by_one(awkward, monkeypatch):
    for part in (N.PART, 50):
        monkeypatch.setattr(N, "PART", part)
        for _, text in pairs_of(awkward):
            assert N.term_counts(text).tolist() == brute_counts(text).tolist()


def test_scores_by_brute_force(spark, tables, documents):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    model = N.learned(documents, labels)
    got = {r["doc_id"]: r["score"] for r in N.scores(documents, model).collect()}
    texts = dict(pairs_of(documents))
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        assert got[doc_id] == pytest.approx(brute_score(N.term_counts(text), model), abs=1e-4)


def test_directions_are_singular_vectors(documents):
    """Subspace iteration finds the space that a full decomposition finds."""
    counts = np.array([N.term_counts(t) for _, t in pairs_of(documents)])
    labels = np.arange(len(counts)) % 2
    model = N.fit(counts, labels, (1, 1))
    rare = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.5
    rows = N._unit(N.damped(counts) * rare)
    values = np.linalg.svd(rows, compute_uv=False)[: N.DIMENSIONS]
    found = np.linalg.norm(rows @ (model.terms / rare[:, None]), axis=0)
    assert np.allclose(found[:10], values[:10], rtol=1e-3)


def test_held_out_labels(spark):
    got = {r["doc_id"]: r for r in op12_neighbour_votes(spark, SF01).collect()}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").select("doc_id", "quality").collect()
    held = [(got[r[0]], r[1]) for r in labels if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    good = [r["score"] for r, label in held if label == 1]
    bad = [r["score"] for r, label in held if label == 0]
    area = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert area > 0.97
    assert np.mean([s >= 0.5 for s in good]) > 0.97 and np.mean([s < 0.5 for s in bad]) > 0.9


def test_held_out_labels_teach_nothing(spark, awkward):
    """A label changes no score of another model fitted without it."""
    kept = spark.createDataFrame([(7, 1), (3, 0)], "doc_id long, quality int")
    more = kept.unionByName(spark.createDataFrame([(None, 1), (9, None)], kept.schema))
    a, b = (N.scores(awkward, N.learned(awkward, x)).collect() for x in (kept, more))
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_awkward_rows(spark, awkward):
    labels = spark.createDataFrame([(7, 1), (8, 1), (8, 0), (11, 0), (10, 1), (99, 1)], "doc_id long, quality int")
    rows = N.scores(awkward, N.learned(awkward, labels)).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    blank = [r["score"] for r in rows if r["doc_id"] in (4, 5)]
    assert blank == [3 / 5, 3 / 5]  # like no document: labelled ids 7, 10 and 99 of five
    assert N.scores(awkward.limit(0), N.learned(awkward.limit(0), labels)).count() == 0


def test_one_class_and_no_labels(spark, awkward):
    labels = spark.createDataFrame([(7, 1), (10, 1)], "doc_id long, quality int")
    rows = N.scores(awkward, N.learned(awkward, labels)).collect()
    assert {r["score"] for r in rows} == {1.0}
    rows = N.scores(awkward, N.learned(awkward, labels.limit(0))).collect()
    assert {r["score"] for r in rows} == {0.5}


def test_a_class_cut_short_votes_the_more():
    counts = np.tile(N.term_counts("one and the same text of many words"), (4, 1))
    model = N.fit(counts, np.array([0, 0, 1, 1]), (2, 200))
    assert model.score(counts[:1])[0] == pytest.approx(200 / 202)
