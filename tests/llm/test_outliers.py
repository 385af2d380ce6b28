"""Outliers in one feature, small groups, and the estimates against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tidewire.llm import quality


def test_partly_junk_words_and_repeated_lines_are_rejected(frame):
    draw = random.Random(6)
    ordinary = [(i, prose(i, draw.randint(60, 400))) for i in range(600)]
    junk = [
        (1000 + i, " ".join(w + "%%%" * (draw.random() < 0.4) for w in prose(i, 150).split()))
        for i in range(30)
    ]
    lines = []
    for i in range(30):
        words = prose(5000 + i, 60).split()
        pairs = [" ".join(words[k : k + 2]) for k in range(0, 60, 2)]
        lines.append((2000 + i, "\n".join(draw.choices(pairs, k=60))))
    docs = frame(ordinary + junk + lines)
    docs = docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit("web"))
    rows = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert all(rows[i]["kept"] for i, _ in ordinary)
    assert not any(rows[i]["base_failed"] for i, _ in junk + lines)
    assert not any(rows[i]["kept"] for i, _ in junk)
    assert not any(rows[i]["kept"] for i, _ in lines)


def brute_fit(x):
    """Three starts, C-steps over bins of distance until the determinant stands still."""
    floors = np.diag((quality.UNIT * np.array(quality.FLOORS)) ** 2)
    low, middle, high = np.percentile(x, [25, 50, 75], axis=0)
    starts = [
        (middle, np.diag(((high - low) / 1.349) ** 2)),
        (middle, np.zeros((6, 6))),
        (x.mean(0), np.cov(x.T, bias=True)),
    ]
    found = []
    for center, spread in starts:
        last = np.inf
        while True:
            off = x - center
            far = np.floor(np.log2((off @ np.linalg.inv(spread + floors) * off).sum(1) + 2**-10) * 32)
            # Whole bins from the nearest on, and of the last the share that makes 75%.
            nearer = np.array([(far < f).sum() for f in far])
            same = np.array([(far == f).sum() for f in far])
            weight = np.clip((0.75 * len(x) - nearer) / same, 0, 1)
            mean = weight @ x / weight.sum()
            cov = ((x - mean) * weight[:, None]).T @ (x - mean) / weight.sum()
            cov = cov * quality.CONSISTENT
            logdet = np.linalg.slogdet(cov + floors)[1]
            if not logdet < last - quality.GAIN:
                break
            center, spread, last = mean, cov, logdet
        found.append((last, center, spread))
    return min(found, key=lambda f: f[0])


def brute_distances(rows):
    """Distance of every row: groups, languages and all rows mixed by their moments."""
    x = np.array([[r[f] for f in quality.FEATURES] for r in rows], float)
    keys = [[("all",), ("l", r["lang"]), ("g", r["lang"], r["source"])] for r in rows]
    fits, places = {}, {}
    for k, own in enumerate(keys):
        for key in own:
            places.setdefault(key, []).append(k)
    for key, at in places.items():
        fits[key] = (len(at), *brute_fit(x[at])[1:])
    floors = np.diag((quality.UNIT * np.array(quality.FLOORS)) ** 2)
    distances = []
    for row, own in zip(x, keys):
        _, center, spread = fits[own[0]]
        for key in own[1:]:
            n, mean, cov = fits[key]
            w = n / (n + quality.PRIOR)
            between = np.outer(mean - center, mean - center)
            spread = w * cov + (1 - w) * spread + w * (1 - w) * between
            center = w * mean + (1 - w) * center
        off = row - center
        distances.append(off @ np.linalg.inv(spread + floors) @ off)
    return np.array(distances)


def test_verdicts_equal_brute_force(spark, documents):
    measured = quality.measured(documents).where("NOT base_failed").collect()
    expected = dict(zip([r["doc_id"] for r in measured], brute_distances(measured)))
    limit = quality._chi2_point(1 - quality.RISK, 6)
    judged = [r for r in quality.quality(documents).collect() if not r["base_failed"]]
    assert len(judged) == len(expected) == len(measured)
    for r in judged:
        assert r["distance"] == pytest.approx(expected[r["doc_id"]], rel=1e-6)
        assert r["kept"] == (expected[r["doc_id"]] <= limit)


def test_every_group_has_its_own_model(documents):
    good = quality._levels(quality.measured(documents).where("NOT base_failed"))
    groups = {r["own"] for r in good.select("own").collect()}
    rows = quality.models(good).collect()
    assert {r["own"] for r in rows} == groups and len(rows) == len(groups) > 1
    # Groups of a single row each may hold copies of one text.
    assert len({r["c0"] for r in rows}) > 0.9 * len(groups)


def test_small_groups_judge_by_their_language(frame):
    """Junk is rejected in groups of one row; ordinary rows stay, however small their group."""
    draw = random.Random(9)
    ordinary = [(i, prose(i, draw.randint(60, 400))) for i in range(600)]
    junk = [(1000 + i, " ".join(w + "%%%" for w in prose(i, 150).split())) for i in range(4)]
    docs = frame(ordinary + junk).withColumn("lang", F.lit("en"))
    alone = (F.col("doc_id") >= 1000) | (F.col("doc_id") < 20)
    docs = docs.withColumn("source", F.when(alone, F.col("doc_id").cast("string")).otherwise("web"))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    assert all(kept[i] for i, _ in ordinary)
    assert not any(kept[i] for i, _ in junk)
