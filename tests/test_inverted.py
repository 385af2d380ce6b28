"""Search by the inverted index against the scan, which is tested by itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewire.operators import inverted as I
from tidewire.operators import search as S


def texts(spark, rows, parts=4):
    return spark.createDataFrame(rows, "doc_id long, cleaned string").repartition(parts)


def asked(spark, rows):
    return spark.createDataFrame(rows, "q long, text string")


def topical(count, seed=3):
    """Texts of twelve topics with words of their own, of many lengths, some of them copies."""
    draw = random.Random(seed)
    rows = []
    for i in range(count):
        topic = i % 12
        words = [f"t{topic}w{int(draw.paretovariate(0.8)) % 60}" for _ in range(draw.randint(3, 60))]
        rows.append((i, " ".join(words)))
    rows += [(count + i, rows[5][1]) for i in range(30)]
    return rows


def by_key(hits):
    return sorted((r.q, r["rank"], r.doc_id, r.score) for r in hits.collect())


def both(spark, tmp_path, rows, questions, dimensions, k=10, block_rows=8):
    index = I.write_index(
        texts(spark, rows), str(tmp_path / f"i{dimensions}"), text="cleaned", keys=("doc_id",),
        dimensions=dimensions, block_rows=block_rows,
    )
    found = I.search_index(index, asked(spark, questions), k, question="q")
    scan = S.search_text(
        texts(spark, rows), asked(spark, questions), k, text="cleaned", ties=("doc_id",),
        question="q", dimensions=dimensions,
    )
    return found, scan


@pytest.mark.parametrize("dimensions", [384, 1 << 18])
def test_hits_of_the_scan_and_few_postings(spark, tmp_path, dimensions):
    rows = topical(600)
    questions = [(i, rows[7 * i + 1][1]) for i in range(25)] + [(90, "t1w1 t2w2 unheard"), (91, "...")]
    found, scan = both(spark, tmp_path, rows, questions, dimensions)
    assert by_key(found.hits) == by_key(scan)
    assert len(by_key(found.hits)) == 26 * 10  # the blank question has none
    assert found.share_read() <= 1


def test_a_high_kth_score_leaves_blocks_unread(spark, tmp_path):
    """With ten copies of the question few other blocks can reach its k-th score."""
    draw = random.Random(8)
    rows = [(i, " ".join(draw.sample([f"w{n}" for n in range(90)], 6))) for i in range(600)]
    rows += [(600 + i, rows[5][1]) for i in range(20)]
    found, scan = both(spark, tmp_path, rows, [(0, rows[5][1])], 1 << 18)
    assert by_key(found.hits) == by_key(scan)
    assert found.share_read() < 0.75  # a third of the postings are the copies' own


def test_zero_scores_fewer_texts_than_k_and_blank_ones(spark, tmp_path):
    """A text without a common word is still a neighbour; blank texts are none."""
    rows = [(1, "a b c"), (2, "d e"), (3, ""), (4, "f"), (5, "a a d"), (6, " ")]
    questions = [(1, "a"), (2, "nowhere"), (3, "d d e"), (4, None)]
    found, scan = both(spark, tmp_path, rows, questions, 1 << 18, block_rows=2)
    assert by_key(found.hits) == by_key(scan)
    assert len(by_key(found.hits)) == 3 * 4


def test_questions_in_several_sendings_and_groups(spark, tmp_path, monkeypatch):
    rows = topical(200)
    questions = [(i, rows[3 * i][1]) for i in range(40)]
    monkeypatch.setattr(I, "SENT_WORDS", 200)
    monkeypatch.setattr(I, "GROUP_PAIRS", 3)
    monkeypatch.setattr(I, "GROUP_BITS", 2)
    found, scan = both(spark, tmp_path, rows, questions, 384, k=5)
    assert by_key(found.hits) == by_key(scan)
    assert found.hits.inputFiles().__len__() > 1


def test_words_of_one_product_are_cut(monkeypatch):
    """A block's scores are the same however many questions are multiplied at once."""
    member = [{"place": i, "squares": s, "doc_id": i} for i, s in enumerate((5, 1, 2))]
    here = pa.table(
        {
            "block": [0, 0, 0],
            "bucket": [4, I.HEAD, 9],
            "entries": [[{"place": 0, "tf": 2}, {"place": 1, "tf": 1}], None, [{"place": 0, "tf": 1}, {"place": 2, "tf": 1}]],
            "members": [None, member, None],
        }
    )
    terms = [[{"bucket": 4, "tf": 1}], [{"bucket": 9, "tf": 3}, {"bucket": 11, "tf": 4}], [{"bucket": 4, "tf": 1}, {"bucket": 9, "tf": 1}]]
    there = pa.table({"_no": [7, 8, 9], "terms": terms, "squares": pa.array([1, 25, 2], pa.int64())})
    ranking = S.Ranking(2, ("doc_id",))
    expected = None
    for together in (4096, 1, 2):
        monkeypatch.setattr(I, "TOGETHER_WORDS", together)
        rows = sorted(map(tuple, I._of_block(here, there, ranking).to_pandas().to_numpy().tolist()))
        expected = expected or rows
        assert rows == expected
    scores = {(n, d): s for n, s, d in expected}
    assert scores[7, 1] == 1 and scores[7, 0] == 2 / 5**0.5
    assert scores[9, 0] == 3 / (5**0.5 * 2**0.5) and scores[8, 2] == 3 / (2**0.5 * 5)


def test_bounds_hold_for_every_article(spark, tmp_path):
    rows = topical(150)
    index = I.write_index(
        texts(spark, rows), str(tmp_path / "i"), text="cleaned", keys=("doc_id",), block_rows=6
    )
    found = I.search_index(index, asked(spark, [(0, rows[3][1])]), 200, question="q")
    score = {r.doc_id: r.score for r in found.hits.collect()}
    sent = I._sent(found.asked.toArrow(), {})
    blocks = index.blocks().collect()
    assert sum(len(b.members) for b in blocks) == len(rows)
    for block in blocks:
        bound = sent.bounds(np.array(block.buckets), np.array(block.largest))[0]
        assert max(score[m.doc_id] for m in block.members) <= bound + I.SLACK


def test_empty_tables(spark, tmp_path):
    none, one = texts(spark, []), asked(spark, [(1, "a b")])
    index = I.write_index(none, str(tmp_path / "none"), text="cleaned", keys=("doc_id",))
    assert I.search_index(index, one, question="q").hits.count() == 0
    index = I.write_index(texts(spark, [(1, "a")]), str(tmp_path / "one"), text="cleaned", keys=("doc_id",))
    found = I.search_index(index, one.limit(0), question="q")
    assert found.hits.count() == 0 and found.share_read() == 0


def test_only_wanted_postings_are_shuffled(spark, tmp_path, plan_of):
    index = I.write_index(
        texts(spark, topical(100)), str(tmp_path / "i"), text="cleaned", keys=("doc_id",), block_rows=8
    )
    found = I.search_index(index, asked(spark, [(0, "t1w1")]), 3, question="q")
    plan = plan_of(I._scored(index, found.read, found.asked, 3))
    assert "LeftSemi" in plan
    bounds = plan_of(index.blocks().select("block", "buckets", "largest"))
    assert "members" not in bounds
    assert isinstance(found.hits.select(F.max("rank")).first()[0], int)
