import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import chunk as C


def sections_by_hand(text, limit, overlap, separators=C.SEPARATORS):
    """The stated contract, one piece at a time."""
    which = next(i for i, s in enumerate(separators) if s in text)
    separator, finer = separators[which], separators[which + 1 :]
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0]] + [separator + p for p in parts[1:]] if p]
    else:
        pieces = list(text)
    out, run = [], []

    def emit():
        joined = "".join(run).strip()
        if joined:
            out.append(joined)

    for piece in pieces:
        if len(piece) >= limit and finer:
            emit()
            run.clear()
            out.extend(sections_by_hand(piece, limit, overlap, finer))
            continue
        if run and sum(map(len, run)) + len(piece) > limit:
            emit()
            while run and (
                sum(map(len, run)) > overlap or sum(map(len, run)) + len(piece) > limit
            ):
                run.pop(0)
        run.append(piece)
    emit()
    return out


def random_texts(n, seed):
    pick = random.Random(seed)
    for i in range(n):
        alphabet = "ab  \n" if i % 2 else "abcdefgh \n"
        yield "".join(pick.choices(alphabet, k=pick.randint(0, 200)))


def test_sections_follow_the_contract(spark):
    texts = list(random_texts(1500, 3))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for limit, overlap in ((40, 10), (7, 3), (25, 0)):
        got = rows.select("i", C.sections(F.col("t"), limit, overlap).alias("s")).orderBy("i")
        for text, row in zip(texts, got.collect()):
            assert row.s == sections_by_hand(text, limit, overlap), repr(text)
            assert all(len(s) <= limit for s in row.s)


def test_words_survive_in_order_without_overlap():
    text = " ".join(f"w{i}" for i in range(3000))
    sections = C.split_sections(text, 400, 0)
    assert " ".join(sections).split() == text.split()
    overlapping = C.split_sections(text, 400, 100)
    for before, after in zip(overlapping, overlapping[1:]):
        assert before.split()[-1] in after.split()


def test_default_size_limit(spark):
    rows = spark.createDataFrame([("x" * 9000,), ("y " * 4500,), ("",)], "t string")
    got = [r.s for r in rows.select(C.sections(F.col("t")).alias("s")).collect()]
    assert max(len(s) for s in got[0] + got[1]) <= C.MAX_CHARS
    assert got[2] == []


def test_overlap_must_fit():
    with pytest.raises(ValueError):
        C.sections(F.lit("x"), 100, 100)


def test_token_windows(spark):
    text = "  ".join(f"t{i}" for i in range(10))
    rows = spark.createDataFrame([(1, text), (2, " \n ")], "k int, t string")
    out = C.explode_windows(rows, "t", "k", max_tokens=4).orderBy("k", "pos").collect()
    assert [(r.k, r.pos, r.text) for r in out] == [
        (1, 0, "t0 t1 t2 t3"), (1, 1, "t4 t5 t6 t7"), (1, 2, "t8 t9"), (2, 0, "")
    ]
    assert out[0].chunk_id == hashlib.md5(b"t0 t1 t2 t3").hexdigest()


def test_refine_and_chunk(spark):
    rows = spark.createDataFrame(
        [("d1", "title", "u", "2024-01-01 00:00:00", "s", "N/A", "N/A"),
         ("d2", "", "v", "2024-01-01 00:00:00", "s", "N/A", "one two three four five")],
        "article_id string, title string, url string, published_at string, source_name string,"
        "image_url string, description string",
    )
    refined = C.refine(rows)
    assert {r.full_text for r in refined.collect()} == {"title.N/A", ".one two three four five"}
    chunks = C.chunk(refined, max_tokens=2).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.text) for r in chunks] == [
        ("d1", 0, "title.N/A"), ("d2", 0, ".one two"), ("d2", 1, "three four"), ("d2", 2, "five")
    ]
    assert chunks[1].metadata.url == "v" and chunks[1].full_raw_text.startswith(".one")
    blank = refined.withColumn("full_text", F.lit("  "))
    assert C.chunk(blank).count() == 0


def test_windows_kept_for_a_store(spark):
    refined = spark.createDataFrame([("d", "a b a b c c", "m"), ("e", " ", "m")], "doc_id string, full_text string, metadata string")
    for keep, expected in (("all", ["a b", "a b", "c c"]), ("distinct", ["a b", "c c"]), ("last", ["c c"])):
        chunks = C.chunk(refined, max_tokens=2, keep=keep).orderBy("pos").collect()
        assert [r.text for r in chunks] == expected
