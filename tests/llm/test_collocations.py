"""Collocations against a count of every phrase in plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import collocations as C

CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, first):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(CAPITALS)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    found = []
    for lang, own in counts.items():
        good = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored, inside = [], defaultdict(int)  # the most frequent phrase that holds another
        for longer, f in good.items():
            for size in range(2, len(longer)):
                for i in range(len(longer) - size + 1):
                    part = longer[i : i + size]
                    inside[part] = max(inside[part], f)
        for phrase, a in good.items():
            if phrase in inside and 100 * inside[phrase] >= 80 * a:
                continue
            cuts = [
                (2_000_000 * a // (own[phrase[:k]] + own[phrase[k:]]), k, own[phrase[:k]], own[phrase[k:]])
                for k in range(1, len(phrase))
            ]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(phrase).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(found)


def rows_of(docs):
    return [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]


def test_awkward_rows(awkward):
    """Nulls, ties, repeats, a clash of names; blocks and bitmaps so small that much goes wrong."""
    rows = rows_of(awkward)
    for settings in ({}, {"filter_bits": 15, "block": 500}):
        found = C.collocations(awkward, least=3, first=40, **settings)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, found.collect())) == brute(rows, 3, 4, 40)


def test_more_than_the_map_side_limit(documents):
    """So many that the groups are split before they are ranked."""
    found = C.collocations(documents, least=2, first=1500)
    assert sorted(map(tuple, found.collect())) == brute(rows_of(documents), 2, 4, 1500)


def test_other_lengths(awkward):
    for longest in (2, 3, 5):
        found = C.collocations(awkward, least=4, longest=longest, first=30)
        assert sorted(map(tuple, found.collect())) == brute(rows_of(awkward), 4, longest, 30)


def test_empty_and_wordless(frame, awkward):
    assert C.collocations(awkward.limit(0)).count() == 0
    assert C.collocations(frame([(1, " .,\t!"), (2, None), (3, "")]), least=1).count() == 0


def test_stretches_cover_each_phrase_once():
    draw = np.random.default_rng(3)
    for _ in range(300):
        text = bytes(draw.choice(list(b"ab \n"), int(draw.integers(0, 60)), p=[0.35, 0.3, 0.3, 0.05]))
        for size in (1, 5, 20):
            block = C.Block("x", list(C.stretches(text, 3, size)))
            whole = C.Block("x", [(text, b"")])
            for length in (1, 2, 3):
                cut, uncut = (
                    Counter(dict(zip(*b.phrases(b.places(length), length)))) for b in (block, whole)
                )
                assert cut == uncut


def test_bitmap_has_the_bits_of_its_slots(spark):
    values = [5, -1, 32_767, 32_768, 70_000, -(2**63), 2**63 - 1, 5]
    rows = spark.createDataFrame([(v,) for v in values], "slot long")
    bits = C._bits(rows, 17)
    expected = {v % (1 << 17) for v in values}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist()) == expected
    assert not C._bits(rows.limit(0), 15).any()


def test_products_beyond_64_bits(spark):
    """A count of 10 ** 15 times the scale leaves 64 bits; the division is exact."""
    many = 10**15
    streams = [
        [("en", "a", many + 7), ("en", "b", many + 11)],
        [("en", "a b", many + 3)],
    ]
    frames = [spark.createDataFrame(s, "lang string, phrase string, f long") for s in streams]
    totals = spark.createDataFrame([("en", 3 * many)], "lang string, n long")
    row = C.ranked(totals, frames, first=5, within=80, scale=2_000_000).first()
    assert row["score"] == 2_000_000 * (many + 3) // (2 * many + 18)


def test_streams_meet_in_merge_joins(awkward, plan_of):
    totals, streams = C.phrase_counts(awkward, 3)
    none = F.array().cast("array<long>")
    known = streams[0].select("*", none.alias("lefts"), none.alias("rights"))
    plan = plan_of(C._with_parts(streams[1], known))
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin" not in plan
