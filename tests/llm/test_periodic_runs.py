"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tests.llm.conftest import pairs_of

from tidewire.llm import periodic_runs as P
from tidewire.llm.queries import op13_periodic_runs


def brute(words, least, times):
    """(start, length, period): for each period the stretches that keep it, the smallest period of each."""
    found = {}
    for period in range(1, len(words) // times + 1):
        i = 0
        while i + period < len(words):
            begin = i
            while i + period < len(words) and words[i] == words[i + period]:
                i += 1
            length = i + period - begin
            if i > begin and length >= max(least, times * period):
                found.setdefault((begin, length), period)
            i += i == begin
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def kept_of(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def repetitive(draw):
    words = []
    for _ in range(draw.randint(0, 5)):
        part = [draw.randint(0, draw.choice([0, 1, 2, 5])) for _ in range(draw.randint(1, 8))]
        words += (part * draw.randint(1, 9))[: draw.randint(1, 60)]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (4, 2), (6, 3), (10, 4)])
def test_runs_of_random_repetitions(least, times):
    draw = random.Random(least)
    for _ in range(400):
        documents = [repetitive(draw) for _ in range(draw.randint(1, 4))]
        assert P._of_documents(documents, least, times) == [
            brute(d, least, times) for d in documents
        ]


def test_fibonacci_words_and_one_symbol():
    """The word of most runs, and one run with every period."""
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for words in (b, [0] * 500):
        assert P._of_documents([words], 4, 2) == [brute(words, 4, 2)]


def test_suffix_array_against_sorting():
    draw = np.random.default_rng(2)
    for _ in range(100):
        symbols = np.append(draw.integers(0, 3, int(draw.integers(0, 40))), 9)
        order, rank, common = P.suffix_array(symbols)
        suffixes = [symbols[i:].tolist() for i in range(len(symbols))]
        assert order.tolist() == sorted(range(len(symbols)), key=suffixes.__getitem__)
        assert rank[order].tolist() == list(range(len(symbols)))
        for m in range(1, len(symbols)):
            x, y = suffixes[order[m - 1]], suffixes[order[m]]
            same = next(i for i, pair in enumerate(zip(x, y)) if pair[0] != pair[1])
            assert common[m] == same


def test_lookups_in_slices(monkeypatch):
    words = ([1, 2, 3] * 40 + [4]) * 5
    expected = P._of_documents([words], 24, 3)
    monkeypatch.setattr(P, "LOOKED_UP", 7)
    assert P._of_documents([words], 24, 3) == expected == [brute(words, 24, 3)]


def test_awkward_rows(frame, awkward):
    rows = pairs_of(awkward) + [(30, "x y z " * 20 + "\x0b tail"), (31, "é " * 30), (30, "x y z " * 20)]
    for block in (1, 200, P.BLOCK):
        got = P.collapse_runs(frame(rows), 6, 3, block).collect()
        expected = []
        for doc_id, text in rows:
            words = re.findall(r"[^\x20\x09-\x0D]+", text)
            found = brute(words, 6, 3)
            best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
            expected.append((doc_id, len(words), found, best, " ".join(kept_of(words, found))))
        got = [
            (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["kept"])
            for r in got
        ]
        assert sorted(got, key=str) == sorted(expected, key=str)


def test_no_rows(awkward):
    assert P.collapse_runs(awkward.limit(0)).count() == 0


def test_query_against_brute_force(spark, tables, documents):
    """The query's rows, words made periodic included, recomputed from the contract."""
    expected = []
    for doc_id, text in pairs_of(documents):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute(words, 24, 3)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
        expected.append(
            (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + (hashlib.sha256(lines.encode()).hexdigest(),)
            + (hashlib.sha256(" ".join(kept_of(words, found)).encode()).hexdigest(),)
        )
    got = sorted(map(tuple, op13_periodic_runs(spark, tables).collect()))
    assert got == sorted(expected)
    assert sum(r[1] > 0 for r in got) >= 5
