"""Removing repeated bytes and words, against brute force."""

import hashlib

import numpy as np
import pytest

from tests.llm.conftest import pairs_of, prose
from tidewire.llm import queries, repeats, substring_dedup, suffix_dedup


def in_order(docs):
    """Distinct (id, text) in the order of the operators: null first, then id, then hash."""
    import xxhash

    place = lambda x: (x[0] is not None, x[0] or 0, xxhash.xxh3_128_digest(x[1].encode())[:8])
    return sorted(set(pairs_of(docs)), key=place)


def covered(units, width, seen, table):
    """Which units some window covers that is in ``seen``; the others are added later."""
    flags = [False] * len(units)
    for at in range(len(units) - width + 1):
        window = units[at : at + width]
        if window in seen:
            flags[at : at + width] = [True] * width
        else:
            seen.add(window)
    return flags


def brute(docs, units_of, width):
    seen: set = set()
    return {
        (i, t): covered(units_of(t), width, seen, None) for i, t in in_order(docs)
    }


def check_bytes(rows, docs, length):
    expected = brute(docs, lambda t: t.encode(), length)
    assert len(rows) == docs.count()
    texts = {(i, hash_of(t)): t for i, t in expected}
    for r in rows:
        text = texts[(r["doc_id"], r["text_hash"])]
        flags = expected[(r["doc_id"], text)]
        data = text.encode()
        assert bytes(r["kept"]) == bytes(b for b, gone in zip(data, flags) if not gone)
        spans = [(s["begin"], s["end"]) for s in r["spans"]]
        assert sum(b - a for a, b in spans) == sum(flags)
        assert all(all(flags[a:b]) for a, b in spans)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:]))


def check_words(rows, docs, window):
    expected = brute(docs, lambda t: tuple(t.encode().split()), window)
    assert len(rows) == docs.count()
    texts = {(i, hash_of(t)): t for i, t in expected}
    for r in rows:
        text = texts[(r["doc_id"], r["text_hash"])]
        flags = expected[(r["doc_id"], text)]
        words = text.encode().split()
        assert (r["n_words"], r["removed"]) == (len(words), sum(flags))
        assert bytes(r["kept"]) == b" ".join(w for w, gone in zip(words, flags) if not gone)


def hash_of(text):
    import xxhash

    return int(np.array([xxhash.xxh64_intdigest(text.encode(), 42)], np.uint64).view(np.int64)[0])


def test_bytes_of_awkward_rows(awkward):
    check_bytes(suffix_dedup.remove_later_copies(awkward).collect(), awkward, 100)


def test_words_of_awkward_rows(awkward):
    check_words(substring_dedup.remove_repeated_windows(awkward).collect(), awkward, 20)


@pytest.mark.parametrize("block", [300, 1500])
def test_small_blocks_and_groups_change_nothing(frame, monkeypatch, block):
    """Repeats within a block, between blocks, and chains over several."""
    base = [prose(k, 120) for k in range(6)]
    rows = [(i, base[i % 6][i : i + 500] + " " + base[(i + 1) % 6][: 90 + 7 * i]) for i in range(24)]
    rows += [(100, base[0]), (99, base[0]), (101, base[0] + "!"), (98, base[3] * 2)]
    docs = frame(rows, pieces=4)
    batches = docs.select("doc_id", "text").coalesce(1).toArrow().to_batches()
    monkeypatch.setattr(repeats, "BLOCK", block)
    for method, check in (
        (suffix_dedup.LongestPreviousFactor(100), check_bytes),
        (substring_dedup.DifferenceCover(20), check_words),
    ):
        check(locally(batches, method), docs, 100 if check is check_bytes else 20)


def locally(batches, method):
    """The rounds of ``repeats`` in one process, with the blocks of BLOCK."""
    blocks = [
        (n, repeats.open_block(b))
        for batch in repeats._blocks(iter(batches))
        for n, b in zip(batch["block"].to_pylist(), batch["body"].to_pylist())
    ]
    assert len(blocks) > 3
    surveys = [method.survey(b) for _, b in blocks]
    keys, counts = np.unique(
        np.concatenate([np.unique(s.keys) for s in surveys]), return_counts=True
    )
    first = {}
    for _, b in blocks:
        for i, d in zip(b.ids.tolist(), b.digests.tolist()):
            first[tuple(d)] = min(i, first.get(tuple(d), i))
    starts, offers = [[] for _ in blocks], {}
    for k, ((_, b), s) in enumerate(zip(blocks, surveys)):
        copy = b.copy | np.array(
            [i > first[tuple(d)] for i, d in zip(b.ids.tolist(), b.digests.tolist())]
        )
        starts[k].append(method.settled(b, s, copy))
        for group, data in method.offer(b, s, np.isin(s.keys, keys[counts > 1]), copy):
            offers.setdefault(group, []).append((k, data))
    for own in offers.values():
        for (k, _), found in zip(own, method.earlier([d for _, d in own])):
            starts[k].append(found)
    return [
        row
        for (_, b), found in zip(blocks, starts)
        for row in method.finish(b, np.unique(np.concatenate(found)).astype(np.int64)).to_pylist()
    ]


def test_anchors_give_every_window_one_owner():
    text = (prose(1, 200) + "a" * 300 + prose(2, 50) * 2).encode()
    block = repeats.Block(np.array([1, 2]), np.array([0, 700, len(text)]), text)
    found = suffix_dedup.anchors(block, 100)
    owned = repeats.stretches(found.lows, found.counts)
    valid = [*range(0, 601), *range(700, len(text) - 99)]
    assert owned.tolist() == valid
    by_window = {}
    for low, count, key in zip(found.lows, found.counts, found.keys):
        for at in range(low, low + count):
            assert by_window.setdefault(text[at : at + 100], key) == key


def longest_before(raw, at, order, length):
    """Longest previous factors by comparing every pair."""
    found = []
    for i, own in zip(at, order):
        shared = [0]
        for j, other in zip(at, order):
            if other < own:
                k = 0
                while k < length and raw[i + k] == raw[j + k]:
                    k += 1
                shared.append(k)
        found.append(max(shared))
    return found


def test_longest_previous_factors_of_texts():
    draw = np.random.default_rng(4)
    texts = [b"abcabcabcabdabcabd" * 3, b"a" * 60, bytes(range(120)), prose(3, 30).encode() * 2]
    texts += [bytes(draw.integers(97, 97 + k, 150).tolist()) for k in (1, 2, 3, 20)]
    texts += [b" ".join(b"%06d" % k for k in range(30))]
    for raw in texts:
        text = np.frombuffer(raw, np.uint8)
        for length in (1, 3, 8, 9, 24, 30, 50):
            at = np.arange(len(text) - length + 1)
            ordered = [at, at[::-1].copy(), draw.permutation(len(at)), at // 2]
            for order in ordered:
                found = suffix_dedup.previous_factors(text, at, order, length)
                expected = longest_before(raw, at.tolist(), order.tolist(), length)
                assert found.tolist() == expected
                shortest = min(24, length)
                found = suffix_dedup.previous_factors(text, at, order, length, shortest)
                assert found.tolist() == [n if n >= shortest else 0 for n in expected]


def test_ranks_follow_the_first_bytes():
    text = np.frombuffer(b"abcabcabcabdabcabd" * 3, np.uint8)
    raw = text.tobytes()
    for length in (3, 5, 9, 12, 40):
        at = np.arange(len(text) - length + 1)
        ranks = suffix_dedup.Prefixes(text, length).of(at)
        order = sorted(at.tolist(), key=lambda i: raw[i : i + length])
        assert (np.diff(ranks[order].astype(np.int64)) >= 0).all()


def test_difference_cover_meets_every_pair_of_places():
    cover = substring_dedup.PLACES
    for i in range(13):
        for j in range(13):
            assert any((i + s) % 13 in cover and (j + s) % 13 in cover for s in range(13))


def test_runs_travel_whole():
    for places in ([], [0], [3, 4, 5, 9, 2**31]):
        places = np.array(places, np.int64)
        assert repeats.unpack_places(repeats.pack_places(places)).tolist() == places.tolist()


def test_cut_text_keeps_columns_and_whole_characters(spark):
    shared = "".join(chr(0xE0 + 7 * k % 24) for k in range(60))
    docs = spark.createDataFrame(
        [(1, shared + "x", "en", 61), (2, "x" + shared + "y", "fr", 62), (3, None, None, None)],
        "doc_id long, text string, lang string, n_chars long",
    )
    rows = {r["doc_id"]: r for r in suffix_dedup.without_later_copies(docs).collect()}
    assert rows[1]["text"] == shared + "x" and rows[1]["n_chars"] == 61
    assert rows[2]["text"] == "xy" and rows[2]["n_chars"] == 2 and rows[2]["lang"] == "fr"
    assert rows[3]["text"] is None


def test_empty_tables(frame):
    none = frame([])
    assert suffix_dedup.remove_later_copies(none).collect() == []
    assert substring_dedup.remove_repeated_windows(none).collect() == []
    with pytest.raises(ValueError):
        substring_dedup.remove_repeated_windows(none, 13)


def test_queries(spark, tables, documents):
    expected = brute(documents, lambda t: t.encode(), 100)
    rows = {r["doc_id"]: r for r in queries.op6_suffix_dedup(spark, tables).collect()}
    assert len(rows) == len(expected)
    for (doc_id, text), flags in expected.items():
        kept = bytes(b for b, gone in zip(text.encode(), flags) if not gone)
        runs = sum(f and not (k and flags[k - 1]) for k, f in enumerate(flags))
        r = rows[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(flags), sum(flags), runs)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    rows = {r["doc_id"]: r for r in queries.op8_difference_cover(spark, tables).collect()}
    for (doc_id, text), flags in brute(documents, lambda t: tuple(t.encode().split()), 20).items():
        kept = b" ".join(w for w, gone in zip(text.encode().split(), flags) if not gone)
        r = rows[doc_id]
        assert (r["n_words"], r["n_removed"]) == (len(flags), sum(flags))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
