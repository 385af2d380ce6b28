"""Periodic runs of words, by branching tandem repeats in an enhanced suffix array."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewire.llm.common import lean, texts

#: Words whose suffixes are sorted together; a longer document is a block of its own.
BLOCK = 1 << 16
#: Suffixes looked up at once.
LOOKED_UP = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ROWS = (
    "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>,"
    " strongest struct<start:long,length:long,period:long>, kept string"
)

Run = tuple[int, int, int]


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the first place of its value."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(SA, ISA, LCP) of an array of numbers whose last one occurs nowhere else.

    Prefix doubling; only suffixes that still tie are sorted again. LCP[m] is
    the common prefix of the suffixes of ranks m - 1 and m, with -1 at both
    ends, found from the ranks of each doubling.
    """
    size = len(symbols)
    order = np.argsort(symbols, kind="stable").astype(np.int32)
    first = _groups(symbols[order])
    rank = np.empty(size, np.int32)
    rank[order] = first
    levels = [rank.copy()]
    step = 1
    tied = _tied(first)
    active, place = order[tied], np.flatnonzero(tied)
    while len(active):
        key = rank[active].astype(np.int64) * size + rank[active + step]
        by = np.argsort(key, kind="stable")
        active = active[by]
        # Groups keep their places, so the sorted ones fill these in turn.
        order[place] = active
        groups = _groups(key[by])
        rank[active] = place[groups]
        levels.append(rank.copy())
        step *= 2
        tied = _tied(groups)
        active, place = active[tied], place[tied]
    common = np.zeros(size + 1, np.int32)
    common[0] = common[size] = -1
    near = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    left, right = order[near - 1], order[near]
    along = np.zeros(len(near), np.int32)
    for level in range(len(levels) - 1, -1, -1):
        same = levels[level][left + along] == levels[level][right + along]
        along[same] += 1 << level
    common[near] = along
    return order, rank, common


def _tied(groups: np.ndarray) -> np.ndarray:
    """Which places of ``_groups`` share their group with another one."""
    alone = groups == np.arange(len(groups))
    alone[:-1] &= alone[1:]
    return ~alone


def _intervals(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(m, low, high) for each m with LCP[m] > 0: where its interval is cut, and its ends.

    Suffixes of ranks low..m-1 and of ranks m..high-1 share LCP[m] symbols
    and no more across m; an interval with c children is cut c - 1 times, each
    time before the first child not yet told apart. All ends jump together
    over ends already found, so there is no stack and no tree.
    """
    middle = np.flatnonzero(common > 0)
    depth = common[middle]
    ends = []
    for step, over in ((-1, np.greater), (1, np.greater_equal)):
        to = np.arange(len(common)) + step
        going = middle
        while len(going):
            at = to[going]
            going = going[over(common[at], common[going])]
            to[going] = to[to[going]]
        ends.append(to[middle])
    return middle, *ends, depth


def branching_squares(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, root length) of each square ``ww`` that can't be moved one symbol on.

    The symbol after the first ``w`` differs from the one after the second, so
    the two suffixes part exactly at the depth ``|w|`` of an LCP interval: for
    each interval the suffixes of the smaller side look whether the one
    ``depth`` symbols on, or back, is on the other side.
    """
    order, rank, common = suffix_array(symbols)
    middle, low, high, depth = _intervals(common)
    smaller = middle - low <= high - middle
    begin = np.where(smaller, low, middle)
    sizes = np.where(smaller, middle - low, high - middle)
    other_low, other_high = np.where(smaller, middle, low), np.where(smaller, high, middle)
    reach = np.cumsum(sizes)
    places, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    done = 0
    while done < len(middle):
        upto = int(np.searchsorted(reach, (reach[done - 1] if done else 0) + LOOKED_UP, "right"))
        part = slice(done, max(upto, done + 1))
        done = part.stop
        count = sizes[part]
        starts = np.cumsum(count) - count
        ranks = np.arange(int(count.sum())) - np.repeat(starts - begin[part], count)
        suffix = order[ranks].astype(np.int64)
        root = np.repeat(depth[part], count).astype(np.int64)
        lower, upper = np.repeat(other_low[part], count), np.repeat(other_high[part], count)
        on = rank[suffix + root]
        hit = (on >= lower) & (on < upper)
        back = suffix - root
        before = rank[np.maximum(back, 0)]
        from_back = (back >= 0) & (before >= lower) & (before < upper)
        places += [suffix[hit], back[from_back]]
        roots += [root[hit], root[from_back]]
    return np.concatenate(places), np.concatenate(roots)


def _rotated_back(symbols: np.ndarray, place: int, root: int) -> int:
    """The first place to which the square at ``place`` can be moved back, symbol by symbol."""
    width = 64
    while place:
        width = min(width, place)
        same = symbols[place - width : place] == symbols[place + root - width : place + root]
        if not same.all():
            return place - int(np.argmin(same[::-1]))
        place -= width
        width *= 2
    return 0


def runs(symbols: np.ndarray, least: int, times: int) -> list[Run]:
    """(start, length, period) of all runs in an array whose last symbol occurs once.

    A run is a stretch with that smallest period, of at least ``least`` symbols
    and ``times`` (2 at least) periods, that can't be extended.
    """
    places, roots = branching_squares(symbols)
    missing = np.maximum(least - 2 * roots, (times - 2) * roots)
    for back in range(1, 9):
        ask = missing >= back
        at = np.maximum(places - back, 0)
        good = ~ask | ((places >= back) & (symbols[at] == symbols[at + roots]))
        places, roots, missing = places[good], roots[good], missing[good]
    by = np.lexsort((roots, places + 2 * roots))
    found: list[Run] = []
    ended, own = -1, []
    for place, root, need in zip(places[by].tolist(), roots[by].tolist(), missing[by].tolist()):
        if (end := place + 2 * root) != ended:
            ended, own = end, []
        # A root that repeats a shorter one belongs to the shorter one's run.
        if any(root % period == 0 and start <= place for start, period in own):
            continue
        start = _rotated_back(symbols, place, root)
        own.append((start, root))
        if place - start >= need:
            found.append((start, end - start, root))
    return found


def _of_documents(documents: list[list[int]], least: int, times: int) -> list[list[Run]]:
    """The runs of each of several documents (numbers of words), sorted by start and period."""
    used = max((max(d) for d in documents if d), default=0) + 1
    ends = np.cumsum([len(d) + 1 for d in documents])
    symbols = np.empty(int(ends[-1]), np.int32)
    for k, (document, end) in enumerate(zip(documents, ends.tolist())):
        symbols[end - 1 - len(document) : end - 1] = document
        symbols[end - 1] = used + k  # an end that equals no other symbol: nothing crosses it
    found: list[list[Run]] = [[] for _ in documents]
    for start, length, period in sorted(runs(symbols, least, times), key=lambda r: (r[0], r[2])):
        k = int(np.searchsorted(ends, start, "right"))
        found[k].append((start - (int(ends[k - 1]) if k else 0), length, period))
    return found


def _kept(words: list[bytes], found: list[Run]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    if found:
        stay = (np.cumsum(gone[:-1]) == 0).tolist()
        words = [w for w, keep in zip(words, stay) if keep]
    return b" ".join(words).decode()


def _strongest(found: list[Run]) -> Run | None:
    """The run of the most periods, exactly; ties: the first start, then the shortest period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def _structs(found: list[Run | None]) -> pa.Array:
    return pa.array([r and dict(zip(("start", "length", "period"), r)) for r in found], RUN)


def collapse_runs(docs: DataFrame, least: int = 24, times: int = 3, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, runs, strongest and kept of every document.

    Words are what white space (blank, tab, LF, VT, FF, CR) leaves. ``runs``
    holds all maximal stretches of words of at least ``least`` words and
    ``times`` of their smallest period, by start and period; ``strongest`` the
    one with the most periods. ``kept`` is the words that no run holds after
    its first period, joined by one blank: each run collapses to one period.

    No shuffle: the suffixes of about ``block`` words of neighbouring documents
    are sorted together, ends apart; a longer document is a block of its own
    and takes some 100 bytes a word. Null or empty text: no words, no runs, an
    empty ``kept``. Null doc_id: kept. Repeated rows: a row each. No rows: no
    rows. Other columns are not looked at.
    """

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, documents in _blocks(batches, block):
            number: dict[bytes, int] = {}
            numbered = [[number.setdefault(w, len(number)) for w in d] for d in documents]
            found = _of_documents(numbered, least, times)
            flat = _structs([r for own in found for r in own])
            offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(list(map(len, documents)), pa.int64()),
                    pa.ListArray.from_arrays(offsets, flat),
                    _structs([_strongest(own) for own in found]),
                    pa.array([_kept(d, own) for d, own in zip(documents, found)], pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "strongest", "kept"],
            )

    return texts(docs).mapInArrow(lean(collapse), ROWS)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list]]:
    """(doc ids, their words) of neighbouring rows, about ``size`` words together."""
    ids: list = []
    held: list[list[bytes]] = []
    total = 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            words = text.as_py().encode().split()
            if held and total + len(words) > size:
                yield ids, held
                ids, held, total = [], [], 0
            ids.append(doc_id)
            held.append(words)
            total += len(words)
    if ids:
        yield ids, held
