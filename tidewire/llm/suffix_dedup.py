"""Removing later copies of long byte strings by longest-previous-factor arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, with_text
from tidewire.llm.repeats import (
    GROUPS,
    Block,
    cover,
    deal,
    packed,
    ranked,
    repeats,
    runs,
    stretches,
    unpacked,
)

#: Bytes hashed for an anchor. Each window of ``length`` bytes holds length - ANCHOR + 1 of them.
ANCHOR = 50
#: Bytes that two suffixes need in common to count as one's previous factor.
SHORTEST = 24
#: Bytes of text hashed at once, and positions of one suffix array.
PART, SUFFIXES = 1 << 19, 2_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each position on."""
    with np.errstate(over="ignore"):
        power, step = ODD, 1
        doubled = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        hashes, done, rest = None, 0, size
        while rest:
            if rest & 1:
                if hashes is None:
                    hashes = doubled
                else:
                    count = len(data) - done - step + 1
                    hashes = hashes[:count] * power + doubled[done : done + count]
                done += step
            rest >>= 1
            if rest:
                doubled = doubled[: len(doubled) - step] * power + doubled[step:]
                power, step = power * power, 2 * step
        hashes = hashes ^ (hashes >> np.uint64(31))
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
        return hashes ^ (hashes >> np.uint64(29))


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    step, held = 1, values
    while 2 * step <= width:
        held, step = pick(held[:-step], held[step:]), 2 * step
    rest = width - step
    return pick(held[: len(held) - rest], held[rest:]) if rest else held


@dataclass
class Anchors:
    """Minimizers: the least hash in each window, the leftmost of equal ones.

    ``keys[i]`` is an anchor's hash; the windows that have it as their own
    start at ``lows[i]`` and the ``counts[i] - 1`` places behind.
    """

    keys: np.ndarray
    lows: np.ndarray
    counts: np.ndarray

    def some(self, chosen: np.ndarray) -> Anchors:
        return Anchors(self.keys[chosen], self.lows[chosen], self.counts[chosen])


def _part_anchors(data: np.ndarray, valid: np.ndarray, length: int) -> Anchors:
    width = length - ANCHOR + 1
    hashes = gram_hashes(data, ANCHOR)
    least = sliding(hashes, width, np.minimum)
    least = np.where(valid[: len(least)], least, 0)
    margin = np.zeros(width - 1, np.uint64)
    most = sliding(np.concatenate([margin, least, margin]), width, np.maximum)
    places = np.flatnonzero(most == hashes)
    starts = np.flatnonzero(valid[: len(least)])
    own, wanted = np.searchsorted(places, starts), least[starts]
    wrong = np.flatnonzero(hashes[places[own]] != wanted) if len(own) else own
    while len(wrong):
        own[wrong] += 1
        wrong = wrong[hashes[places[own[wrong]]] != wanted[wrong]]
    new = np.flatnonzero(np.diff(own, prepend=-1))
    return Anchors(
        hashes[places[own[new]]], starts[new], np.diff(np.append(new, len(starts)))
    )


def anchors(block: Block, length: int) -> Anchors:
    """The anchors of a block's texts; no window reaches from one text into the next."""
    found, first, count = [], 0, len(block.ids)
    bounds = block.bounds
    data = np.frombuffer(block.data, np.uint8)
    while first < count:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PART, "right")) - 1)
        begin, end = int(bounds[first]), int(bounds[last])
        if end - begin >= length:
            valid = np.zeros(end - begin, bool)
            for a, b in zip(bounds[first:last].tolist(), bounds[first + 1 : last + 1].tolist()):
                if b - a >= length:
                    valid[a - begin : b - begin - length + 1] = True
            if valid.any():
                part = _part_anchors(data[begin:end], valid, length)
                found.append(Anchors(part.keys, part.lows + begin, part.counts))
        first = last
    if not found:
        return Anchors(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Anchors(*(np.concatenate([getattr(f, k) for f in found]) for k in ("keys", "lows", "counts")))


def merged(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and sizes of the union of stretches given by ascending begins."""
    if not len(begins):
        return begins, sizes
    reach = np.maximum.accumulate(begins + sizes)
    new = np.flatnonzero(np.concatenate([[True], begins[1:] > reach[:-1]]))
    return begins[new], reach[np.append(new[1:], len(begins)) - 1] - begins[new]


def _rank(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values)
    ordered = values[order]
    rank = np.empty(len(values), np.uint64)
    rank[order[:1]] = 0
    rank[order[1:]] = np.cumsum(ordered[1:] != ordered[:-1])
    return rank


@dataclass
class Prefixes:
    """Suffixes in the order of their first ``length`` bytes, which each of them has.

    ``ranks`` of the whole text by 8 bytes, then 24 and 72 (prefix tripling from
    the ranks of the parts); ``heads`` are the first bytes themselves.
    """

    text: np.ndarray
    length: int

    def __post_init__(self) -> None:
        known = self.head = min(8, self.length)
        count = len(self.text) - known + 1
        self.heads = np.zeros(count, np.uint64)
        for k in range(known):
            self.heads = (self.heads << np.uint64(8)) | self.text[k : count + k]
        self.bits = max(1, len(self.text).bit_length())
        self.ways = 3 if 3 * self.bits <= 64 else 2
        self.ranks = [(known, _rank(self.heads))]
        while self.ways * known < self.length:
            rank = self.ranks[-1][1]
            joined = self._joined(rank, known, len(rank) - (self.ways - 1) * known)
            known *= self.ways
            self.ranks.append((known, _rank(joined)))

    def _joined(self, rank: np.ndarray, known: int, count: int) -> np.ndarray:
        joined = rank[:count]
        for k in range(1, self.ways):
            joined = (joined << np.uint64(self.bits)) | rank[k * known : k * known + count]
        return joined

    def of(self, at: np.ndarray) -> np.ndarray:
        """Rank of the suffixes at ``at``: two or three parts that overlap make the whole length."""
        known, rank = self.ranks[-1]
        joined = rank[at]
        if known == self.length:
            return joined
        middles = [known] if 2 * known < self.length else []
        for step in [*middles, self.length - known]:
            joined = (joined << np.uint64(self.bits)) | rank[at + step]
        return joined

    def common(self, left: np.ndarray, right: np.ndarray, shortest: int = 1) -> np.ndarray:
        """Longest common prefix of pairs of suffixes that differ within ``length`` bytes.

        One below ``shortest`` is 0; a comparison of ranks tells most of those.
        """
        found = np.zeros(len(left), np.int64)
        for known, rank in self.ranks[::-1]:
            if known <= shortest:
                near = np.flatnonzero(rank[left] == rank[right])
                found[near] = self._common(left[near], right[near])
                break
        else:
            found = self._common(left, right)
        found[found < shortest] = 0
        return found

    def _common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = np.zeros(len(left), np.int64)
        todo = np.arange(len(left))
        for known, rank in reversed(self.ranks):
            ahead = todo
            while len(ahead):
                done = found[ahead]
                fits = done + known <= self.length
                ahead, done = ahead[fits], done[fits]
                ahead = ahead[rank[left[ahead] + done] == rank[right[ahead] + done]]
                found[ahead] += known
        # The first byte that differs lies in the next few, or in the last ones of the length.
        found = np.minimum(found, self.length - self.head)
        mixed = self.heads[left + found] ^ self.heads[right + found]
        for k in range(self.head - 1, 0, -1):
            found += mixed < np.uint64(1) << np.uint64(8 * k)
        return found


def smaller_before(places: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The common prefix with the nearest entry before that has a smaller place; none: 0.

    ``lcp[i]`` is that of entries i - 1 and i. All entries jump at once: what
    lies between an entry and ``link[entry]`` is never smaller, so while the
    linked place isn't smaller either, that one's own link is taken over. An
    entry that has nothing in common any more stops.
    """
    link = np.arange(-1, len(places) - 1)
    least = lcp.copy()
    least[:1] = 0
    moving = np.arange(1, len(places))
    moving = moving[(least[moving] > 0) & (places[link[moving]] >= places[moving])]
    while len(moving):
        over = link[moving]
        link[moving], least[moving] = link[over], np.minimum(least[moving], least[over])
        moving = moving[least[moving] > 0]
        moving = moving[places[link[moving]] >= places[moving]]
    return least


def previous_factors(
    text: np.ndarray, at: np.ndarray, order: np.ndarray, length: int, shortest: int = 1
) -> np.ndarray:
    """The longest previous factor at each of ``at``, from ``shortest`` up to ``length`` bytes.

    The most bytes from there on that also start at one of ``at`` with a smaller
    ``order``, which is the place in the table. In suffix order the previous and
    the next smaller place share most with a suffix; the smaller of the common
    prefixes on the way is theirs. Suffixes with equal first ``length`` bytes are
    one entry at their smallest place: for the others that is an earlier one with
    ``length`` bytes in common. A factor below ``shortest`` bytes is 0.
    """
    if not len(at):
        return np.zeros(0, np.int64)
    prefixes = Prefixes(text, length)
    rank = prefixes.of(at)
    by = np.argsort(rank)
    own = rank[by]
    new = np.concatenate([[True], own[1:] != own[:-1]])
    firsts = np.flatnonzero(new)
    places = np.minimum.reduceat(order[by], firsts)
    heads = at[by[firsts]]
    lcp = np.concatenate([[0], prefixes.common(heads[:-1], heads[1:], shortest)])
    factors = smaller_before(places, lcp)
    turned = np.concatenate([[0], lcp[:0:-1]])
    np.maximum(factors, smaller_before(places[::-1].copy(), turned)[::-1], out=factors)
    entry = np.cumsum(new) - 1
    found = np.empty(len(at), np.int64)
    found[by] = np.where(order[by] > places[entry], length, factors[entry])
    return found


def first_of_equal(
    text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, order: np.ndarray
) -> np.ndarray:
    """For each stretch of ``text`` the one equal to it that comes first in ``order``."""
    raw = text.tobytes()
    edges = zip(begins.tolist(), (begins + sizes).tolist())
    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in edges), "<u8")
    high, low = digests[::2], digests[1::2]
    by = np.lexsort((order, low, high))
    new = np.concatenate([[True], (np.diff(high[by]) != 0) | (np.diff(low[by]) != 0)])[: len(by)]
    first = np.empty(len(by), np.int64)
    first[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return first


def _in_turns(size: int, keys: np.ndarray) -> Iterator[np.ndarray]:
    """Split contexts of ``size`` bytes into sets of about SUFFIXES; equal keys stay together."""
    turns = 1 + size // SUFFIXES
    for _, chosen in deal((keys % np.uint64(turns)).astype(np.int64)):
        yield chosen


@dataclass
class Survey:
    anchors: Anchors
    repeated: np.ndarray

    @property
    def keys(self) -> np.ndarray:
        return self.anchors.keys


@dataclass
class LongestPreviousFactor:
    """The method's part of the rounds in ``repeats``."""

    length: int = 100
    schema: str = (
        "doc_id long, text_hash long, n_bytes long, spans array<struct<begin: int, end: int>>,"
        " kept binary"
    )

    def _order(self, block: Block, starts: np.ndarray) -> np.ndarray:
        document = np.searchsorted(block.bounds, starts, "right") - 1
        return (block.rank[document] << 32) + starts - block.bounds[document]

    def _factors(self, text: np.ndarray, at: np.ndarray, order: np.ndarray) -> np.ndarray:
        return previous_factors(text, at, order, self.length, min(SHORTEST, self.length))

    def _windows(self, block: Block, chosen: np.ndarray) -> np.ndarray:
        """The starts of all windows of the chosen documents."""
        sizes = np.maximum(np.diff(block.bounds) - self.length + 1, 0)
        return stretches(block.bounds[:-1][chosen], sizes[chosen])

    def survey(self, block: Block) -> Survey:
        """Anchors with windows that nothing earlier in the block repeats."""
        all_anchors = anchors(block, self.length)
        document = np.searchsorted(block.bounds, all_anchors.lows, "right") - 1
        own = all_anchors.some(~block.copy[document])
        repeated = np.zeros(len(block.data) + 1, bool)
        repeated[self._windows(block, block.copy)] = True
        order = np.argsort(own.keys, kind="stable")
        same = own.keys[order][1:] == own.keys[order][:-1]
        several = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        suspects = own.some(np.sort(several))
        data = np.frombuffer(block.data, np.uint8)
        sizes = suspects.counts + self.length - 1
        whole = int(merged(suspects.lows, sizes)[1].sum())
        for chosen in _in_turns(whole, suspects.keys >> np.uint64(48)):
            begins, lengths = merged(suspects.lows[chosen], sizes[chosen])
            starts = stretches(suspects.lows[chosen], suspects.counts[chosen])
            own_part = np.searchsorted(begins, starts, "right") - 1
            at = starts - begins[own_part] + (np.cumsum(lengths) - lengths)[own_part]
            text = data[stretches(begins, lengths)]
            factors = self._factors(text, at, self._order(block, starts))
            repeated[starts[factors >= self.length]] = True
        fresh = np.concatenate([[0], np.cumsum(~repeated)])
        left = fresh[own.lows + own.counts] > fresh[own.lows]
        return Survey(own.some(left), repeated)

    def settled(self, block: Block, survey: Survey, copy: np.ndarray) -> np.ndarray:
        survey.repeated[self._windows(block, copy)] = True
        return np.flatnonzero(survey.repeated)

    def offer(
        self, block: Block, survey: Survey, shared: np.ndarray, copy: np.ndarray
    ) -> Iterator[tuple[int, bytes]]:
        document = np.searchsorted(block.bounds, survey.anchors.lows, "right") - 1
        asked = survey.anchors.some(shared & ~copy[document])
        document = document[shared & ~copy[document]]
        data = np.frombuffer(block.data, np.uint8)
        for group, chosen in deal((asked.keys % np.uint64(GROUPS)).astype(np.int64)):
            some = asked.some(chosen)
            place, documents = block.order_of(document[chosen])
            yield (
                group,
                packed(
                    *documents,
                    block.bounds[np.unique(document[chosen])].astype("<i8"),
                    place.astype("<u4"),
                    (some.keys >> np.uint64(48)).astype("<u2"),
                    some.lows.astype("<u4"),
                    some.counts.astype("<u2"),
                    data[stretches(some.lows, some.counts + self.length - 1)],
                    level=3,
                ),
            )

    def earlier(self, offers: list[bytes]) -> list[np.ndarray]:
        if not offers:
            return []
        kinds = ("<i8", "<u8", "<i8", "<u4", "<u2", "<u4", "<u2", "u1")
        each = [unpacked(o, *kinds) for o in offers]
        ranks = ranked([(e[0], e[1]) for e in each])
        order = np.concatenate(
            [
                (rank[place] << 32) + low.astype(np.int64) - first[place]
                for rank, (_, _, first, place, _, low, _, _) in zip(ranks, each)
            ]
        )
        keys, lows, counts, text = (np.concatenate([e[k] for e in each]) for k in (4, 5, 6, 7))
        offered = np.repeat(np.arange(len(each)), [len(e[4]) for e in each])
        lows, counts = lows.astype(np.int64), counts.astype(np.int64)
        sizes = counts + self.length - 1
        begins = np.cumsum(sizes) - sizes
        first = first_of_equal(text, begins, sizes, order)
        repeated = order > order[first]
        # Windows of stretches that are equal as a whole are compared once, at the earliest.
        offsets = np.cumsum(counts) - counts
        found = np.zeros(int(counts.sum()), bool)
        alone = np.flatnonzero(first == np.arange(len(first)))
        for some in _in_turns(int(sizes[alone].sum()), keys[alone].astype(np.uint64)):
            chosen = alone[some]
            own_sizes, own_counts = sizes[chosen], counts[chosen]
            part = text[stretches(begins[chosen], own_sizes)]
            at = stretches(np.cumsum(own_sizes) - own_sizes, own_counts)
            places = stretches(order[chosen], own_counts)
            factors = self._factors(part, at, places)
            found[stretches(offsets[chosen], own_counts)] = factors >= self.length
        found = found[stretches(offsets[first], counts)] | np.repeat(repeated, counts)
        starts = stretches(lows, counts)[found]
        source = np.repeat(offered, counts)[found]
        answers = [np.zeros(0, np.int64) for _ in each]
        for k, members in deal(source):
            answers[k] = starts[members]
        return answers

    def finish(self, block: Block, starts: np.ndarray) -> pa.Table:
        covered = cover(starts, self.length, len(block.data))
        data = np.frombuffer(block.data, np.uint8)
        removed, kept, edges = [], [], block.bounds.tolist()
        for a, b in zip(edges, edges[1:]):
            begins, ends = runs(covered[a:b])
            removed.append([{"begin": x, "end": y} for x, y in zip(begins.tolist(), ends.tolist())])
            kept.append(data[a:b][~covered[a:b]].tobytes())
        pair = pa.struct([("begin", pa.int32()), ("end", pa.int32())])
        return pa.table(
            {
                "doc_id": block.id_column(),
                "text_hash": block.hash_column(),
                "n_bytes": pa.array(np.diff(block.bounds), pa.int64()),
                "spans": pa.array(removed, pa.list_(pair)),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def remove_later_copies(docs: DataFrame, length: int = 100) -> DataFrame:
    """doc_id, text_hash, n_bytes, the removed ``spans`` and the ``kept`` bytes of every document.

    A byte goes if some ``length``-byte string over it also starts earlier: in a
    document with a smaller doc_id, or further ahead in its own. All is judged
    on the input. Candidates are the windows around anchors (the least 50-byte
    hash in a window) that occur twice; each group of anchors sorts its
    windows' suffixes and takes their longest previous factors. Texts equal as
    a whole are settled by their hash.

    Null or empty text: nothing to remove. Null doc_id: before all others.
    Repeated rows (id and text) count as one document and get one result each;
    texts that share an id are ordered by hash. No rows: no rows.
    """
    return repeats(docs, LongestPreviousFactor(length))


def without_later_copies(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents with later copies cut out of ``text``; ``n_chars`` follows.

    A character that a cut leaves incomplete goes too. All columns are kept.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [k.as_py().decode(errors="ignore") for k in batch["kept"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], pa.array(cut, pa.string())],
                names=["cut_id", "cut_hash", "cut"],
            )

    changed = (
        remove_later_copies(docs, length)
        .where("size(spans) > 0")
        .select("doc_id", "text_hash", "kept")
        .mapInArrow(lean(decode), "cut_id long, cut_hash long, cut string")
        .dropDuplicates(["cut_id", "cut_hash"])
    )
    same = docs["doc_id"].eqNullSafe(changed["cut_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == changed["cut_hash"]
    )
    return with_text(docs.join(changed, same, "left"), docs.columns, F.coalesce("cut", "text"))
