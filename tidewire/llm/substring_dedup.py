"""Removing later copies of word windows, found through difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidewire.llm.repeats import GROUPS, Block, cover, deal, packed, ranked, repeats, unpacked
from tidewire.llm.suffix_dedup import ODD

#: Every difference modulo 13 is one of two of these places (fixed values, a perfect difference set).
PERIOD, PLACES = 13, (0, 1, 3, 9)
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, odd: np.uint64) -> np.ndarray:
    """A 64-bit hash of the ``size`` word hashes from each of ``at`` on."""
    with np.errstate(over="ignore"):
        found = np.zeros(len(at), np.uint64)
        for k in range(size):
            found = found * odd + words[at + k]
        return _mixed(found)


class WordHashes(dict):
    """word -> 64-bit hash, computed when first met."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


@dataclass
class Words:
    """A block's words: their hashes, and each document's first word."""

    hashes: np.ndarray
    firsts: np.ndarray

    @staticmethod
    def of(block: Block) -> Words:
        known = WordHashes()
        each = []
        for text in block.texts:
            words = text.split()
            each.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        firsts = np.cumsum([0, *map(len, each)])
        return Words(np.concatenate(each), firsts)

    def documents(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, at, "right") - 1


@dataclass
class Survey:
    words: Words
    keys: np.ndarray
    places: np.ndarray
    repeated: np.ndarray


def _several(values: np.ndarray) -> np.ndarray:
    """Whether each value occurs twice or more."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    found = np.zeros(len(values), bool)
    if len(values):
        found[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return found


def _not_first(high: np.ndarray, low: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether an equal (high, low) has a smaller order."""
    by = np.lexsort((order, low, high))
    new = np.concatenate(
        [[True], (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])]
    )[: len(by)]
    found = np.empty(len(by), bool)
    if len(by):
        least = order[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        found[by] = order[by] > least
    return found


@dataclass
class DifferenceCover:
    """The method's part of the rounds in ``repeats``.

    Positions are those of words. Of two equal windows, whatever their places
    in their documents, some shift below PERIOD leads to a cover position in
    both; an anchor of ``window - PERIOD + 1`` words starts there, inside both.
    """

    window: int = 20
    schema: str = "doc_id long, text_hash long, n_words long, removed long, kept binary"

    @property
    def anchor(self) -> int:
        return self.window - PERIOD + 1

    def _starts(self, block: Block, words: Words) -> np.ndarray:
        """Whether a window of its document starts at each word."""
        valid = np.zeros(len(words.hashes) + 1, bool)
        for a, b in zip(words.firsts.tolist(), words.firsts[1:].tolist()):
            if b - a >= self.window:
                valid[a : b - self.window + 1] = True
        return valid

    def _around(self, anchors: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Starts of the windows that hold any of the anchors."""
        change = np.zeros(len(allowed) + 1, np.int32)
        np.add.at(change, np.maximum(anchors - PERIOD + 1, 0), 1)
        np.add.at(change, np.minimum(anchors + 1, len(allowed)), -1)
        return np.flatnonzero((np.cumsum(change)[:-1] > 0) & allowed)

    def _order(self, block: Block, words: Words, starts: np.ndarray) -> np.ndarray:
        document = words.documents(starts)
        return (block.rank[document] << 32) + starts - words.firsts[document]

    def _two(self, words: Words, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (
            window_hashes(words.hashes, starts, self.window, ODD),
            window_hashes(words.hashes, starts, self.window, OTHER),
        )

    def survey(self, block: Block) -> Survey:
        """Anchors at cover positions with windows that nothing earlier in the block repeats."""
        words = Words.of(block)
        valid = self._starts(block, words)
        covered = np.zeros(len(valid), bool)
        repeated = np.zeros(len(valid), bool)
        for k, (a, b) in enumerate(zip(words.firsts.tolist(), words.firsts[1:].tolist())):
            if b - a >= self.window:
                for place in PLACES:
                    covered[a + place : b - self.anchor + 1 : PERIOD] = True
                if block.copy[k]:
                    repeated[a : b - self.window + 1] = True
                    covered[a:b] = False
        places = np.flatnonzero(covered)
        keys = window_hashes(words.hashes, places, self.anchor, ODD)
        suspects = self._around(places[_several(keys)], valid & ~repeated)
        high, low = self._two(words, suspects)
        repeated[suspects[_not_first(high, low, self._order(block, words, suspects))]] = True
        fresh = np.concatenate([[0], np.cumsum(valid & ~repeated)])
        left = fresh[np.minimum(places + 1, len(valid))] > fresh[np.maximum(places - PERIOD + 1, 0)]
        return Survey(words, keys[left], places[left], repeated)

    def settled(self, block: Block, survey: Survey, copy: np.ndarray) -> np.ndarray:
        firsts = survey.words.firsts
        for k in np.flatnonzero(copy).tolist():
            survey.repeated[firsts[k] : max(firsts[k], firsts[k + 1] - self.window + 1)] = True
        return np.flatnonzero(survey.repeated)

    def offer(
        self, block: Block, survey: Survey, shared: np.ndarray, copy: np.ndarray
    ) -> Iterator[tuple[int, bytes]]:
        words = survey.words
        open_starts = self._starts(block, words) & ~survey.repeated
        starts = self._around(survey.places[shared], open_starts)
        high, low = self._two(words, starts)
        document = words.documents(starts)
        for group, chosen in deal((high % np.uint64(GROUPS)).astype(np.int64)):
            place, documents = block.order_of(document[chosen])
            yield (
                group,
                packed(
                    *documents,
                    words.firsts[np.unique(document[chosen])].astype("<i8"),
                    place.astype("<u4"),
                    np.diff(starts[chosen], prepend=0).astype("<u4"),
                    high[chosen].astype("<u8"),
                    (low[chosen] >> np.uint64(32)).astype("<u4"),
                ),
            )

    def earlier(self, offers: list[bytes]) -> list[np.ndarray]:
        if not offers:
            return []
        each = [unpacked(o, "<i8", "<u8", "<i8", "<u4", "<u4", "<u8", "<u4") for o in offers]
        starts = [np.cumsum(e[4], dtype=np.int64) for e in each]
        ranks = ranked([(e[0], e[1]) for e in each])
        order = [
            (rank[e[3]] << 32) + start - e[2][e[3]] for rank, start, e in zip(ranks, starts, each)
        ]
        high, low = (np.concatenate([e[k] for e in each]) for k in (5, 6))
        found = _not_first(high, low, np.concatenate(order))
        cuts = np.cumsum([len(s) for s in starts])[:-1]
        return [s[f] for s, f in zip(starts, np.split(found, cuts))]

    def finish(self, block: Block, starts: np.ndarray) -> pa.Table:
        each = [text.split() for text in block.texts]
        firsts = np.cumsum([0, *map(len, each)])
        gone = cover(starts, self.window, int(firsts[-1]))
        removed, kept = [], []
        for a, words in zip(firsts.tolist(), each):
            flags = gone[a : a + len(words)]
            count = int(flags.sum())
            removed.append(count)
            if count:
                words = [words[k] for k in np.flatnonzero(~flags).tolist()]
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": block.id_column(),
                "text_hash": block.hash_column(),
                "n_words": pa.array(np.diff(firsts), pa.int64()),
                "removed": pa.array(removed, pa.int64()),
                "kept": pa.array(kept, pa.binary()),
            }
        )


def remove_repeated_windows(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, text_hash, n_words, words ``removed`` and the ``kept`` words of every document.

    A word goes if some window of ``window`` words over it also starts earlier:
    in a document with a smaller doc_id, or further ahead in its own. All is
    judged on the input. Anchors are hashed at difference-cover positions only,
    4 of 13; windows around anchors that occur twice are compared by 96 bits
    of hash over the whole window (128 within a block), and the earliest of equal ones stays.

    Null or empty text: no words. A text of fewer words than a window stays.
    Null doc_id: before all others. Repeated rows (id and text) count as one
    document and get one result each; texts that share an id are ordered by
    hash. No rows: no rows.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window needs {PERIOD + 1} words at least")
    return repeats(docs, DifferenceCover(window))
