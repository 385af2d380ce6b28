"""Which windows of a document also start earlier in the table: the rounds two methods share.

Documents travel in blocks of some megabytes. A method finds anchors in a
block such that two equal windows always hold equal anchors, and settles
what repeats within the block. Then three rounds, none with more than a
bounded share of a block in one row:

1. anchors that still matter go to the group of their hash, which tells each
   block the ones that other blocks have too;
2. the block offers the windows around those to the same groups, where a
   method compares them and keeps the earliest;
3. the answers meet the block again, which then knows its repeated windows.

A block offers what repeats within it once. So a passage in a third of all
documents costs its group one entry per block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, stored, texts

#: Text bytes of a block, and groups of anchors. Raise GROUPS with the table.
BLOCK, GROUPS = 8 << 20, 512
#: Stands for a null doc_id: before all others.
NO_ID = -(1 << 63)


def packed(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    """Several arrays as one compressed byte string."""
    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(raw), *map(len, raw)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,) = np.frombuffer(raw, "<u8", 1)
    sizes = np.frombuffer(raw, "<u8", int(count), 8).tolist()
    at, found = 8 + 8 * int(count), []
    for kind, size in zip(kinds, sizes):
        found.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return found


def pack_places(places: np.ndarray) -> bytes:
    """Ascending numbers as runs of consecutive ones."""
    new = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    sizes = np.diff(np.append(new, len(places)))
    return packed(np.diff(places[new], prepend=0).astype("<u4"), sizes.astype("<u4"), level=3)


def unpack_places(data: bytes) -> np.ndarray:
    gaps, sizes = unpacked(data, "<u4", "<u4")
    return stretches(np.cumsum(gaps, dtype=np.int64), sizes.astype(np.int64))


@dataclass
class Block:
    """Documents end to end: ``bounds[k]`` to ``bounds[k + 1]`` is the text of ``ids[k]``."""

    ids: np.ndarray
    bounds: np.ndarray
    data: bytes

    def __post_init__(self) -> None:
        edges = self.bounds.tolist()
        texts_ = [self.data[a:b] for a, b in zip(edges, edges[1:])]
        self.texts: list[bytes] = texts_
        self.digests = np.frombuffer(
            b"".join(xxhash.xxh3_128_digest(t) for t in texts_), ">u8"
        ).reshape(-1, 2)
        order = np.lexsort((self.digests[:, 0], self.ids))
        ids, firsts = self.ids[order], self.digests[order, 0]
        new = np.concatenate([[False], (np.diff(ids) != 0) | (firsts[1:] != firsts[:-1])])
        #: Place of each document in the order of doc_id; repeated rows share one.
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.cumsum(new)
        first: dict[bytes, int] = {}
        for k in order.tolist():
            first.setdefault(texts_[k], k)
        #: Whether an equal text has a smaller doc_id in this block.
        self.copy = np.array(
            [self.rank[first[t]] < self.rank[k] for k, t in enumerate(texts_)], bool
        )


    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NO_ID)

    def hash_column(self) -> pa.Array:
        """Of each text, as the SQL function xxhash64 has it."""
        hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in self.texts], np.uint64)
        return pa.array(hashes.view(np.int64), pa.int64())


    def order_of(self, documents: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each item its place in a short list of documents, and that list: ids, hashes.

        The list goes with an offer, so that other blocks' items can be put in order.
        """
        used, place = np.unique(documents, return_inverse=True)
        ids, hashes = self.ids[used].astype("<i8"), self.digests[used, 0].astype("<u8")
        return place.astype("<u2" if len(used) < 1 << 16 else "<u4"), [ids, hashes]


def ranked(lists: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The rank of every (id, hash) of several lists in their common order."""
    ids, hashes = (np.concatenate(column) for column in zip(*lists))
    order = np.lexsort((hashes, ids))
    new = np.concatenate(
        [[False], (np.diff(ids[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])]
    )[: len(order)]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return np.split(rank, np.cumsum([len(i) for i, _ in lists])[:-1])


def open_block(data: bytes) -> Block:
    ids, bounds, text = unpacked(data, "<i8", "<i8", "u1")
    return Block(ids, bounds, text.tobytes())


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    held: list[bytes] = []
    total = 0

    def row() -> pa.RecordBatch:
        bounds = np.cumsum([0, *map(len, held)])
        body = packed(np.array(ids, "<i8"), bounds.astype("<i8"), b"".join(held), level=3)
        return pa.RecordBatch.from_pydict(
            {"block": pa.array([xxhash.xxh3_128_hexdigest(body)]), "body": pa.array([body])}
        )

    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            ids.append(NO_ID if doc_id is None else doc_id)
            held.append(text.as_buffer().to_pybytes())
            total += len(held[-1])
            if total >= BLOCK:
                yield row()
                ids, held, total = [], [], 0
    if ids:
        yield row()


class Method(Protocol):
    """What differs between the methods. A survey is a method's own view of a block."""

    schema: str

    def survey(self, block: Block) -> Any:
        """Has ``keys``: 64-bit hashes of the anchors whose windows aren't settled yet."""

    def offer(
        self, block: Block, survey: Any, shared: np.ndarray, copy: np.ndarray
    ) -> Iterator[tuple[int, bytes]]:
        """(group, windows around the shared anchors) of a block."""

    def settled(self, block: Block, survey: Any, copy: np.ndarray) -> np.ndarray:
        """Starts of the windows known to repeat without asking other blocks."""

    def earlier(self, offers: list[bytes]) -> list[np.ndarray]:
        """For each offer of a group the starts of the windows that start earlier elsewhere."""

    def finish(self, block: Block, starts: np.ndarray) -> pa.Table:
        """The result rows of a block, given the starts of its repeated windows."""


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of several stretches, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - sizes), sizes)


def deal(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, indexes of its members) for every group that has any."""
    order = np.argsort(groups, kind="stable")
    edges = np.flatnonzero(np.diff(groups[order], prepend=-1, append=-2))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(groups[order[begin]]), order[begin:end]


def _home(block: str) -> int:
    return zlib.crc32(block.encode()) % GROUPS


def repeats(docs: DataFrame, method: Method) -> DataFrame:
    """Run the rounds over all documents; the rows are those of ``method.finish``."""
    blocks = stored(texts(docs).mapInArrow(lean(_blocks), "block string, body binary"), "blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, body in zip(batch["block"].to_pylist(), batch["body"]):
                block = open_block(body.as_py())
                keys = method.survey(block).keys
                rows: dict[int, list] = {}
                for group, at in deal((keys % np.uint64(GROUPS)).astype(np.int64)):
                    rows.setdefault(group, [b"", b""])[0] = keys[at].tobytes()
                for group, at in deal((block.digests[:, 1] % np.uint64(GROUPS)).astype(np.int64)):
                    own = np.column_stack([block.digests[at].view("<i8"), block.ids[at]])
                    rows.setdefault(group, [b"", b""])[1] = np.ascontiguousarray(own).tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "group": pa.array(list(rows), pa.int32()),
                        "block": pa.array([name] * len(rows), pa.string()),
                        "keys": pa.array([r[0] for r in rows.values()], pa.binary()),
                        "texts": pa.array([r[1] for r in rows.values()], pa.binary()),
                    }
                )

    def tell(table: pd.DataFrame) -> pd.DataFrame:
        """Bits: anchors that two blocks have; texts that a smaller doc_id has too."""
        keys = [np.frombuffer(k, "<u8") for k in table["keys"]]
        own = np.concatenate([np.unique(k) for k in keys])
        distinct, counts = np.unique(own, return_counts=True)
        common = distinct[counts > 1]
        found = [np.frombuffer(t, "<i8").reshape(-1, 3) for t in table["texts"]]
        rows = np.concatenate(found)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        own = rows[order]
        new = np.concatenate([[True], (np.diff(own[:, :2], axis=0) != 0).any(axis=1)])[: len(own)]
        least = own[new][np.cumsum(new) - 1, 2] if len(own) else own[:, 2]
        later = np.empty(len(rows), bool)
        later[order] = own[:, 2] > least
        cuts = np.cumsum([len(f) for f in found])[:-1]
        return pd.DataFrame(
            {
                "group": table["group"],
                "block": table["block"],
                "shared": [np.packbits(np.isin(k, common)).tobytes() for k in keys],
                "copies": [np.packbits(x).tobytes() for x in np.split(later, cuts)],
            }
        )

    def offer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, str, bool, bytes]] = []
        bits = {g: (s, c) for g, s, c in zip(right["group"], right["shared"], right["copies"])}
        for name, body in zip(left["block"], left["body"]):
            block = open_block(body)
            survey = method.survey(block)
            shared = np.zeros(len(survey.keys), bool)
            copy = block.copy.copy()
            for group, at in deal((survey.keys % np.uint64(GROUPS)).astype(np.int64)):
                shared[at] = np.unpackbits(np.frombuffer(bits[group][0], "u1"), count=len(at))
            for group, at in deal((block.digests[:, 1] % np.uint64(GROUPS)).astype(np.int64)):
                copy[at] |= np.unpackbits(np.frombuffer(bits[group][1], "u1"), count=len(at)) > 0
            known = method.settled(block, survey, copy)
            out.append((_home(name), name, True, pack_places(known)))
            out.extend((g, name, False, data) for g, data in method.offer(block, survey, shared, copy))
        return pd.DataFrame(out, columns=["group", "block", "known", "data"])

    def compare(table: pd.DataFrame) -> pd.DataFrame:
        known = table[table["known"]]
        asked = table[~table["known"]]
        answers = [pack_places(np.sort(a)) for a in method.earlier(list(asked["data"]))]
        return pd.DataFrame(
            {
                "block": pd.concat([known["block"], asked["block"]]),
                "starts": [*known["data"], *answers],
            }
        )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [unpack_places(s) for s in right["starts"].to_pylist()]
        starts = np.concatenate([np.zeros(0, np.int64), *found])
        return pa.concat_tables(
            method.finish(open_block(body), starts) for body in left["body"].to_pylist()
        )

    told = (
        blocks.mapInArrow(lean(ask), "group int, block string, keys binary, texts binary")
        .groupBy("group")
        .applyInPandas(lean(tell), "group int, block string, shared binary, copies binary")
    )
    offers = (
        blocks.groupBy("block")
        .cogroup(told.groupBy("block"))
        .applyInPandas(lean(offer), "group int, block string, known boolean, data binary")
    )
    answers = offers.groupBy("group").applyInPandas(lean(compare), "block string, starts binary")
    return (
        blocks.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(lean(finish), method.schema)
    )


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def cover(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """The positions that windows of ``width`` at ``starts`` cover."""
    change = np.zeros(size + width + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return np.cumsum(change)[:size] > 0
