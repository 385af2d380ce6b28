"""Byte-level BPE over whole tables: every distinct word is encoded once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from tidewire.llm.common import lean, texts
from tidewire.llm.vocab import Encoder, pieces, ranks_of

#: Text bytes of a block, the unit whose word positions travel as one row.
BLOCK = 16 << 20
#: Word groups encoded apart. A group is one task's: raise it with the number of distinct words.
BUCKETS = 512
#: Words put together at once.
SLICE = 500_000
WORDS = "bucket int, block string, places binary, words binary"
DICTIONARY = "block string, places binary, ids binary"
POSITIONS = "block string, doc_ids array<long>, lengths array<int>, positions binary"


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, list, list]]:
    """(digest, doc ids, texts) of runs of rows with at least ``size`` text bytes.

    The digest names a block by what is in it, so both readers of a table agree
    on it or the join of their rows fails aloud.
    """
    ids, held, digest, total = [], [], xxhash.xxh3_128(), 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
            data = text.as_buffer()
            digest.update(f"{doc_id}:{data.size}:".encode())
            digest.update(data)
            ids.append(doc_id)
            held.append(text.as_py())
            total += data.size
            if total >= size:
                yield digest.hexdigest(), ids, held
                ids, held, digest, total = [], [], xxhash.xxh3_128(), 0
    if ids:
        yield digest.hexdigest(), ids, held


def packed(items: list[bytes]) -> bytes:
    """A list of byte strings as one compressed one."""
    lengths = np.fromiter(map(len, items), "<u4", len(items))
    head = np.array([len(items)], "<u4")
    data = b"".join([head.tobytes(), lengths.tobytes(), *items])
    return zstandard.ZstdCompressor(level=1).compress(data)


def unpacked(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (count,) = np.frombuffer(raw, "<u4", 1)
    lengths = np.frombuffer(raw, "<u4", count, 4)
    ends = (4 + 4 * int(count) + np.cumsum(lengths, dtype=np.int64)).tolist()
    begins = [4 + 4 * int(count), *ends[:-1]]
    return [raw[a:b] for a, b in zip(begins, ends)]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Small numbers below 2 ** 28 as groups of seven bits, then zstd."""
    wide = numbers.astype(np.uint32)
    used = 1 + sum((wide >= (1 << 7 * k)).astype(np.uint8) for k in (1, 2, 3))
    groups = np.stack([(wide >> (7 * k) & 127).astype(np.uint8) for k in range(4)], axis=1)
    place = np.arange(4)
    groups |= np.where(place < used[:, None] - 1, 128, 0).astype(np.uint8)
    flat = groups[place < used[:, None]].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(flat)


def _spread(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    last = np.flatnonzero(flat < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    numbers = np.zeros(len(last), np.uint32)
    for k in range(4):
        at = first + k
        there = at <= last
        numbers[there] |= (flat[at[there]] & 127).astype(np.uint32) << (7 * k)
    return numbers


def stretches(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of several stretches, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begins - (ends - sizes), sizes)


class _Places(dict):
    """word -> its place in order of appearance."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's distinct words by bucket, with their places in order of appearance."""
    for block, _, held in blocks(batches, BLOCK):
        words: dict[str, None] = {}
        for text in held:
            words.update(dict.fromkeys(pieces(text)))
        buckets: dict[int, tuple[list[int], list[bytes]]] = {}
        for place, word in enumerate(map(str.encode, words)):
            places, own = buckets.setdefault(zlib.crc32(word) % BUCKETS, ([], []))
            places.append(place)
            own.append(word)
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": pa.array(list(buckets), pa.int32()),
                "block": pa.array([block] * len(buckets), pa.string()),
                "places": pa.array(
                    [_squeezed(np.diff(p, prepend=0)) for p, _ in buckets.values()], pa.binary()
                ),
                "words": pa.array([packed(w) for _, w in buckets.values()], pa.binary()),
            }
        )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's texts as places in its list of distinct words."""
    for block, ids, held in blocks(batches, BLOCK):
        place, flat, lengths = _Places().__getitem__, [], []
        for text in held:
            words = pieces(text)
            lengths.append(len(words))
            flat.append(np.fromiter(map(place, words), np.uint32, len(words)))
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array([block], pa.string()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "positions": pa.array([_squeezed(np.concatenate(flat))], pa.binary()),
            }
        )


def encode(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id and ids (array of int) of every document by the rank file at ``ranks``.

    The text is cut into words, a blank and what follows it (``vocab.pieces``);
    such a word is one or more whole pre-tokens. Blocks of documents emit their
    distinct words to the groups of a hash. In its group each distinct word is
    encoded once for the whole table. The ids go back to every block that has
    the word, where its documents are put together by position.

    Words of a block travel compressed, one row per block and group; positions
    travel as compressed numbers, one row per block. So a word that every
    document holds costs one entry per block, and no group grows with the
    copies of a word. The table is read twice (words, positions).

    Null or empty text: no ids. Null doc_id: kept. Repeated rows: encoded each.
    Special tokens aren't looked for. No rows: no rows.
    """
    rows = texts(docs)

    def ids_of_words(table: pd.DataFrame) -> pd.DataFrame:
        known: dict[bytes, bytes] = {}
        of = Encoder(ranks).ids
        out = []
        for data in table["words"]:
            words = unpacked(data)
            for word in words:
                if word not in known:
                    known[word] = np.array(of(word.decode()), "<u4").tobytes()
            out.append(packed([known[word] for word in words]))
        return pd.DataFrame({"block": table["block"], "places": table["places"], "ids": out})

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        entries: dict[int, bytes] = {}
        for places, ids in zip(right["places"].to_pylist(), right["ids"].to_pylist()):
            entries.update(zip(np.cumsum(_spread(places)).tolist(), unpacked(ids)))
        words = [entries[place] for place in range(len(entries))]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        flat = np.frombuffer(b"".join(words), "<u4").astype(np.int32)
        begins = np.cumsum(sizes) - sizes
        doc_ids, counts, values = [], [np.zeros(1, np.int64)], []
        for row in left.to_pylist():
            positions = _spread(row["positions"])
            if len(positions) and int(positions.max()) >= len(words):
                raise ValueError("the two reads of the table were cut into different blocks")
            edges = np.concatenate([[0], np.cumsum(row["lengths"], dtype=np.int64)])
            counts.append(np.concatenate([[0], np.cumsum(sizes[positions])])[edges])
            counts[-1] = np.diff(counts[-1])
            for begin in range(0, len(positions), SLICE):
                some = positions[begin : begin + SLICE]
                values.append(flat[stretches(begins[some], sizes[some])])
            doc_ids.extend(row["doc_ids"])
        numbers = np.concatenate(values) if values else np.zeros(0, np.int32)
        ends = np.cumsum(np.concatenate(counts))
        lists = pa.LargeListArray.from_arrays(ends, numbers)
        return pa.table(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "ids": lists.cast(pa.list_(pa.int32())),
            }
        )

    dictionary = (
        rows.mapInArrow(lean(_distinct_words), WORDS)
        .groupBy("bucket")
        .applyInPandas(lean(ids_of_words), DICTIONARY)
    )
    positions = rows.mapInArrow(lean(_positions), POSITIONS)
    return (
        positions.groupBy("block")
        .cogroup(dictionary.groupBy("block"))
        .applyInArrow(lean(put_together), "doc_id long, ids array<int>")
    )


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``, from the table of token bytes.

    The table has the size of the vocabulary and is read by each worker. An
    unknown id fails. Null ids: empty.
    """

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = sorted((rank, token) for token, rank in ranks_of(ranks).items())
        sizes = np.zeros(by_rank[-1][0] + 1, np.int64)
        sizes[[rank for rank, _ in by_rank]] = [len(token) for _, token in by_rank]
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(token for _, token in by_rank), np.uint8)
        for batch in batches:
            decoded = []
            for ids in batch["ids"]:
                numbers = ids.values.to_numpy() if ids.is_valid else np.zeros(0, np.int32)
                if len(numbers) and not sizes[numbers].all():
                    raise ValueError("an id is not in the table of token bytes")
                decoded.append(flat[stretches(begins[numbers], sizes[numbers])].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["ids"], pa.array(decoded, pa.binary())],
                names=["doc_id", "ids", "decoded"],
            )

    schema = "doc_id long, ids array<int>, decoded binary"
    return encoded.select("doc_id", "ids").mapInArrow(lean(to_bytes), schema)
