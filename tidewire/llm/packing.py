"""Packing documents into sequences along a space-filling curve."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewire.llm.common import lean, stored, texts
from tidewire.llm.vocab import encoder, with_special

#: The hashed document vector: token counts in so many buckets.
BUCKETS = 256
#: Dimensions of the projection, and bits for each of them on the curve.
DIMENSIONS, BITS = 4, 12
SEED = 20_240
PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long,"
    " sequence_id long, offset long"
)


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of integer points (rows), by Skilling's transform.

    Coordinates are below ``2 ** bits``; neighbours on the curve differ by one
    in one coordinate.
    """
    x = points.astype(np.int64).T.copy()
    dimensions = len(x)
    high = 1 << (bits - 1)
    q = high
    while q > 1:
        low = q - 1
        for i in range(dimensions):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dimensions):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = high
    while q > 1:
        turn ^= np.where((x[dimensions - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    index = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dimensions):
            index = (index << 1) | ((x[i] >> bit) & 1)
    return index


def _directions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(0, BUCKETS, 1 << 17), draw.standard_normal((BUCKETS, DIMENSIONS))


def curve_keys(documents: list[np.ndarray]) -> list[int]:
    """Hilbert key of each document (token ids): counts hashed to buckets, damped, projected."""
    if not documents:
        return []
    bucket, directions = _directions()
    counts = np.stack(
        [np.bincount(bucket[ids & 0x1FFFF], minlength=BUCKETS) for ids in documents]
    )
    vectors = np.log1p(counts)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    side = 1 << BITS
    places = np.clip((np.tanh(vectors @ directions) + 1) / 2 * side, 0, side - 1)
    return hilbert_index(places.astype(np.int64), BITS).tolist()


def tokenized(docs: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, curve, ids (zstd, little-endian unsigned 32 bit, ``end`` last).

    ``vocabulary``: a byte-level BPE as .json, with its ranks beside it as
    .tiktoken. Strings of its special tokens stand for their ids.
    """
    ranks = str(Path(vocabulary).with_suffix(".tiktoken"))
    added = json.loads(Path(vocabulary).read_text())["added_tokens"]
    special = {token["content"]: token["id"] for token in added}
    last = end.to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(ranks)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                ids = [
                    b"".join([*with_special(text, special, known.encode), last])
                    for text in part.column("text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(curve_keys([np.frombuffer(x, "<u4") for x in ids]), pa.int64()),
                        pa.array(map(squeeze.compress, ids), pa.binary()),
                    ],
                    names=["doc_id", "curve", "ids"],
                )

    return texts(docs).mapInArrow(lean(encode), "doc_id long, curve long, ids binary")


def _cuts(total: int) -> list[int]:
    """Lengths of the sequences that hold a rest: its powers of two, largest first."""
    return [1 << bit for bit in range(total.bit_length() - 1, -1, -1) if total >> bit & 1]


def fill(rows: Iterator[tuple[int, bytes]], length: int, first: int) -> Iterator[tuple]:
    """Lay documents (id, ids as bytes) end to end and cut every ``length`` ids.

    Holds the pieces of one open sequence. What is left at the end is cut into
    sequences whose lengths are powers of two, so nothing is padded.
    """
    sequence, used = first, 0
    open_pieces: list[tuple] = []
    for doc_id, ids in rows:
        total, start = len(ids) // 4, 0
        while start < total:
            take = min(total - start, length - used)
            open_pieces.append(
                (doc_id, start, take, ids[4 * start : 4 * (start + take)], total, sequence, used)
            )
            start, used = start + take, used + take
            if used == length:
                yield from open_pieces
                open_pieces, sequence, used = [], sequence + 1, 0
    yield from _tail(open_pieces, used, sequence)


def _tail(open_pieces: list[tuple], used: int, sequence: int) -> Iterator[tuple]:
    lengths = iter(_cuts(used))
    room, at, sequence = 0, 0, sequence - 1
    for doc_id, start, size, ids, total, _, _ in open_pieces:
        done = 0
        while done < size:
            if not room:
                room, at, sequence = next(lengths), 0, sequence + 1
            take = min(size - done, room)
            part = ids[4 * done : 4 * (done + take)]
            yield doc_id, start + done, take, part, total, sequence, at
            done, room, at = done + take, room - take, at + take


def pack(docs: DataFrame, vocabulary: str, length: int = 2048, end: int = 1) -> DataFrame:
    """Sequences of at most ``length`` ids from neighbouring documents, as their pieces.

    Every document becomes a vector of hashed token counts, that vector a point
    of few dimensions, that point a place on a Hilbert curve. Documents are
    range-sorted by place and laid end to end, so a sequence holds documents
    that are alike. One row per piece: ``ids`` is the piece's part of the
    document's ids (little-endian, unsigned, 32 bit), ``start`` counts the ids
    of the document before it, ``offset`` those of the sequence before it.

    Every range partition is filled on its own, in a stream, and its last ids
    go to sequences whose lengths are powers of two: no padding. The texts are
    tokenized once; the ids go through a written table, as the range sort
    reads its input twice. A place shared by many documents is split by doc_id.

    Null or empty text: the end id alone. Null doc_id: kept. Repeated rows are
    packed each. Ties on the curve: by doc_id. No rows: no pieces.
    """
    ready = stored(tokenized(docs, vocabulary, end), "tokens")
    along = ready.repartitionByRange("curve", "doc_id").sortWithinPartitions("curve", "doc_id")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress

        def rows() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                for doc_id, ids in zip(batch["doc_id"], batch["ids"]):
                    yield doc_id.as_py(), expand(ids.as_py())

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*pieces), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        held: list[tuple] = []
        for piece in fill(rows(), length, TaskContext.get().partitionId() << 33):
            held.append(piece)
            if len(held) == 4096:
                yield table(held)
                held = []
        if held:
            yield table(held)

    return along.select("doc_id", "ids").mapInArrow(lean(lay), PIECES)
