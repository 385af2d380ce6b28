"""Token counts of whole texts, huge ones by overlapping chunks."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tidewire.llm.common import lean, texts

#: Characters of a chunk of a huge document, and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 512
#: Words one Python worker remembers, about.
REMEMBERED = 300_000
#: Separators that end a pre-token in any context (fixed values).
BLANKS = " \t\n\v\f\r"


class Counter(dict):
    """word -> number of tokens, as the library gives it.

    Of the words remembered half are the newest; when these are full the older
    half is dropped, except for words met again meanwhile.

    The vocabulary's pre-tokens never hold white space, normalisation doesn't
    cross ASCII white space, and no special token holds any. So the count of a
    text is the sum over its words.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.older: dict[bytes, int] = {}

    def learn(self, words: list[bytes]) -> None:
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        missing = [w for w in dict.fromkeys(words) if w not in self]
        self.update((w, self.older[w]) for w in missing if w in self.older)
        new = [w for w in missing if w not in self.older]
        for begin in range(0, len(new), 4096):
            part = new[begin : begin + 4096]
            encoded = self.tokenizer.encode_batch_fast(
                [w.decode() for w in part], add_special_tokens=False
            )
            self.update(zip(part, map(len, encoded)))

    def count(self, text: str) -> int:
        words = text.encode().split()  # at ASCII white space
        try:
            return sum(map(self.__getitem__, words))
        except KeyError:
            self.learn(words)
            return sum(map(self.__getitem__, words))

    def tokens(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and (begin, end) of each token in a text, in code points."""
        encoded = self.tokenizer.encode(text, add_special_tokens=False)
        return encoded.ids, encoded.offsets


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> Counter:
    """One per Python worker."""
    return Counter(vocabulary)


def _stable(text: str, place: int) -> bool:
    """Whether tokens can't reach over ``place``: white space before, a base character there."""
    return (
        0 < place < len(text)
        and text[place - 1] in BLANKS
        and text[place] not in BLANKS
        and not unicodedata.combining(text[place])
    )


Tokens = tuple[list[int], list[tuple[int, int]]]


def common_boundary(
    text: str, left: Tokens, right: Tokens, begin: int, end: int, least: int = 0
) -> tuple[int, int] | None:
    """Where two encodings of a text can be spliced in their overlap [begin, end).

    Returns how many tokens of ``left`` come before the boundary, ``least`` at
    least, and how many of ``right``. The boundary is a token start in both,
    proven stable by the characters around it, and the token behind it is the
    same in both; of several, the nearest to the middle. Offsets count from the
    start of the text.
    """
    places: dict[int, int] = {}
    for j, (at, _) in enumerate(right[1]):
        if begin < at < end:
            places.setdefault(at, j)
    middle = (begin + end) // 2
    inside = [k for k in range(least, len(left[1])) if left[1][k][0] in places]
    for k in sorted(inside, key=lambda k: abs(left[1][k][0] - middle)):
        at = left[1][k][0]
        j = places[at]
        first = k == 0 or left[1][k - 1][0] < at
        same = left[0][k] == right[0][j] and left[1][k] == right[1][j]
        if first and same and _stable(text, at):
            return k, j
    return None


def spliced_ids(encode, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """Ids of a huge text from overlapping chunks.

    Each chunk is encoded with offsets, the next one begins ``overlap``
    characters before its end, and they are spliced at a boundary proven stable
    in both. Without one the overlap is doubled; when that would reach the
    chunk's start, the chunk is made twice as long, in the worst case up to the
    whole text.
    """

    def encoded(begin: int, end: int) -> Tokens:
        ids, offsets = encode(text[begin:end])
        return ids, [(a + begin, b + begin) for a, b in offsets]

    ids: list[int] = []
    start, end, skip = 0, min(chunk, len(text)), 0
    current = encoded(start, end)
    width = overlap
    while end < len(text):
        if width >= end - start:
            end = min(len(text), start + 2 * (end - start))
            current, width = encoded(start, end), overlap
            continue
        begin = end - width
        later_end = min(len(text), begin + max(chunk, 2 * width))
        later = encoded(begin, later_end)
        joint = common_boundary(text, current, later, begin, end, skip)
        if joint is None:
            width *= 2
            continue
        ids.extend(current[0][skip : joint[0]])
        current, skip, start, end, width = later, joint[1], begin, later_end, overlap
    ids.extend(current[0][skip:])
    return ids


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    A text of up to ``chunk`` characters is counted by its words, each distinct
    word encoded once per worker. A longer one is encoded in overlapping chunks
    and spliced (``spliced_ids``), so memory is bounded by a chunk. Narrow
    rows, no shuffle. ``vocabulary``: a word-level .json whose pre-tokens never
    hold white space.

    Null or empty text: 0 bytes, 0 tokens. Repeated rows are counted each. No
    rows: no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(vocabulary)
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                rows = part.column("text").to_pylist()
                counts = [
                    known.count(text)
                    if len(text) <= chunk
                    else len(spliced_ids(known.tokens, text, chunk, overlap))
                    for text in rows
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(text.encode()) for text in rows], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array([n > limit for n in counts], pa.bool_()),
                    ],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return texts(docs).mapInArrow(lean(count), schema)
