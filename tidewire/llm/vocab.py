"""Token ids of words and of whole texts by published vocabularies."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import tiktoken

#: White space as Unicode defines it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run without white space and the one blank before it, or white space up to that blank.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Where cutting a text at single blanks would not give the pieces above.
IRREGULAR = re.compile(f" [{SPACE}]|[{SPACE[7:]}]| $")
#: Where a pre-token begins whatever is around it: a blank between words.
BEGINS = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")


def pieces(text: str) -> list[str]:
    """Cut a text where the pre-token pattern always cuts.

    A pre-token holds white space only in front (one blank) or is all white
    space, and white space before a word never takes the last blank with it.
    So a blank with a word behind it always starts a pre-token, and the pieces
    can be encoded one by one.
    """
    if IRREGULAR.search(text):
        return PIECE.findall(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)] if first else list(map(" ".__add__, rest))


@lru_cache(maxsize=4)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def encoding_of(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary at ``path`` (ranks) with the public pattern."""
    return tiktoken.Encoding(
        path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(path), special_tokens={}
    )


class Encoder:
    """Ids of one pre-token, and of a whole text as little-endian 32-bit numbers.

    Nothing is remembered: the library cuts and encodes a text about twice as
    fast as its words can be looked up one by one.
    """

    def __init__(self, ranks_path: str):
        encoding = encoding_of(ranks_path)
        self.one = encoding._core_bpe.encode_single_piece
        self.any = encoding.encode_ordinary

    def ids(self, piece: str) -> list[int]:
        if piece.isascii():
            word = piece[1:] if piece[:1] == " " else piece
            if word.isalpha():
                return self.one(piece.encode())
            if word[-1:] in (",", ".") and word[:-1].isalpha():
                return self.one(piece[:-1].encode()) + self.one(piece[-1:].encode())
        return self.any(piece)

    def encode(self, text: str) -> bytes:
        return b"".join(array("I", self.any(part)).tobytes() for part in stretches(text))


def stretches(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text cut where a pre-token always begins, after ``size`` characters each."""
    begin = 0
    while len(text) - begin > size and (cut := BEGINS.search(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


@lru_cache(maxsize=4)
def encoder(ranks_path: str) -> Encoder:
    """One per Python worker."""
    return Encoder(ranks_path)


def with_special(text: str, special: dict[str, int], encode) -> Iterator[bytes]:
    """Ids of a text in which the strings of special tokens stand for their ids."""
    if not any(name in text for name in special):
        yield encode(text)
        return
    longest = sorted(special, key=len, reverse=True)
    for part in re.split(f"({'|'.join(map(re.escape, longest))})", text):
        if part in special:
            yield special[part].to_bytes(4, "little")
        elif part:
            yield encode(part)
