"""Packing, token counts and the codec against the public libraries."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import awkward_rows, pairs_of, prose
from tidewire.llm import codec, packing, queries, token_counts, vocab

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_JSON = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTE_JSON)


@pytest.fixture(scope="module")
def word_level():
    return Tokenizer.from_file(WORD_JSON)


def check_packing(rows, texts, byte_level, length):
    """Every id once, sequences gapless, padding only where a length is no power of two."""
    expected = defaultdict(list)
    for doc_id, text in texts:
        ids = byte_level.encode(text, add_special_tokens=False).ids + [1]
        expected[doc_id].append(np.array(ids, "<u4").tobytes())
    found = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] > 0
        found[r["doc_id"]][r["start"]].append((r["ids"], r["doc_tokens"]))
    for doc_id, copies in expected.items():
        total = sum(len(ids) for starts in found[doc_id].values() for ids, _ in starts)
        assert total == sum(map(len, copies))
        for start, parts in found[doc_id].items():
            for ids, tokens in parts:
                assert any(
                    len(c) == 4 * tokens and c[4 * start : 4 * start + len(ids)] == ids
                    for c in copies
                )
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        pieces.sort()
        at = 0
        for offset, size in pieces:
            assert offset == at
            at += size
        assert at <= length and (at == length or at & (at - 1) == 0)


def test_packing_of_awkward_rows(awkward, byte_level):
    rows = packing.pack(awkward, BYTE_JSON, length=256).collect()
    check_packing(rows, pairs_of(awkward), byte_level, 256)


def test_packing_query(spark, tables, documents, byte_level):
    rows = packing.pack(documents, BYTE_JSON).collect()
    check_packing(rows, pairs_of(documents), byte_level, 2048)
    digests = queries.op1_packing(spark, tables).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["doc_tokens"])
    assert sum(r["length"] for r in digests) == sum(r["length"] for r in rows)
    crcs = {(*key(r), zlib.crc32(r["ids"])) for r in rows}
    same = {(*key(r), r["ids_crc32"]) for r in digests}
    assert len(crcs & same) > 0.5 * len(crcs)  # cuts depend on where range partitions end


def test_packing_keeps_neighbours_together():
    points = np.stack(np.meshgrid(range(16), range(16)), -1).reshape(-1, 2)
    index = packing.hilbert_index(points, 4)
    assert sorted(index.tolist()) == list(range(256))
    along = points[np.argsort(index)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


def test_likeness_shortens_the_way_on_the_curve():
    draw = random.Random(1)
    a = [np.array(draw.choices(range(100), k=300), np.uint32) for _ in range(20)]
    b = [np.array(draw.choices(range(2000, 2100), k=300), np.uint32) for _ in range(20)]
    keys = packing.curve_keys([x for pair in zip(a, b) for x in pair])
    group = [k % 2 for k in np.argsort(keys).tolist()]
    assert sum(x != y for x, y in zip(group, group[1:])) < 12


def test_pieces_encode_like_whole_texts(byte_level):
    encoding = vocab.encoding_of(RANKS)
    blanks = [" ", "  ", "\n", " \n", "\n ", "\t", "\r\n", " ", " ", "\x1c", "\x85", ""]
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(
            draw.choice(blanks) + draw.choice(["it's", "Abc", "12", "!?", "é", "日本", "x\x1fy", "'ll"])
            for _ in range(draw.randint(0, 12))
        ) + draw.choice(blanks)
        ids = np.frombuffer(vocab.Encoder(RANKS).encode(text), "<u4").tolist()
        assert "".join(vocab.pieces(text)) == text
        assert ids == encoding.encode_ordinary(text)
        assert ids == byte_level.encode(text, add_special_tokens=False).ids


def test_white_space_is_that_of_the_vocabulary():
    one = vocab.tiktoken.Encoding(
        "spaces", pat_str=r"\s", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}
    )
    for code in [*range(0xD800), *range(0xE000, 0x11000)]:
        assert bool(one.encode_ordinary(chr(code))) == bool(vocab.re.match(f"[{vocab.SPACE}]", chr(code)))


def test_token_counts_of_awkward_rows(awkward, word_level):
    rows = token_counts.token_counts(awkward, WORD_JSON, limit=100, chunk=300, overlap=32).collect()
    expected = sorted(
        (str(i), len(t.encode()), n := len(word_level.encode(t, add_special_tokens=False).ids), n > 100)
        for i, t in pairs_of(awkward)
    )
    assert sorted((str(r[0]), *r[1:]) for r in rows) == expected


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (200, 16), (1000, 512)])
def test_spliced_chunks_equal_the_whole(word_level, chunk, overlap):
    def encode(text):
        encoded = word_level.encode(text, add_special_tokens=False)
        return encoded.ids, encoded.offsets

    hard = [
        prose(1, 900),
        "x" * 900 + " " + "y" * 500,
        "a <|endoftext|> b" * 90,
        "é " * 300 + "ﬁ İ" * 200,
        "don't " * 200 + "12345 " * 100,
        " " * 2000 + "end",
    ]
    for text in hard:
        whole = word_level.encode(text, add_special_tokens=False).ids
        assert token_counts.spliced_ids(encode, text, chunk, overlap) == whole


def test_overlap_widens_until_a_boundary_is_found(word_level):
    calls = []

    def encode(text):
        calls.append(len(text))
        e = word_level.encode(text, add_special_tokens=False)
        return e.ids, e.offsets

    text = "b" * 150 + " " + "c" * 400 + " tail of it"
    assert token_counts.spliced_ids(encode, text, 100, 8) == encode(text)[0]
    assert max(calls[:-1]) > 200


def test_token_counts_query(spark, tables, documents, word_level):
    rows = {r["doc_id"]: r for r in queries.op3_token_counts(spark, tables).collect()}
    for doc_id, text in pairs_of(documents):
        assert rows[doc_id]["n_tokens"] == len(word_level.encode(text, add_special_tokens=False).ids)
        assert rows[doc_id]["over_limit"] == (rows[doc_id]["n_tokens"] > 2048)


def test_codec_round_trip_of_awkward_rows(awkward):
    encoding = vocab.encoding_of(RANKS)
    rows = codec.decode(codec.encode(awkward, RANKS), RANKS).collect()
    expected = sorted((str(i), encoding.encode_ordinary(t), t.encode()) for i, t in pairs_of(awkward))
    assert sorted((str(r[0]), r[1], bytes(r[2])) for r in rows) == expected


def test_codec_blocks_do_not_change_the_result(awkward, monkeypatch):
    encoding = vocab.encoding_of(RANKS)
    monkeypatch.setattr(codec, "BLOCK", 200)
    batch = awkward.select("doc_id", "text").na.fill("").toArrow().to_batches()
    blocks = list(codec.blocks(iter(batch), 200))
    assert len(blocks) > 3
    assert sorted(t for _, _, held in blocks for t in held) == sorted(t for _, t in pairs_of(awkward))
    assert encoding.decode(encoding.encode_ordinary("é x")) == "é x"


def test_codec_query(spark, tables, documents):
    encoding = vocab.encoding_of(RANKS)
    rows = {r["doc_id"]: r for r in queries.op7_global_words(spark, tables).collect()}
    texts = dict(pairs_of(documents))
    assert rows.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = encoding.encode_ordinary(text)
        assert rows[doc_id]["n_tokens"] == len(ids)
        assert rows[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_small_numbers_travel_whole():
    draw = np.random.default_rng(1)
    for numbers in ([], [0], [127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1], draw.integers(0, 2**28, 500)):
        numbers = np.array(numbers, np.uint32)
        assert codec._spread(codec._squeezed(numbers)).tolist() == numbers.tolist()


def test_empty_tables(frame):
    none = frame([])
    assert packing.pack(none, BYTE_JSON).collect() == []
    assert token_counts.token_counts(none, WORD_JSON).collect() == []
    assert codec.decode(codec.encode(none, RANKS), RANKS).collect() == []


def test_rows_without_text(frame):
    blank = frame([(1, None), (2, "")])
    assert sorted(r["length"] for r in packing.pack(blank, BYTE_JSON).collect()) == [1, 1]
    assert [r["ids"] for r in codec.encode(blank, RANKS).collect()] == [[], []]
    assert len(awkward_rows()) == 20
