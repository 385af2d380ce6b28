"""Collocations: phrases whose words occur together, by sorted streams of counts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, stored
from tidewire.operators.partitioning import spread
from tidewire.operators.ranking import top_n

#: Text bytes counted together in a task, and of one stretch of a long text.
BLOCK, STRETCH = 4 << 20, 1 << 20
#: What ends a piece, and what parts the words of one (fixed values).
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PLAIN = bytes.maketrans(CAPITALS + ENDS + BLANKS, CAPITALS.lower() + b"\n" * len(ENDS) + b"  ")
#: Numbers of the tokens that are no words.
NOTHING, END = 0, 1
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
COUNTED = pa.schema(
    [("lang", pa.string()), ("phrase", pa.string()), ("slot", pa.int64()), ("n", pa.int64())]
)
#: Bits of one row of Spark's bitmap aggregate.
BITMAP = 32_768


class Numbers(dict):
    """token -> its number, in order of appearance; what is no word comes first."""

    def __init__(self):
        super().__init__({b"": NOTHING, b"\n": END})

    def __missing__(self, token: bytes) -> int:
        self[token] = found = len(self)
        return found


def stretches(data: bytes, longest: int, size: int = STRETCH) -> Iterator[tuple[bytes, bytes]]:
    """Cut a text (``PLAIN``) into (own, ahead), so that each phrase begins in one ``own``.

    ``ahead`` holds the words that phrases of ``longest`` words reach beyond
    ``own``: none where the cut is the end of a piece.
    """
    reach = re.compile(rb"(?: +[^ \n]+){0,%d}" % (longest - 1))
    begin = 0
    while len(data) - begin > size:
        cut = data.find(b"\n", begin + size, begin + 2 * size)
        if cut < 0:
            blank, end = data.find(b" ", begin + size), data.find(b"\n", begin + size)
            cut = min((x for x in (blank, end) if x >= 0), default=len(data))
        yield data[begin:cut], reach.match(data, cut)[0]
        begin = cut
    yield data[begin:], b""


class Block:
    """The words of some texts of one language, as numbers in reading order."""

    def __init__(self, lang: str, cut: list[tuple[bytes, bytes]]):
        numbers, tokens, ahead = Numbers(), [], []
        for own, beyond in cut:
            tokens += own.replace(b"\n", b" \n ").split(b" ")
            if beyond:
                begin = len(tokens)
                tokens += beyond.split(b" ")
                ahead.append((begin, len(tokens)))
            tokens.append(b"\n")
        ids = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        del tokens
        counts = np.ones(len(ids), bool)
        for begin, end in ahead:
            counts[begin:end] = False
        there = ids != NOTHING
        self.lang, self.words, self.ids = lang, list(numbers), ids[there]
        #: Where a phrase may begin.
        self.first = counts[there] & (self.ids != END)
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in self.words], np.uint64)

    def places(self, length: int, everywhere: bool = False) -> np.ndarray:
        """Where phrases of ``length`` words begin; they don't cross the ends of pieces.

        ``everywhere``: those too that begin in the words ahead, counted elsewhere.
        """
        if len(self.ids) < length:
            return np.zeros(0, np.int64)
        last = len(self.ids) - length + 1
        good = (self.ids != END if everywhere else self.first)[:last].copy()
        for k in range(1, length):
            good &= self.ids[k : last + k] != END
        return np.flatnonzero(good)

    def slots(self, places: np.ndarray, length: int) -> np.ndarray:
        """64 bits for the phrase at each place, the same wherever it stands."""
        mixed = np.zeros(len(places), np.uint64)
        for k in range(length):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * ODD[0] + self.hashes[self.ids[places + k]]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * ODD[1]
        return mixed ^ (mixed >> np.uint64(29))

    def phrases(self, places: np.ndarray, length: int) -> tuple[list[str], np.ndarray]:
        """The distinct phrases at ``places`` and how often each is there, told apart by their words."""
        if not len(places):
            return [], np.zeros(0, np.int64)
        key = self.ids[places]
        for k in range(1, length):
            key = np.unique(key, return_inverse=True)[1] * len(self.words) + self.ids[places + k]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        spans = self.ids[places[first][:, None] + np.arange(length)]
        return [b" ".join([self.words[i] for i in s]).decode() for s in spans.tolist()], count


def _blocks(batches: Iterator[pa.RecordBatch], longest: int, size: int) -> Iterator[Block]:
    held: dict[str, list] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            for own, ahead in stretches(text.as_py().encode().translate(PLAIN), longest):
                held.setdefault(lang, []).append((own, ahead))
                total += len(own)
                if total >= size:
                    yield from (Block(*item) for item in held.items())
                    held, total = {}, 0
    yield from (Block(*item) for item in held.items())


def _rows(lang, phrases, slots, counts) -> pa.RecordBatch:
    many = len(counts)
    columns = [
        pa.array([lang] * many, pa.string()),
        pa.array(phrases if phrases is not None else [None] * many, pa.string()),
        pa.array(slots.view(np.int64)) if slots is not None else pa.nulls(many, pa.int64()),
        pa.array(counts, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=COUNTED)


def _slot_rows(block: Block, places: np.ndarray, length: int) -> pa.RecordBatch:
    slots, counts = np.unique(block.slots(places, length), return_counts=True)
    return _rows(None, None, slots, counts)


def _phrase_rows(block: Block, places: np.ndarray, length: int) -> pa.RecordBatch:
    phrases, counts = block.phrases(places, length)
    return _rows(block.lang, phrases, None, counts)


def _passing(block: Block, length: int, bits: np.ndarray) -> np.ndarray:
    """For each place whether a phrase of ``length`` words begins there whose bit in ``bits`` is set."""
    places = block.places(length, everywhere=True)
    slot = block.slots(places, length) & np.uint64(8 * len(bits) - 1)
    byte, bit = (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)
    there = np.zeros(len(block.ids) + 1, bool)
    there[places] = (bits[byte] >> bit) & 1
    return there


def _bits(slots: DataFrame, filter_bits: int) -> np.ndarray:
    """A bitmap of ``2 ** filter_bits`` bits, those of ``slots`` set: 1 MB for 23 bits."""
    place = F.col("slot").bitwiseAND((1 << filter_bits) - 1)
    rows = slots.select(F.floor(place / BITMAP).alias("row"), (place % BITMAP).alias("bit"))
    found = np.zeros(1 << (filter_bits - 3), np.uint8)
    for row in rows.groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect():
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        at = row["row"] * BITMAP // 8
        found[at : at + len(part)] = part
    return found


def _summed(rows: DataFrame, least: int) -> DataFrame:
    """Counts added up; of phrases and slots only those that reach ``least``."""
    total = F.col("phrase").isNull() & F.col("slot").isNull()
    return (
        rows.groupBy("lang", "phrase", "slot")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") >= least) | total)
    )


def phrase_counts(
    docs: DataFrame, least: int = 30, longest: int = 4, filter_bits: int = 27, block: int = BLOCK
) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) of all words, and per number of words (lang, phrase, f) of all phrases with f >= least.

    One pass over the texts for each number of words. A pass counts the
    phrases that the pass before let through, as strings and exactly, and, for
    the next pass, hash values of the phrases one word longer both of whose
    parts it let through. Which hash values reach ``least`` goes to the tasks
    as a bitmap of ``2 ** filter_bits`` bits (16 MB for 27), whatever the
    size of the table: two phrases in one bit let one through for nothing, none
    is ever lost. Raise it where the frequent phrases are more than bits.
    """
    read = spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    context = docs.sparkSession.sparkContext

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in _blocks(batches, longest, block):
            words = one.places(1)
            yield _rows(one.lang, None, None, [len(words)])
            yield _phrase_rows(one, words, 1)
            if longest > 1:
                yield _slot_rows(one, one.places(2), 2)

    kinds = "lang string, phrase string, slot long, n long"
    found = stored(_summed(read.mapInArrow(lean(first), kinds), least), "words")
    totals = found.where("phrase IS NULL AND slot IS NULL").select("lang", "n")
    streams = [found]
    for length in range(2, longest + 1):
        sent = context.broadcast(_bits(found.where("slot IS NOT NULL"), filter_bits))

        def further(
            batches: Iterator[pa.RecordBatch], sent=sent, length=length
        ) -> Iterator[pa.RecordBatch]:
            for one in _blocks(batches, longest, block):
                there = _passing(one, length, sent.value)
                places = one.places(length)
                yield _phrase_rows(one, places[there[places]], length)
                if length < longest:
                    places = one.places(length + 1)
                    yield _slot_rows(one, places[there[places] & there[places + 1]], length + 1)

        found = stored(_summed(read.mapInArrow(lean(further), kinds), least), f"phrases{length}")
        sent.unpersist()
        streams.append(found)
    return totals, [
        s.where("phrase IS NOT NULL").select("lang", "phrase", F.col("n").alias("f")) for s in streams
    ]


def _without_last(phrase: str) -> Column:
    return F.regexp_replace(phrase, r" [^ ]*\z", "")


def _without_first(phrase: str) -> Column:
    return F.regexp_replace(phrase, r"\A[^ ]* ", "")


def _with_parts(longer: DataFrame, parts: DataFrame) -> DataFrame:
    """Give each phrase the counts of its parts, cut after its first word, its second, and so on.

    ``parts``: the phrases one word shorter, with their ``lefts`` and
    ``rights``. In prefix order a phrase stands behind what it is without its
    last word, in suffix order behind what it is without its first one: both
    are merges of two sorted streams.
    """
    def renamed(name: str) -> DataFrame:
        return parts.select(
            "lang",
            F.col("phrase").alias(name),
            F.col("f").alias(f"{name}_f"),
            F.col("lefts" if name == "prefix" else "rights").alias(f"{name}_counts"),
        ).hint("merge")

    return (
        longer.select("lang", "phrase", "f", _without_last("phrase").alias("prefix"), _without_first("phrase").alias("suffix"))
        .join(renamed("prefix"), ["lang", "prefix"])
        .join(renamed("suffix"), ["lang", "suffix"])
        .select(
            "lang",
            "phrase",
            "f",
            F.concat("prefix_counts", F.array("prefix_f")).alias("lefts"),
            F.concat(F.array("suffix_f"), "suffix_counts").alias("rights"),
        )
    )


def _extended(streams: list[DataFrame]) -> DataFrame:
    """(lang, phrase, longer_f): the largest count of a phrase one word longer, at either end."""
    both = None
    for stream in streams:
        part = stream.select(
            "lang", F.explode(F.array(_without_last("phrase"), _without_first("phrase"))).alias("phrase"), "f"
        )
        both = part if both is None else both.unionByName(part)
    return both.groupBy("lang", "phrase").agg(F.max("f").alias("longer_f"))


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    least: int = 30,
    longest: int = 4,
    first: int = 2000,
    within: int = 80,
    scale: int = 2_000_000,
    filter_bits: int = 27,
    block: int = BLOCK,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` best phrases of each language.

    A to Z count as a to z. Texts are cut into pieces by ``.,;:!?`` and line
    ends, pieces into words by blanks and tabs; phrases of 2 to ``longest``
    words lie within a piece and count ``a`` times, overlaps included. Of the
    ways to cut a phrase in two, with counts l and r, the one of the least
    floor(scale * a / (l + r)) counts, the first of equal ones. A phrase goes if
    one that holds it is at least ``within`` percent as frequent; as a longer
    one is never more frequent than what it holds, one word more at either end
    is enough to look at. Products are decimals of 38 digits, so exact.

    The counts are streams in prefix and in suffix order that sort-merge joins
    pass in lockstep (``_with_parts``). Spark deals the streams to tasks by
    their keys; a key that many phrases share is split by its skew handling.
    Null lang: ``und``. Null, empty texts and texts without words give nothing.
    Null doc_ids and repeated rows count like others. Ties: a descending, then
    the phrase's UTF-8 bytes. No rows: no rows. Other columns aren't looked at.
    """
    totals, streams = phrase_counts(docs, least, longest, filter_bits, block)
    return ranked(totals, streams, first, within, scale)


def ranked(
    totals: DataFrame, streams: list[DataFrame], first: int, within: int, scale: int
) -> DataFrame:
    """The rows of ``collocations`` from counts as ``phrase_counts`` returns them."""
    none = F.array().cast("array<long>")
    known = streams[0].select("*", none.alias("lefts"), none.alias("rights"))
    candidates = None
    for stream in streams[1:]:
        known = stored(_with_parts(stream, known), "parts")
        candidates = known if candidates is None else candidates.unionByName(known)
    cuts = F.expr(
        "transform(lefts, (l, k) -> named_struct('score', "
        f"cast((cast(f AS decimal(20,0)) * cast({scale} AS decimal(18,0))) "
        "div (cast(l AS decimal(20,0)) + cast(rights[k] AS decimal(20,0))) AS bigint), "
        "'k', k, 'l', l, 'r', rights[k]))"
    )
    rows = (
        candidates.join(_extended(streams[2:]).hint("merge"), ["lang", "phrase"], "left")
        if len(streams) > 2
        else candidates.withColumn("longer_f", F.lit(None).cast("long"))
    )
    free = F.col("longer_f").isNull() | (
        _exact(F.col("longer_f")) * 100 < _exact(F.col("f")) * within
    )
    scored = rows.where(free).select("lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = top_n(
        scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")),
        ["lang"],
        order,
        first,
    )
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
