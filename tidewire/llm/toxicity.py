"""Toxicity by compression distance: how much shorter toxic dictionaries make a window than an ordinary one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, texts

#: Bound of the training sample: rows of each class, bytes of each row.
TRAIN_ROWS, TRAIN_BYTES = 4000, 8192
#: Bytes of a window, and of the dictionaries' two parts.
WINDOW, SHARED, OWN = 48, 8192, 4096
LEVEL, MATCH = 6, 4
#: Standard deviations by which a stem's toxic texts must exceed what chance gives.
EXCESS = 7
#: Where a document's numbers come from: the gain of a window that counts.
SOME, MUCH = 2, 4
#: How many: five for each toxic dictionary, and the text's length.
NUMBERS = 11


def windows(data: bytes) -> list[bytes]:
    """Cut a text at the first blank after each WINDOW bytes, or at twice that without one."""
    found, begin, size = [], 0, len(data)
    while begin < size:
        end = data.find(b" ", begin + WINDOW - 12)
        end = size if end < 0 else end
        end = min(end, begin + 2 * WINDOW, size)
        found.append(data[begin:end])
        begin = end
    return found


@dataclass(frozen=True)
class Model:
    """Contents of the dictionaries and the calibration of the gains to a probability."""

    toxic: bytes
    stems: bytes
    ordinary: bytes
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        source_size=WINDOW,
        dict_size=len(content),
        min_match=MATCH,
        write_content_size=False,
    )
    kind = zstandard.DICT_TYPE_RAWCONTENT
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


@lru_cache(maxsize=4)
def _compressors(*contents: bytes):
    return [_compressor(content).compress for content in contents]


def gains(text: str, model: Model) -> tuple[float, ...]:
    """How much shorter each toxic dictionary makes the windows of a text than the ordinary one."""
    *others, ordinary = _compressors(model.toxic, model.stems, model.ordinary)
    cut = windows(text.lower().encode())
    plain = np.array([len(ordinary(w)) for w in cut] or [0], float)
    numbers: list[float] = []
    for shorter in others:
        gain = plain - np.array([len(shorter(w)) for w in cut] or [0], float)
        top = np.sort(gain)[::-1]
        numbers += [
            gain.clip(0).mean(),
            (gain >= SOME).mean(),
            (gain >= MUCH).mean(),
            top[0],
            top[:3].mean(),
        ]
    return (*numbers, float(np.log(len(plain))))


def probability(numbers: np.ndarray, model: Model) -> np.ndarray:
    scaled = (numbers - np.array(model.means)) / np.array(model.scales)
    return 1 / (1 + np.exp(-np.clip(scaled @ np.array(model.weights) + model.bias, -30, 30)))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary of about ``size`` bytes; the samples' end where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _stems(word: str) -> set[str]:
    return {word[:4], word[:5], word} if len(word) > 3 else set()


def telling_stems(rows: list[tuple[str, int]]) -> list[bytes]:
    """Words and their beginnings far more frequent in toxic texts, rarest first.

    A stem counts where it follows many different words: copies of one text
    repeat its words in one context.
    """
    within: dict[int, Counter] = {0: Counter(), 1: Counter()}
    before: dict[str, set[str]] = defaultdict(set)
    count = Counter(label for _, label in rows)
    for text, label in rows:
        words = text.lower().split()
        own = set()
        for left, word in zip(["", *words], words):
            stems = _stems(word)
            own |= stems
            if label:
                for stem in stems:
                    before[stem].add(left)
        within[label].update(own)
    contexts = max(3, min(6, count[1] // 20))
    share = count[1] / max(len(rows), 1)
    told = []
    for stem, n in within[1].items():
        expected = share * (n + within[0][stem])
        if len(before[stem]) >= contexts and n - expected > EXCESS * expected**0.5:
            told.append((n, stem))
    return [stem.encode() for _, stem in sorted(told)]


def _split(rows: list[tuple[str, int]]) -> tuple[list, list]:
    """Two thirds to learn from and the rest to check, of each class; a class of one row is in both."""
    learn, check = [], []
    for label in (0, 1):
        own = sorted({row for row in rows if row[1] == label})
        random.Random(7).shuffle(own)
        cut = 2 * len(own) // 3
        learn += own[:cut] if cut else own
        check += own[cut:]
    return learn, check


def fit(rows: list[tuple[str, int]], share: float) -> Model:
    """Train the dictionaries on two thirds of labelled texts and calibrate on the rest.

    All dictionaries share one part, trained on windows of ordinary text, and
    differ in the part before it: the toxic one's is trained on windows of
    toxic texts, the ordinary one's on more windows of ordinary text; that of
    the stems has the telling stems in place of a part of the latter, or is the
    ordinary one where no stem tells. ``share``: of toxic
    texts among all labelled ones, to which the probabilities are calibrated;
    the score of every text where one class has no text.
    """
    learn, check = _split(rows)
    of_class: list[list[bytes]] = [[], []]
    for text, label in learn:
        of_class[label] += windows(text.lower().encode())
    for seed, own in zip((8, 9), of_class):
        random.Random(seed).shuffle(own)
    plain, toxic = of_class
    told = b"".join(b" " + w for w in telling_stems(learn))[-OWN:]
    shared = _trained(plain[:40_000], SHARED)
    other = _trained(plain[40_000:80_000] or plain, OWN)
    own = _trained(toxic[:40_000], OWN)
    stems = told + other[len(told) :]
    neutral = (0.0,) * NUMBERS
    model = Model(
        own + shared, stems + shared, other + shared, neutral, (1.0,) * NUMBERS, neutral, 0.0
    )
    labels = np.array([label for _, label in check], float)
    if not 0 < labels.sum() < len(labels):
        bias = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
        return replace(model, bias=bias)
    numbers = np.array([gains(text, model) for text, _ in check])
    means, scales = numbers.mean(axis=0), numbers.std(axis=0) + 1e-6
    inputs = np.column_stack([(numbers - means) / scales, np.ones(len(numbers))])
    weights, ridge = np.zeros(NUMBERS + 1), np.diag([1.0] * NUMBERS + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(inputs @ weights, -30, 30)))
        slope = inputs.T @ (labels - p) - ridge @ weights
        weights += np.linalg.solve((inputs * (p * (1 - p))[:, None]).T @ inputs + ridge, slope)
    seen = labels.mean()
    shift = np.log(share / (1 - share)) - np.log(seen / (1 - seen))
    return replace(
        model,
        means=tuple(means.tolist()),
        scales=tuple(scales.tolist()),
        weights=tuple(weights[:-1].tolist()),
        bias=float(weights[-1] + shift),
    )


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most TRAIN_BYTES of a text: itself, or four parts spread evenly over all of it."""
    part = TRAIN_BYTES // 4
    for batch in batches:
        cut = []
        for text in batch["text"].to_pylist():
            data = text.encode()
            if len(data) > TRAIN_BYTES:
                places = np.linspace(0, len(data) - part, 4).astype(int).tolist()
                data = b" ".join(data[at : at + part] for at in places)
            cut.append(data.decode(errors="ignore"))
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(cut, pa.string()), batch["toxic"]],
            names=["doc_id", "text_hash", "text", "toxic"],
        )


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit a model on a bounded sample of labelled documents.

    ``labels``: doc_id, toxic (0 or 1). Of each class the TRAIN_ROWS ids with
    the smallest hashes, of each id the row with the smallest text hash, of each
    text at most TRAIN_BYTES; that reaches the driver. Rows without id or label teach nothing; an id labelled twice is
    toxic if any says so. Without both classes every text gets the share of
    toxic labels as its score.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    counts = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    picked = [
        known.where(F.col("toxic") == label)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_ROWS)
        for label in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * TRAIN_ROWS narrow rows
    text_hash = F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    cut = texts(docs, text_hash).join(sample, "doc_id").select("doc_id", "text_hash", "text", "toxic")
    rows = (
        cut.mapInArrow(_excerpts, "doc_id long, text_hash long, text string, toxic int")
        .groupBy("doc_id")
        .agg(F.min(F.struct("text_hash", "text", "toxic")).alias("row"))
        .select("row.text", "row.toxic")
        .collect()
    )
    share = (counts[1] + 0.5) / (counts[0] + 1) if counts[0] else 0.0
    return fit([(row["text"], row["toxic"]) for row in rows], share)


def scores(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every document, one row for each.

    The whole text is cut into windows; the three dictionaries compress each. No
    shuffle. Null or empty text: scored as a text without gains. Repeated rows:
    scored each. No rows: no rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array([gains(t.as_py(), model) for t in batch["text"]]).reshape(-1, NUMBERS)
            p = probability(numbers, model)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    return texts(docs).mapInArrow(lean(score), "doc_id long, score double, predicted int")
