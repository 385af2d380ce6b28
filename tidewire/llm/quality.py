"""Quality rules: word statistics, and robust outliers among them per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import lean, stored

BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
UPPER, LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(65, 91)) + bytes(range(97, 123))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, in units of 1 / UNIT, so that sums of them are exact.
FEATURES = ("x_words", "x_length", "x_symbols", "x_lines", "x_repeats", "x_upper")
UNIT = 256
#: Words of five letters added to a text's shares, so that few words don't make them extreme.
FEW = 20
#: Standard deviation that each feature is granted at least, in its own unit: about what one
#: symbol or capital more in some 400 letters adds, or one equal line or word in some 100.
FLOORS = (0.25, 0.1, 0.05, 0.1, 0.1, 0.05)
#: Share of the rows in the minimum-covariance subset; bins of a factor 4 in distance.
SUBSET, BINS = 0.75, 64
#: A C-step counts if the logarithm of the determinant falls by more.
GAIN = 0.01
#: Rows that a language's estimate stands for in that of its sources, and that of all
#: rows in a language's.
PRIOR = 200
#: A clean row exceeds the limit with this probability, were the features normal.
RISK = 1e-5
PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words in ``window``-word windows that occur twice or more, the first ones included."""
    starts = len(words) - window + 1
    if starts < 2:
        return 0
    of_word = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(starts, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + of_word[k : k + starts]
    order = np.argsort(mixed, kind="stable")
    same = np.diff(mixed[order]) == 0
    if not same.any():
        return 0
    # Equal windows have equal hashes; those with company are compared themselves.
    suspects = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    places: dict[tuple, list[int]] = {}
    for at in suspects.tolist():
        places.setdefault(tuple(words[at : at + window]), []).append(at)
    covered = np.zeros(len(words) + 1, np.int64)
    for found in places.values():
        if len(found) > 1:
            begins = np.array(found)
            np.add.at(covered, begins, 1)
            np.add.at(covered, begins + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS, then the features, of one text."""
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, BLANKS))
    chars = len(text) - blanks
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    dup_lines = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    letters = len(data) - len(data.translate(None, LETTERS))
    upper = len(data) - len(data.translate(None, UPPER))
    n = len(words)
    shares = (
        math.log2(1 + n),
        math.log2((chars + 5 * FEW) / (n + FEW)),
        math.sqrt(symbols / (chars + 5 * FEW)),
        math.sqrt(dup_lines / (len(lines) + 1)),
        math.sqrt(repeats / (n + FEW)),
        math.sqrt(upper / (letters + 5 * FEW)),
    )
    features = (round(UNIT * x) for x in shares)
    return (len(words), chars, symbols, dup_lines, repeats, *features)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, language, source, the counts and the features, per row."""
    names = [*COUNTS, *FEATURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch["text"]], np.int64)
            columns = rows.reshape(-1, len(names)).T
            yield pa.RecordBatch.from_arrays(
                [batch[c] for c in ("doc_id", "text_hash", "lang", "source")]
                + [pa.array(c) for c in columns],
                names=["doc_id", "text_hash", "lang", "source", *names],
            )

    schema = "doc_id long, text_hash long, lang string, source string, "
    schema += ", ".join(f"{name} long" for name in names)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64(text).alias("text_hash"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    ).mapInArrow(lean(measure), schema)
    return rows.withColumn(
        "base_failed",
        F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"),
    )


def _levels(rows: DataFrame) -> DataFrame:
    """Add the names of the groups a row belongs to: ``own`` (language and source), ``language``."""
    return rows.withColumns(
        {
            "own": F.concat(F.lit("group "), F.to_json(F.struct("lang", "source"))),
            "language": F.concat(F.lit("language "), F.to_json(F.struct("lang"))),
        }
    )


def _even_chi2(x: float, freedom: int) -> float:
    """Distribution function of chi-squared with an even number of degrees of freedom."""
    terms = [(x / 2) ** k / math.factorial(k) for k in range(freedom // 2)]
    return 1 - math.exp(-x / 2) * sum(terms)


def _chi2_point(share: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _even_chi2(middle, freedom) < share else (low, middle)
    return high


#: Makes the covariance of the nearest SUBSET of normal rows that of all of them.
CONSISTENT = SUBSET / _even_chi2(_chi2_point(SUBSET, len(FEATURES)), len(FEATURES) + 2)
CENTERS = [f"c{i}" for i in range(len(FEATURES))]
SPREADS, INVERSES = ([f"{x}{i}{j}" for i, j in PAIRS] for x in "vp")
VALUES = ", ".join(f"{name} double" for name in CENTERS + SPREADS + INVERSES)
MODEL = f"kind string, start int, moving boolean, n long, logdet double, {VALUES}"


def _values(center: np.ndarray, spread: np.ndarray) -> tuple[float, dict[str, float]]:
    """Log determinant and columns of a model; its inverse has floors on the diagonal."""
    granted = spread + np.diag((UNIT * np.array(FLOORS)) ** 2)
    inverse = np.linalg.inv(granted)
    columns = dict(zip(CENTERS, center.tolist()))
    columns |= {f"v{i}{j}": float(spread[i, j]) for i, j in PAIRS}
    columns |= {f"p{i}{j}": float(inverse[i, j]) for i, j in PAIRS}
    return float(np.linalg.slogdet(granted)[1]), columns


def _square(values: list[float]) -> np.ndarray:
    found = np.zeros((len(FEATURES), len(FEATURES)))
    for (i, j), value in zip(PAIRS, values):
        found[i, j] = found[j, i] = value
    return found


def _sums() -> list[Column]:
    """Rows, sums of the features and of their products: whole numbers, so any order gives the same.

    A product is below 2^27 and the sum a long: past 6e10 rows of one bin the
    job would fail, not round.
    """
    features = [F.col(name) for name in FEATURES]
    return [
        F.count("*").alias("n"),
        *(F.sum(x).alias(f"s{i}") for i, x in enumerate(features)),
        *(F.sum(features[i] * features[j]).alias(f"q{i}{j}") for i, j in PAIRS),
    ]


def _moments(sums: pd.DataFrame, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Center and covariance from the weighted sums of several rows of sums."""
    n = float(weight @ sums["n"].to_numpy(float))
    center = np.array([weight @ sums[f"s{i}"].to_numpy(float) for i in range(len(FEATURES))]) / n
    second = _square([weight @ sums[f"q{i}{j}"].to_numpy(float) / n for i, j in PAIRS])
    return center, second - np.outer(center, center)


def _starts(table: pd.DataFrame) -> pd.DataFrame:
    """Three models to start from: quartile ranges, the floors alone, the moments of all rows."""
    row = table.iloc[0]
    quartiles = np.array([row[name] for name in FEATURES], float)
    scale = (quartiles[:, 2] - quartiles[:, 0]) / 1.349
    middle = quartiles[:, 1]
    starts = [
        (middle, np.diag(scale**2)),
        (middle, np.zeros((len(FEATURES), len(FEATURES)))),
        _moments(table, np.ones(1)),
    ]
    head = {"kind": row["kind"], "moving": True, "n": row["n"], "logdet": np.inf}
    return pd.DataFrame([head | {"start": k} | _values(*x)[1] for k, x in enumerate(starts)])


def _step(sums: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
    """One C-step: the moments of the nearest SUBSET of the rows, if their determinant is smaller.

    Of the bin that the subset ends in it takes the share it needs.
    """
    if sums.empty or model.empty:
        return model
    sums = sums.sort_values("bin")
    n = sums["n"].to_numpy(float)
    weight = np.clip((SUBSET * n.sum() - (np.cumsum(n) - n)) / n, 0, 1)
    center, spread = _moments(sums, weight)
    logdet, columns = _values(center, spread * CONSISTENT)
    if not logdet < model["logdet"].iloc[0] - GAIN:
        return model.assign(moving=False)
    return model.assign(logdet=logdet, **columns)


def distance() -> Column:
    """Squared Mahalanobis distance of a row's features under the model beside it."""
    off = [F.col(name) - F.col(f"c{i}") for i, name in enumerate(FEATURES)]
    terms = [
        off[i] * off[j] * F.col(f"p{i}{j}") * F.lit(1.0 if i == j else 2.0) for i, j in PAIRS
    ]
    return sum(terms[1:], terms[0])


def fitted(rows: DataFrame) -> DataFrame:
    """The minimum-covariance-determinant model of every ``kind``.

    Each of three starts takes C-steps until its determinant stands still, and
    the start with the least one wins. A C-step measures all rows, sums
    features and their products per group and bin of log distance, and takes
    the bins from the nearest on until they hold SUBSET of the rows; mean and
    covariance of those give the next model. A group gives at most some
    thousand sums per task, however many rows it has.
    """
    first = rows.groupBy("kind").agg(
        *(F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(name)
          for name in FEATURES),
        *_sums(),
    )
    model = stored(first.groupBy("kind").applyInPandas(_starts, MODEL), "model")
    # Ends: a model that moves on has lost GAIN, and the floors bound the determinant.
    while not (moving := model.where("moving")).isEmpty():
        sums = (
            rows.join(moving.select("kind", "start", *CENTERS, *INVERSES), "kind")
            .withColumn("bin", F.floor(F.log2(distance() + 2.0**-10) * BINS / 2))
            .groupBy("kind", "start", "bin")
            .agg(*_sums())
        )
        last = model.toDF(*model.columns)
        steps = sums.groupBy("kind", "start").cogroup(last.groupBy("kind", "start"))
        model = stored(steps.applyInPandas(_step, MODEL), "model")
    best = F.min_by(F.struct(*model.columns), F.struct("logdet", "start"))
    return model.groupBy("kind").agg(best.alias("best")).select("best.*")


def models(rows: DataFrame, prior: float = PRIOR) -> DataFrame:
    """A model for each ``own`` group of ``rows``, from its rows, its language's and all.

    A group of n rows has its own estimate with the weight n / (n + ``prior``)
    and its language's with the rest; a language shares with all rows in the
    same way. What is mixed are the moments, so the distance between two
    centers adds to the covariance. One formula for every size: large groups
    are practically their own, a single row is nearly its language.
    """
    kinds = F.array(F.lit("all"), "language", "own")
    fits = stored(fitted(rows.select(*FEATURES, F.explode(kinds).alias("kind"))), "fits")
    members = rows.select("own", "language").distinct()
    members = members.select("own", F.posexplode(kinds).alias("level", "kind"))

    def mixed(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("level")
        center, second = np.zeros(len(FEATURES)), np.zeros((len(FEATURES), len(FEATURES)))
        for k, row in enumerate(table.to_dict("records")):
            share = row["n"] / (row["n"] + prior) if k else 1.0
            own = np.array([row[name] for name in CENTERS])
            spread = _square([row[name] for name in SPREADS])
            center = share * own + (1 - share) * center
            second = share * (spread + np.outer(own, own)) + (1 - share) * second
        columns = _values(center, second - np.outer(center, center))[1]
        return pd.DataFrame([{"own": table["own"].iloc[0]} | columns])

    return members.join(fits, "kind").groupBy("own").applyInPandas(mixed, f"own string, {VALUES}")


def quality(docs: DataFrame, risk: float = RISK) -> DataFrame:
    """Counts, base_failed, distance and kept of every document.

    ``docs``: doc_id, text, lang, source. A document is kept unless the base
    rules fail it or its transformed statistics (length, word length, symbols,
    equal lines, repeated windows, capitals) lie too far from the bulk of its
    language and source: squared Mahalanobis distance above the chi-squared
    point of ``risk``, under the group's minimum-covariance-determinant
    estimates (``models``), from all rows that pass the base rules.

    Null text: no words, so it fails. Null language or source: groups of their
    own. Repeated rows count each. No rows: no rows.
    """
    rows = stored(measured(docs), "statistics")
    good = _levels(rows.where("NOT base_failed"))
    limit = _chi2_point(1 - risk, len(FEATURES))
    judged = good.join(stored(models(good), "models"), "own").withColumn("distance", distance())
    verdicts = judged.select(*rows.columns, "distance", (F.col("distance") <= limit).alias("kept"))
    failed = rows.where("base_failed").select(
        *rows.columns, F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return verdicts.unionByName(failed)


def without_rejected(docs: DataFrame, risk: float = RISK) -> DataFrame:
    """The documents that ``quality`` keeps, all their columns."""
    rejected = stored(
        quality(docs, risk)
        .where("NOT kept")
        .select(F.col("doc_id").alias("rejected_id"), F.col("text_hash").alias("rejected_hash"))
        .distinct(),
        "rejected",
    )
    same = docs["doc_id"].eqNullSafe(rejected["rejected_id"]) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == rejected["rejected_hash"]
    )
    return docs.join(rejected, same, "left_anti")
