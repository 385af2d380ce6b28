"""Article text and its chunks."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.ids import content_id
from tidewire.functions.text import let, strip_space, words
from tidewire.sources.schemas import METADATA_FIELDS

# Section size and overlap in characters, window in words, and
# the separators a section may be cut at, in the order they are tried.
MAX_CHARS = 4000
OVERLAP = 200
MAX_TOKENS = 254
SEPARATORS = ("\n\n", "\n", " ", "")


def refine(articles: DataFrame) -> DataFrame:
    """One text per article (title "." description) and its metadata."""
    return articles.select(
        F.col("article_id").alias("doc_id"),
        F.concat_ws(".", "title", "description").alias("full_text"),
        F.struct(*METADATA_FIELDS).alias("metadata"),
    )


def _cut(text: str, separator: str) -> list[str]:
    """Pieces that join back to ``text``; each later piece starts with the separator."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in (head, *(separator + r for r in rest)) if p]


def _pack(pieces: list[str], limit: int, overlap: int) -> list[str]:
    """Greedy runs of pieces up to ``limit`` characters, restarting inside the overlap.

    ``ends[i]`` is the length of the first i pieces, so each run is found with
    two binary searches.
    """
    ends = [0, *accumulate(map(len, pieces))]
    sections = []
    start = 0
    while True:
        stop = max(bisect_right(ends, ends[start] + limit) - 1, start + 1)
        section = "".join(pieces[start:stop]).strip()
        if section:
            sections.append(section)
        if stop >= len(pieces):
            return sections
        # Drop leading pieces until the rest fits the overlap and leaves room
        # for the next piece.
        keep_from = max(ends[stop] - overlap, ends[stop + 1] - limit)
        start = min(bisect_left(ends, keep_from, lo=start), stop)


def split_sections(
    text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, separators: tuple = SEPARATORS
) -> list[str]:
    """Sections of at most ``limit`` characters, cut at the coarsest separator present."""
    chosen = next(i for i, s in enumerate(separators) if s in text)
    finer = separators[chosen + 1 :]
    sections: list[str] = []
    waiting: list[str] = []
    for piece in _cut(text, separators[chosen]):
        if len(piece) < limit or not finer:
            waiting.append(piece)
            continue
        if waiting:
            sections += _pack(waiting, limit, overlap)
            waiting = []
        sections += split_sections(piece, limit, overlap, finer)
    return sections + (_pack(waiting, limit, overlap) if waiting else [])


def sections(text: Column, limit: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Text column to its array of sections.

    Only texts longer than ``limit`` are sent to Python; the others, as a rule
    nearly all, are one section and stay in the JVM.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split_long(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(
                lambda value: None if value is None else split_sections(value, limit, overlap)
            )

    long_text = F.when(F.length(text) > limit, text)
    short = F.filter(F.array(strip_space(text)), lambda section: section != "")
    return F.coalesce(split_long(long_text), short)


@dataclass(frozen=True)
class Tokens:
    """How a text is cut into tokens, and what joins a window's tokens to text again.

    ``cut`` takes a text column and gives its array of tokens: an expression,
    or a batched UDF around a model's own tokenizer. The default is words.
    """

    cut: Callable[[Column], Column] = words
    joined_by: str = " "


def token_windows(
    text: Column, max_tokens: int = MAX_TOKENS, tokens: Tokens = Tokens()
) -> Column:
    """Consecutive windows of ``max_tokens`` tokens, without overlap.

    Blank text gives one empty window.
    """

    def cut(found: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(max_tokens))

        def window(at: Column) -> Column:
            return strip_space(F.array_join(F.slice(found, at, max_tokens), tokens.joined_by))

        return F.transform(starts, window)

    return let(tokens.cut(text), cut)


def explode_windows(
    rows: DataFrame,
    text: str,
    *parents: str,
    max_tokens: int = MAX_TOKENS,
    tokens: Tokens = Tokens(),
) -> DataFrame:
    """One row per token window of ``text``: parents, ``pos``, ``chunk_id``, ``text``."""
    cut = token_windows(F.col(text), max_tokens, tokens)
    windows = rows.select(*parents, cut.alias("_windows"))
    # There is always a window, so the outer form changes nothing in the result;
    # it spares the derived filter that would cut the text a second time.
    exploded = windows.select(*parents, F.posexplode_outer("_windows").alias("pos", "text"))
    return exploded.select(*parents, "pos", content_id(F.col("text")).alias("chunk_id"), "text")


def _plugged_windows(
    in_sections: DataFrame, max_tokens: int, tokens: Tokens
) -> tuple[DataFrame, Column]:
    """Windows by a tokenizer that may be a UDF, which can't run inside a lambda.

    All sections of an article go through it one after the other, as rows; the
    number of the section keeps their order.
    """
    numbered = in_sections.withColumn("_article", F.monotonically_increasing_id())
    each = numbered.select("*", F.posexplode_outer("_sections").alias("_no", "_section"))
    cut = each.withColumn(
        "_cut", token_windows(F.coalesce("_section", F.lit("")), max_tokens, tokens)
    )
    # One shuffle by article; a group is one article's sections.
    whole = [c for c in in_sections.columns if c != "_sections"]
    together = cut.groupBy("_article").agg(
        *(F.first(c).alias(c) for c in whole),
        F.array_sort(F.collect_list(F.struct("_no", "_cut"))).alias("_parts"),
    )
    return together, F.flatten(F.col("_parts._cut"))


KEEP: dict[str, Callable[[Column], Column]] = {
    "all": lambda windows: windows,
    "distinct": F.array_distinct,
    "last": lambda windows: F.slice(windows, F.greatest(F.size(windows), F.lit(1)), 1),
}


def chunk(
    refined: DataFrame,
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    max_tokens: int = MAX_TOKENS,
    keep: str = "all",
    tokens: Tokens = Tokens(),
) -> DataFrame:
    """Refined articles to chunks: sections first, then token windows of each.

    Blank chunks are dropped here, before anything is embedded. ``pos`` numbers
    the kept windows of an article in text order. ``keep`` "distinct" drops
    repeated windows of an article and "last" all but its last one, for stores
    that would overwrite the others. ``tokens`` plugs in a tokenizer.
    """
    in_sections = refined.withColumn("_sections", sections(F.col("full_text"), max_chars, overlap))
    if tokens.cut is words:
        windows = F.flatten(
            F.transform("_sections", lambda section: token_windows(section, max_tokens))
        )
    else:
        in_sections, windows = _plugged_windows(in_sections, max_tokens, tokens)
    kept = KEEP[keep](F.filter(windows, lambda window: window != ""))
    chunks = in_sections.select(
        "doc_id", F.col("full_text").alias("full_raw_text"), "metadata", kept.alias("_windows")
    )
    exploded = chunks.select(
        "doc_id", "full_raw_text", "metadata", F.posexplode_outer("_windows").alias("pos", "text")
    )
    return exploded.where(F.col("text").isNotNull()).select(
        "doc_id",
        content_id(F.col("text")).alias("chunk_id"),
        "pos",
        "full_raw_text",
        "text",
        "metadata",
    )
