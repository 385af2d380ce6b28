"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.plans.session import shared_folder

def texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), and nothing else unless asked for."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """Write ``rows`` to the shared folder and read them back.

    This cuts the lineage: a lost executor costs a read of these files. Codec
    zstd, as the folder counts as disk.
    """
    spark = rows.sparkSession
    path = shared_folder(spark, purpose)
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work: Callable) -> Callable:
    """A batch function, or one of a group, that gives its memory back at its end."""
    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from work(batches)
            finally:
                give_back()

        return stream

    # Spark counts the arguments of a group's function, so each number has its own.
    if len(inspect.signature(work).parameters) == 2:

        def pair(left, right):
            try:
                return work(left, right)
            finally:
                give_back()

        return pair

    def single(table):
        try:
            return work(table)
        finally:
            give_back()

    return single


def parts(rows: DataFrame) -> int:
    """The number of shuffle partitions of the session."""
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """``columns`` of ``rows`` with another ``text``; ``n_chars``, if there, counts it."""
    changed = rows.select(*(text.alias(c) if c == "text" else F.col(f"`{c}`") for c in columns))
    if "n_chars" not in columns:
        return changed
    return changed.withColumn("n_chars", F.char_length("text").cast("long"))
