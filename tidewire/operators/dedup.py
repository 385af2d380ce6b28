"""First-wins deduplication and lookups against what is already stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.ranking import top_n


def first_wins(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key.

    A key shared by a third of all rows costs one row per map task, because
    the limit of one is applied before the shuffle.
    """
    return top_n(rows, [key], order, 1, rank="_first").drop("_first")


def only_new(rows: DataFrame, stored_keys: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not stored yet."""
    return rows.join(stored_keys.select(key), key, "left_anti")


def exists_in(
    rows: DataFrame, stored_keys: DataFrame, key: str = "url", flag: str = "stored"
) -> DataFrame:
    """``rows`` with a flag telling whether the key is stored.

    A union of a semi and an anti join: both sides of either are plain
    shuffles, so a key that much of ``rows`` shares is split at runtime.
    """
    keys = stored_keys.select(key)
    there = rows.join(keys, key, "left_semi").withColumn(flag, F.lit(True))
    return there.unionByName(rows.join(keys, key, "left_anti").withColumn(flag, F.lit(False)))
