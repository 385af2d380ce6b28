"""Ingest counts per feed and over all feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ingest_counts(records: DataFrame, url: str = "url", reason: str = "reason") -> DataFrame:
    """Fetched, rejected, unique and duplicate records per feed, plus "all".

    ``records`` has one row per fetched record with ``feed``, the cleaned URL
    (null when rejected) and the reject reason. The distinct count is planned
    as a group-by on (feed, url) first, so no single task holds a feed.
    """
    counted = records.rollup("feed").agg(
        F.count(F.lit(1)).alias("fetched"),
        F.count(reason).alias("rejected"),
        F.count_distinct(url).alias("unique_urls"),
        F.grouping("feed").alias("_all"),
    )
    return counted.select(
        F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("feed")).alias("feed"),
        "fetched",
        "rejected",
        "unique_urls",
        (F.col("fetched") - F.col("rejected") - F.col("unique_urls")).alias("duplicates"),
    )
