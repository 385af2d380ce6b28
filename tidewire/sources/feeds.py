"""The two article feeds: reading, validation and mapping to one schema.

A feed arrives as JSON lines under ``<landing>/feed=<name>/``. The raw line is
kept until it is validated, so a bad record is quarantined with its text
instead of spoiling its batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.dates import format_timestamp, published_timestamp
from tidewire.functions.ids import uuid_shaped
from tidewire.functions.text import clean_text_or_na, clean_url_or_na
from tidewire.operators.partitioning import computed_once
from tidewire.sources.schemas import CORRUPT, FEED_A, FEED_B

UNKNOWN_SOURCE = "Unknown"


@dataclass(frozen=True)
class Feed:
    """A feed's name, its place in the first-wins order, and its record type."""

    name: str
    rank: int
    schema: T.StructType
    required: tuple[str, ...]
    # Keys that must be present although their value may be null.
    required_keys: tuple[str, ...] = ()


FEED_A_SPEC = Feed("a", 0, FEED_A, ("source.name", "title", "url", "publishedAt"))
FEED_B_SPEC = Feed(
    "b", 1, FEED_B, ("article_id", "title", "link", "pubDate"), required_keys=("description",)
)
FEEDS = (FEED_A_SPEC, FEED_B_SPEC)


def read_landing(spark: SparkSession, landing: str) -> DataFrame:
    """All landed records as ``value`` (JSON text) and ``feed``."""
    return spark.read.schema("value string, feed string").format("text").load(landing)


def parse_records(raw: DataFrame, feed: Feed, value: str = "value") -> DataFrame:
    """Parse one feed's JSON and name the first reason for rejecting a record.

    Adds ``record`` (struct) and ``reason`` (null when valid) to ``raw``.
    """
    schema = T.StructType(feed.schema.fields + [T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = computed_once(raw, "record", F.from_json(value, schema, options))
    return parsed.withColumn("reason", _reject_reason(feed, F.col(value)))


def _reject_reason(feed: Feed, raw: Column) -> Column:
    # A line that is no JSON object at all parses to null or to null fields.
    reason = F.when(
        F.col("record").isNull() | F.col(f"record.{CORRUPT}").isNotNull(), F.lit("malformed")
    )
    for name in feed.required:
        reason = reason.when(F.col(f"record.{name}").isNull(), F.lit(f"missing {name}"))
    for name in feed.required_keys:
        # The key list is only read for records whose value is null.
        absent = ~F.coalesce(F.array_contains(F.json_object_keys(raw), name), F.lit(False))
        reason = reason.when(
            F.col(f"record.{name}").isNull() & absent, F.lit(f"missing {name}")
        )
    return reason


def common_from_a(
    articles: DataFrame, as_of: datetime | str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Feed A records to the common article schema; ids come from the cleaned URL."""
    url = clean_url_or_na(F.col("url"))
    return _common(
        articles,
        keep,
        as_of,
        article_id=uuid_shaped(url),
        title=F.col("title"),
        url=url,
        published=F.col("publishedAt"),
        source_name=F.col("source.name"),
        image_url=F.col("urlToImage"),
    )


def common_from_b(
    articles: DataFrame, as_of: datetime | str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Feed B records to the common article schema; ids come with the record."""
    return _common(
        articles,
        keep,
        as_of,
        article_id=F.col("article_id"),
        title=F.col("title"),
        url=clean_url_or_na(F.col("link")),
        published=F.col("pubDate"),
        source_name=F.coalesce(F.nullif(F.col("source_id"), F.lit("")), F.lit(UNKNOWN_SOURCE)),
        image_url=F.col("image_url"),
    )


def _common(
    articles: DataFrame,
    keep: tuple[str, ...],
    as_of: datetime | str,
    *,
    article_id: Column,
    title: Column,
    url: Column,
    published: Column,
    source_name: Column,
    image_url: Column,
) -> DataFrame:
    stamped = articles.select(
        *keep,
        article_id.alias("article_id"),
        clean_text_or_na(title).alias("title"),
        url.alias("url"),
        published_timestamp(published, as_of).alias("published_ts"),
        source_name.alias("source_name"),
        clean_url_or_na(image_url).alias("image_url"),
        clean_text_or_na(F.col("description")).alias("description"),
        clean_text_or_na(F.col("content")).alias("content"),
        (F.col("language") if "language" in articles.columns else F.lit(None).cast("string")).alias(
            "language"
        ),
    )
    return stamped.withColumn("published_at", format_timestamp(F.col("published_ts")))


def landed_articles(
    raw: DataFrame, as_of: datetime | str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Landed records of both feeds as common articles, each checked.

    ``reason`` is null for a valid article. A rejected record has its reason,
    its text in ``raw`` and nothing to rely on in the other columns; split with
    ``valid`` and ``rejected``. Each branch filters on the ``feed`` directory,
    so it reads only its files.
    """
    carried = ("feed", "reason", "raw", *keep)
    branches = []
    for feed, to_common in ((FEED_A_SPEC, common_from_a), (FEED_B_SPEC, common_from_b)):
        parsed = parse_records(raw.where(F.col("feed") == feed.name), feed)
        text = F.when(F.col("reason").isNotNull(), F.col("value")).alias("raw")
        record = parsed.select("feed", "reason", *keep, text, "record.*")
        branches.append(to_common(record, as_of, keep=carried))
    return branches[0].unionByName(branches[1])


def valid(checked: DataFrame) -> DataFrame:
    """Articles that passed."""
    return checked.where(F.col("reason").isNull()).drop("reason", "raw")


def rejected(checked: DataFrame, *keep: str) -> DataFrame:
    """The quarantine view: which feed, why, and the record as it came."""
    return checked.where(F.col("reason").isNotNull()).select("feed", "reason", "raw", *keep)


def feed_rank(feed: Column) -> Column:
    """Position of a feed in the first-wins order."""
    rank = F.when(feed == FEEDS[0].name, F.lit(FEEDS[0].rank))
    for other in FEEDS[1:]:
        rank = rank.when(feed == other.name, F.lit(other.rank))
    return rank
