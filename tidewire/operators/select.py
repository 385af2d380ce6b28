"""Which articles of a feed are taken: recency, topic, batch size."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import within_hours
from tidewire.functions.text import mentions_all
from tidewire.operators.ranking import top_n


def recent(
    articles: DataFrame, as_of: datetime | str, hours: int = 24, stamp: str = "published_ts"
) -> DataFrame:
    """Articles of the last ``hours`` hours; the range reaches the file scan."""
    return articles.where(within_hours(F.col(stamp), as_of, hours))


def on_topic(
    articles: DataFrame,
    topic: str,
    *text: str,
    language: str | None = "en",
    language_column: str = "lang",
) -> DataFrame:
    """Articles in ``language`` that mention every word of ``topic``.

    Common articles carry their language in ``language``, null where the feed
    says none. With ``language=None`` any language will do.
    """
    found = mentions_all(topic, *[F.col(name) for name in text])
    if language is not None:
        found = (F.col(language_column) == language) & found  # the cheap test first
    return articles.where(found)


def latest_per_feed(
    articles: DataFrame,
    n: int = 5,
    feed: str = "feed",
    stamp: str = "published_ts",
    key: str = "article_id",
) -> DataFrame:
    """At most ``n`` articles per feed, newest first."""
    return top_n(articles, [feed], [F.col(stamp).desc(), F.col(key).asc()], n)
