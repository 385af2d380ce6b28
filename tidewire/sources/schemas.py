"""Row types at each stage, from feed JSON to stored vector."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(name, T.StringType()) for name in names]


# Column that receives the raw text of a record the JSON parser rejects.
CORRUPT = "_corrupt_record"

FEED_A = T.StructType(
    [T.StructField("source", T.StructType(_strings("id", "name")))]
    + _strings("author", "title", "description", "url", "urlToImage", "publishedAt", "content")
    # Optional; says which language an article is in, for topic selection.
    + _strings("language")
)

FEED_B = T.StructType(
    _strings(
        "article_id", "title", "link", "description", "pubDate",
        "source_id", "source_url", "source_icon",
    )
    + [T.StructField("creator", T.ArrayType(T.StringType()))]
    + _strings("image_url", "content", "language")
)

COMMON = T.StructType(
    _strings("article_id", "title", "url", "published_at")
    + [T.StructField("published_ts", T.TimestampNTZType())]
    + _strings("source_name", "image_url", "description", "content", "language")
)

METADATA_FIELDS = ("title", "url", "published_at", "source_name", "image_url")
