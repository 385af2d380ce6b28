"""Identifiers that are the same on every replay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """md5 of the text, as hex."""
    return F.md5(text)


def uuid_shaped(text: Column) -> Column:
    """md5 of the text written in 8-4-4-4-12 groups."""
    digest = F.md5(text)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])
