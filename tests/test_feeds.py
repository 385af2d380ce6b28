import json

import pytest

from tidewire.operators.counts import ingest_counts
from tidewire.sources.feeds import landed_articles, read_landing, rejected, valid
from tidewire.sources.schemas import COMMON

AS_OF = "2024-02-01 00:00:00"

A = {
    "source": {"id": None, "name": "Wire"},
    "title": "Hello, World",
    "description": None,
    "url": "http://a/1",
    "publishedAt": "2024-01-05T01:02:03Z",
}
B = {
    "article_id": "b-1",
    "title": "",
    "link": "<i>http://b/1</i>",
    "description": "Text.",
    "pubDate": "garbage",
    "source_id": "",
}


def without(record, *keys):
    return {k: v for k, v in record.items() if k not in keys}


def landed(spark, *records):
    lines = [(f, r if isinstance(r, str) else json.dumps(r)) for f, r in records]
    return spark.createDataFrame(lines, "feed string, value string")


def test_mapping_of_both_feeds(spark):
    checked = landed_articles(landed(spark, ("a", A), ("b", B)), AS_OF)
    a, b = valid(checked).orderBy("feed").collect()
    assert (a.title, a.description, a.content) == ("hello world", "N/A", "N/A")
    assert (a.url, a.image_url, a.source_name) == ("http://a/1", "N/A", "Wire")
    assert a.published_at == "2024-01-05 01:02:03"
    assert len(a.article_id) == 36 and a.article_id.count("-") == 4
    assert (b.article_id, b.title, b.url) == ("b-1", "N/A", "http://b/1")
    assert (b.source_name, b.published_at) == ("Unknown", AS_OF)
    assert set(COMMON.names) <= set(valid(checked).columns)
    for field in COMMON:
        assert valid(checked).schema[field.name].dataType == field.dataType


@pytest.mark.parametrize(
    "feed, record, reason",
    [
        ("a", without(A, "url"), "missing url"),
        ("a", {**A, "title": None}, "missing title"),
        ("a", {**A, "source": {"id": "x"}}, "missing source.name"),
        ("a", without(A, "source"), "missing source.name"),
        ("a", '{"title": "cut', "malformed"),
        ("a", "", "malformed"),
        ("a", "[1]", "malformed"),
        ("a", {**A, "source": "not an object"}, "malformed"),
        ("b", without(B, "description"), "missing description"),
        ("b", {**B, "description": None}, None),
        ("b", {**B, "creator": "not a list"}, "malformed"),
        ("b", {**B, "creator": ["x"], "extra": 1}, None),
        ("a", without(A, "description", "author"), None),
    ],
)
def test_rejects(spark, feed, record, reason):
    checked = landed_articles(landed(spark, (feed, record)), AS_OF)
    [row] = checked.collect()
    assert row.reason == reason
    if reason:
        [bad] = rejected(checked).collect()
        assert bad.raw == (record if isinstance(record, str) else json.dumps(record))


def test_one_bad_record_leaves_the_others(spark):
    lines = landed(spark, ("a", A), ("a", "{"), ("b", B))
    checked = landed_articles(lines, AS_OF)
    assert valid(checked).count() == 2
    assert rejected(checked).count() == 1


def test_read_landing_has_the_feed_from_the_folder(spark, tmp_path):
    landed(spark, ("a", A), ("b", B)).write.partitionBy("feed").text(str(tmp_path / "in"))
    rows = read_landing(spark, str(tmp_path / "in"))
    assert {r.feed for r in rows.collect()} == {"a", "b"}


def test_counts_over_feeds(spark):
    rows = spark.createDataFrame(
        [("a", "u1", None), ("a", "u1", None), ("a", None, "malformed"), ("b", "u1", None),
         ("b", "u2", None)],
        "feed string, url string, reason string",
    )
    counted = {r.feed: tuple(r)[1:] for r in ingest_counts(rows).collect()}
    assert counted == {"a": (3, 1, 1, 1), "b": (2, 0, 2, 0), "all": (5, 1, 2, 2)}
