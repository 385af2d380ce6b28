import json

import pytest
from pyspark.sql import functions as F

from tidewire.operators.chunk import chunk, refine
from tidewire.operators.dedup import first_wins
from tidewire.operators.embed import hashed_bag_model
from tidewire.operators.search import search_stored
from tidewire.sources.feeds import feed_rank, landed_articles, read_landing, valid
from tidewire.sources.store import VectorStore
from tidewire.streaming import ingest as stream

AS_OF = "2024-02-01 00:00:00"


def a(i, url=None, title=None):
    return json.dumps(
        {
            "source": {"name": "wire"},
            "title": title or f"headline {i}",
            "url": url or f"http://a/{i}",
            "description": f"story number {i} " * 20,
            "publishedAt": "2024-01-01T00:00:00Z",
        }
    )


def b(i, link=None):
    return json.dumps(
        {
            "article_id": f"b{i}",
            "title": f"item {i}",
            "link": link or f"http://b/{i}",
            "description": None,
            "pubDate": "2024-01-01 00:00:00",
        }
    )


class Landing:
    def __init__(self, root):
        self.root = root
        self.files = 0

    def add(self, feed, *lines):
        folder = self.root / f"feed={feed}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{self.files:04d}.json").write_text("\n".join(lines) + "\n")
        self.files += 1


@pytest.fixture
def setting(spark, tmp_path):
    landing = Landing(tmp_path / "landing")
    store = VectorStore(spark, str(tmp_path / "store"), url_buckets=4)
    checkpoint = str(tmp_path / "offsets")

    def run(max_files=2, **options):
        job = stream.Ingest(store, AS_OF, max_tokens=30, embed_tasks=2, **options)
        landed = stream.stream_landing(spark, str(landing.root), max_files)
        query = stream.ingest_stream(landed, job, checkpoint, until_caught_up=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
        return query

    return landing, store, run


def rows(store):
    shown = store.current().select("doc_id", "chunk_id", "text", "metadata.url", "metadata.title")
    return sorted(map(tuple, shown.collect()))


def test_stream_equals_batch_and_survives_redelivery(spark, setting):
    landing, store, run = setting
    for i in range(6):
        landing.add("a", a(i), a(i + 100))
        landing.add("b", b(i), "{cut")
    run()
    streamed = rows(store)

    landed = stream.with_arrival(read_landing(spark, str(landing.root)))
    articles = valid(landed_articles(landed, AS_OF, keep=("_file",)))
    unique = first_wins(articles, "url", [feed_rank(F.col("feed")), F.col("_file")])
    batch = chunk(refine(unique), max_tokens=30)
    shown = batch.select("doc_id", "chunk_id", "text", "metadata.url", "metadata.title").distinct()
    assert streamed == sorted(map(tuple, shown.collect()))
    assert len({r[0] for r in streamed}) == 18

    bad = spark.read.parquet(f"{store.root}/quarantine")
    assert bad.count() == 6 and {r.reason for r in bad.collect()} == {"malformed"}

    # everything again, and one new article
    for i in range(6):
        landing.add("a", a(i, title="changed"), a(i + 100))
    landing.add("a", a(999))
    run()
    assert [r for r in rows(store) if "http://a/999" not in r] == streamed
    assert any("http://a/999" in r for r in rows(store))


def test_restart_without_new_files_adds_nothing(setting):
    landing, store, run = setting
    landing.add("a", a(1))
    run()
    before = rows(store), store.points().count()
    run()
    assert (rows(store), store.points().count()) == before


def test_duplicates_within_a_batch(setting):
    landing, store, run = setting
    landing.add("b", b(1, "http://same"), b(2, "http://own"))
    landing.add("a", a(1, "http://same"), a(2, "http://same"), a(3, "<b></b>"), a(4, " "))
    run(max_files=10)
    titles = {r[3]: r[4] for r in rows(store)}
    # feed a before feed b, earlier line before later; both articles without URL are one
    assert titles == {"http://same": "headline 1", "http://own": "item 2", "N/A": "headline 3"}


def test_a_batch_that_fails_after_writing_is_repeated_safely(setting, monkeypatch):
    landing, store, run = setting
    for i in range(6):
        landing.add("a", a(i), a(i, title="again"))
    original = stream.Ingest.store_batch

    def fails_once(self, checked, batch_id, writer):
        original(self, checked, batch_id, writer)
        if batch_id == 1:
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(stream.Ingest, "store_batch", fails_once)
    with pytest.raises(Exception, match="lost after the write"):
        run()
    monkeypatch.setattr(stream.Ingest, "store_batch", original)
    run()
    assert len({r[3] for r in rows(store)}) == 6
    versions = store.points().groupBy("doc_id", "chunk_id").agg(F.count_distinct("batch_id"))
    assert {r[2] for r in versions.collect()} == {1}


def test_a_new_checkpoint_overwrites_nothing(spark, setting, tmp_path):
    """Its batches count from 0 again; what is stored is skipped, the rest is added."""
    landing, store, run = setting
    landing.add("a", *[a(i) for i in range(5)])
    run()
    other = Landing(tmp_path / "other")
    other.add("a", *[a(i) for i in range(3, 8)])
    job = stream.Ingest(store, AS_OF, max_tokens=30, embed_tasks=2)
    landed = stream.stream_landing(spark, str(other.root))
    again = stream.ingest_stream(landed, job, str(tmp_path / "second"), until_caught_up=True)
    again.start().awaitTermination()
    urls = {r.metadata.url for r in store.current().collect()}
    assert urls == {f"http://a/{i}" for i in range(8)}
    assert store.keys().count() == 8


def test_selection_and_model_are_pluggable(setting):
    landing, store, run = setting
    landing.add("a", *[a(i) for i in range(10)])
    run(
        model=hashed_bag_model(8),
        select=lambda articles: articles.where(F.col("title").endswith("3")),
    )
    stored = store.current().collect()
    assert {r.metadata.title for r in stored} == {"headline 3"}
    assert {len(r.embedding) for r in stored} == {8}


def test_counts_are_logged(setting, caplog):
    landing, _, run = setting
    landing.add("a", a(1), a(2))
    landing.add("b", b(1), "{cut")
    with caplog.at_level("INFO", logger=stream.__name__):
        run(max_files=10)
    assert "'fetched_a': 2, 'rejected_a': 0, 'fetched_b': 2, 'rejected_b': 1" in caplog.text


def test_document_granularity_stores_the_last_window(spark, tmp_path):
    landing = Landing(tmp_path / "landing")
    landing.add("a", a(1), a(2))
    landed = stream.with_arrival(read_landing(spark, str(landing.root)))
    by_chunk = VectorStore(spark, str(tmp_path / "chunks"))
    by_document = VectorStore(spark, str(tmp_path / "documents"), granularity="document")
    for store in (by_chunk, by_document):
        stream.Ingest(store, AS_OF, max_tokens=20, embed_tasks=0).run(landed, 0)
    last = by_chunk.current().groupBy("doc_id").agg(F.max_by("text", "pos").alias("text"))
    kept = by_document.current().select("doc_id", "text")
    assert sorted(kept.collect()) == sorted(last.collect())
    assert by_chunk.current().count() > by_document.current().count() == 2


def test_ingested_articles_are_found(spark, setting):
    landing, store, run = setting
    landing.add("a", *[a(i) for i in range(12)])
    run()
    asked = spark.createDataFrame([(1, "Headline 3, story NUMBER 3!"), (2, "?!")], "q int, text string")
    hits = search_stored(store.current(), asked, 5, question="q").orderBy("rank").collect()
    assert [r.q for r in hits] == [1] * 5  # nothing is asked by the second question
    assert (hits[0].title, hits[0].url) == ("headline 3", "http://a/3")
    assert len({r.url for r in hits}) == 5  # chunks are collapsed to articles
    assert hits[0].score_percent == f"{100 * hits[0].score:.2f}%"
    part = store.current().where(F.col("metadata.url") == "http://a/5")
    assert [r.title for r in search_stored(part, asked, question="q").collect()] == ["headline 5"]
