"""Queries without SQL: search over stored vectors, and recall by cells."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidewire.operators import search
from tidewire.operators.chunk import Tokens, chunk
from tidewire.operators.select import on_topic
from tidewire.plans.inputs import AS_OF, landed_lines
from tidewire.plans.queries import _ingested
from tidewire.sources.feeds import read_landing
from tidewire.sources.store import VectorStore
from tidewire.streaming.ingest import Ingest, with_arrival


@pytest.fixture(scope="module")
def queries():
    return registry.queries()


def fresh_search(spark, tables, points):
    """The same hits by embedding the stored texts anew."""
    rows = points.select("doc_id", "chunk_id", "metadata", "text")
    hits = search.search_text(
        rows, spark.read.parquet(f"{tables}/benchmark.parquet"), text="text",
        ties=("doc_id", "chunk_id"), question="item_id", group="doc_id",
    )
    return search.as_hits(hits, "item_id")


def by_rank(hits):
    return {(r.item_id, r["rank"]): r for r in hits.collect()}


@pytest.mark.parametrize("name, source", [("search_stored", None), ("search_stored_filtered", "src3")])
def test_stored_vectors_give_the_hits_of_fresh_ones(spark, tables, queries, name, source):
    found = by_rank(queries[name](spark, tables))
    points = _ingested(spark, tables).current()
    if source:
        points = points.where(F.col("metadata.source_name") == source)
    expected = by_rank(fresh_search(spark, tables, points))
    assert found.keys() == expected.keys() and len(found) >= 300
    close = [abs(found[k].score - expected[k].score) < 2e-6 for k in found]
    assert all(close)
    same = sum(found[k].url == expected[k].url for k in found)
    assert same > 0.97 * len(found)  # others are ties in exact numbers


def test_the_store_is_read_not_embedded_again(spark, tables, queries, plan_of):
    plan = plan_of(queries["search_stored_filtered"](spark, tables))
    assert "EqualTo(metadata.source_name,src3)" in plan
    assert plan.count("MapInArrow") >= 1 and "ArrowEvalPython" not in plan
    assert "text:string" not in plan


@pytest.mark.parametrize("name, nodes", [("embed_dense", 1), ("knn_lsh", 0)])
def test_models_run_once(spark, tables, queries, plan_of, name, nodes):
    plan = plan_of(queries[name](spark, tables))
    assert plan.count("\n* ArrowEvalPython") + plan.count("\nArrowEvalPython") <= nodes


def test_recall_by_cells(spark, tables, queries):
    row = queries["knn_lsh_recall"](spark, tables).first()
    assert row.share_of_pairs <= 0.95 and row.recall >= 0.9


def test_topic_and_language_select_in_ingest(spark, tables, tmp_path):
    landing = str(tmp_path / "landing")
    lines = landed_lines(spark, tables, damage=False).select("feed", "value")
    lines.write.partitionBy("feed").text(landing)
    landed = with_arrival(read_landing(spark, landing))
    store = VectorStore(spark, str(tmp_path / "store"))
    select = lambda a: on_topic(a, "the", "title", "description", language=None)
    Ingest(store, AS_OF, select=select).run(landed, 0)
    stored = store.current().select("doc_id").distinct().count()
    assert 0 < stored < lines.count()
    none = VectorStore(spark, str(tmp_path / "none"))
    select = lambda a: on_topic(a, "the", "title", language_column="language")
    Ingest(none, AS_OF, select=select).run(landed, 0)
    assert none.current().count() == 0  # the records name no language


def test_language_comes_with_the_record(spark, tmp_path):
    record = (
        '{"article_id": "%s", "title": "storm", "link": "http://x/%s", "description": "d",'
        ' "pubDate": "2024-01-01", "language": "%s"}'
    )
    rows = [("b", record % (i, i, lang)) for i, lang in (("1", "en"), ("2", "fr"))]
    spark.createDataFrame(rows, "feed string, value string").write.partitionBy("feed").text(
        str(tmp_path / "landing")
    )
    store = VectorStore(spark, str(tmp_path / "store"))
    select = lambda a: on_topic(a, "storm", "title", language_column="language")
    landed = with_arrival(read_landing(spark, str(tmp_path / "landing")))
    Ingest(store, AS_OF, select=select).run(landed, 0)
    assert [r.doc_id for r in store.current().collect()] == ["1"]


def test_a_tokenizer_plugs_into_chunks(spark):
    @F.pandas_udf("array<string>")
    def letters(texts):
        return texts.map(list)

    meta = "struct<title:string,url:string,published_at:string,source_name:string,image_url:string>"
    rows = spark.createDataFrame(
        [("a", "abcdefg", None), ("b", "", None), ("c", "xy " * 3000, None)],
        f"doc_id string, full_text string, metadata {meta}",
    )
    chunks = chunk(rows, max_tokens=3, tokens=Tokens(letters, ""))
    found = [(r.doc_id, r.pos, r.text) for r in chunks.orderBy("doc_id", "pos").collect()]
    assert found[:3] == [("a", 0, "abc"), ("a", 1, "def"), ("a", 2, "g")]
    assert {d for d, _, _ in found} == {"a", "c"}
    assert all(len(t) <= 3 for _, _, t in found)


def test_counts_of_a_batch(spark, tables, tmp_path):
    landing = str(tmp_path / "landing")
    lines = landed_lines(spark, tables).select("feed", "value")
    lines.unionByName(lines).write.partitionBy("feed").text(landing)
    landed = with_arrival(read_landing(spark, landing))
    seen = []

    class Counting(Ingest):
        def counted(self, writer, batch_id, found):
            seen.append((writer, batch_id, found))

    job = Counting(VectorStore(spark, str(tmp_path / "store")), AS_OF)
    job.run(landed, 0)
    job.run(landed, 1)
    first, second = seen[0][2], seen[1][2]
    assert first["fetched_a"] + first["fetched_b"] == 2 * lines.count()
    good = lines.count() - (first["rejected_a"] + first["rejected_b"]) // 2
    assert (first["unique"], first["new"], first["skipped"]) == (good, good, 0)
    assert (second["unique"], second["new"], second["skipped"]) == (good, 0, good)
