"""Plan shapes that matter at scale."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from tidewire.operators.dedup import first_wins
from tidewire.operators.embed import embed_sparse
from tidewire.operators.search import Vectors, nearest
from tidewire.operators.select import recent
from tidewire.plans.inputs import AS_OF, landed_lines
from tidewire.sources.feeds import read_landing
from tidewire.sources.store import VectorStore
from tidewire.streaming.ingest import Ingest, with_arrival


@pytest.fixture(scope="module")
def queries():
    return registry.queries()


def test_recency_reaches_the_scan(spark, tables, plan_of):
    events = spark.read.parquet(f"{tables}/events.parquet")
    plan = plan_of(recent(events, "2024-01-15 12:00:00", stamp="ts").select("event_id"))
    assert "GreaterThanOrEqual(ts,2024-01-14T12:00)" in plan
    assert "LessThanOrEqual(ts,2024-01-15T12:00)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


@pytest.mark.parametrize(
    "name", ["html_strip", "clean_full", "parse_published", "chunk_tokens", "embed_sparse"]
)
def test_scalar_work_stays_in_the_jvm(spark, tables, plan_of, queries, name):
    plan = plan_of(queries[name](spark, tables))
    assert "Python" not in plan and "Arrow" not in plan
    # at most the spreading of a small input; never a shuffle by key
    assert "hashpartitioning" not in plan


@pytest.mark.parametrize("name", ["latest_per_feed", "dedup_first", "feed_union"])
def test_groups_are_limited_before_the_shuffle(spark, tables, plan_of, queries, name):
    plan = plan_of(queries[name](spark, tables))
    assert "WindowGroupLimit" in plan


def test_first_wins_shuffles_once(spark, plan_of):
    rows = spark.range(10).select(F.col("id").cast("string").alias("url"), "id")
    assert plan_of(first_wins(rows, "url", [F.col("id")])).count("Arguments: hashpartitioning") == 1


@pytest.mark.parametrize(
    "name", ["search_text", "search_articles", "search_filtered", "knn_topk", "search_hits"]
)
def test_search_forms_no_pairs(spark, tables, plan_of, queries, name):
    plan = plan_of(queries[name](spark, tables))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "Join" not in plan
    assert plan.count("MapInArrow") >= 1


def test_payload_filter_reaches_the_store_scan(spark, tables, plan_of, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    Ingest(store, AS_OF).run(with_arrival(_landed(spark, tables, tmp_path / "landing")), 0)
    part = store.points().where(F.col("metadata.source_name") == "src3")
    vectors = Vectors("embedding", 384)
    asked = store.points().limit(2).select("chunk_id", "embedding")
    asked = asked.withColumnRenamed("chunk_id", "asked")
    hits = nearest(part.select("doc_id", "chunk_id", "embedding"), asked, vectors, ties=("chunk_id",))
    plan = plan_of(hits)
    assert "EqualTo(metadata.source_name,src3)" in plan
    # of the payload only the filtered field is read
    assert "metadata:struct<source_name:string>" in plan and "text:string" not in plan
    assert hits.count() == 20


def _landed(spark, tables, folder):
    lines = landed_lines(spark, tables).select("feed", "value")
    lines.write.partitionBy("feed").text(str(folder))
    return read_landing(spark, str(folder))


def test_costly_columns_are_computed_once(spark, plan_of):
    rows = spark.createDataFrame([("a b",)], "text string")
    plan = plan_of(embed_sparse(rows.select(F.upper("text").alias("text"))))
    assert plan.count("md5") <= 2  # once in the listing, once in the node's arguments
