import pytest
from pyspark.sql import functions as F

from tidewire.sources.store import VectorStore

SCHEMA = (
    "doc_id string, chunk_id string, pos int, text string, embedding array<float>, metadata "
    "struct<title:string,url:string,published_at:string,source_name:string,image_url:string>"
)


def points(spark, *rows):
    return spark.createDataFrame(
        [(d, c, p, f"text {c}", [1.0, 0.0], (t, u, "", "", "")) for d, c, p, t, u in rows], SCHEMA
    )


def urls(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "url string")


def test_an_unwritten_store_is_empty(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    assert store.current().count() == 0
    assert store.only_new(urls(spark, "a"), 0).count() == 1
    assert [r.stored for r in store.exists(urls(spark, "a")).collect()] == [False]


def test_upsert_keeps_the_latest_version(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d1", "c1", 0, "old", "u1"), ("d1", "c2", 1, "old", "u1")), 0)
    store.write(points(spark, ("d1", "c1", 0, "new", "u1"), ("d2", "c3", 0, "new", "u2")), 1)
    rows = store.current().select("doc_id", "chunk_id", "metadata.title").collect()
    assert sorted(map(tuple, rows)) == [("d1", "c1", "new"), ("d2", "c3", "new")]
    assert store.points().count() == 4


def test_document_granularity_keeps_the_last_chunk(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), granularity="document")
    store.write(points(spark, *[("d1", f"c{i}", i, "t", "u1") for i in range(3)]), 0)
    assert [r.chunk_id for r in store.current().collect()] == ["c2"]
    with pytest.raises(ValueError):
        VectorStore(spark, str(tmp_path / "s"), granularity="page")


def test_a_batch_sees_only_earlier_batches(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d1", "c1", 0, "t", "u1")), 0)
    store.write(points(spark, ("d2", "c2", 0, "t", "u2")), 1)
    asked = urls(spark, "u1", "u2", "u3")
    assert sorted(r.url for r in store.only_new(asked, 1).collect()) == ["u2", "u3"]
    assert sorted(r.url for r in store.only_new(asked, 2).collect()) == ["u3"]
    flags = sorted((r.url, r.stored) for r in store.exists(asked).collect())
    assert flags == [("u1", True), ("u2", True), ("u3", False)]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d0", "c0", 0, "t", "u0")), 0)
    for _ in range(2):
        store.write(points(spark, ("d1", "c1", 0, "t", "u1"), ("d2", "c2", 0, "t", "u2")), 1)
    assert store.points().count() == 3
    assert store.keys().count() == 3


def test_keys_are_read_from_the_asked_buckets_only(spark, tmp_path, plan_of):
    store = VectorStore(spark, str(tmp_path / "s"), url_buckets=32)
    store.write(points(spark, *[(f"d{i}", f"c{i}", 0, "t", f"u{i}") for i in range(200)]), 0)
    plan = plan_of(store.only_new(urls(spark, "u1", "u2"), 1))
    scan = plan[plan.index("PartitionFilters") :].splitlines()[0]
    assert "url_bucket" in scan and "batch_id" in scan
    assert "embedding" not in plan


def test_rewrite_makes_one_batch(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    for batch in range(3):
        store.write(points(spark, ("d", "c", 0, f"t{batch}", "u"), (f"d{batch}", "c", 0, "t", f"u{batch}")), batch)
    fresh = store.rewrite(str(tmp_path / "fresh"), 2)
    assert fresh.points().count() == 4
    assert {r.batch_id for r in fresh.points().select("batch_id").collect()} == {2}
    same = ["doc_id", "chunk_id", F.col("metadata.title")]
    assert sorted(fresh.current().select(*same).collect()) == sorted(
        store.current().select(*same).collect()
    )
    assert sorted(r.url for r in fresh.keys().collect()) == ["u", "u0", "u1", "u2"]


def test_only_articles_with_versions_are_shuffled(spark, tmp_path, plan_of):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, *[(f"d{i}", "c", 0, "t", f"u{i}") for i in range(5)]), 0)
    store.write(points(spark, ("d9", "c", 0, "t", "u9"), ("d9", "c2", 1, "t", "u9")), 1)
    plain = plan_of(store.current())
    assert "Exchange" not in plain and "Window" not in plain
    # the same article under another URL, and a point repeated within its batch
    store.write(points(spark, ("d1", "c", 0, "new", "other"), *[("d8", "c", p, f"p{p}", "u8") for p in (0, 1)]), 2)
    assert "Window" in plan_of(store.current())
    titles = {(r.doc_id, r.chunk_id): r.metadata.title for r in store.current().collect()}
    assert len(titles) == store.current().count() == 8
    assert (titles["d1", "c"], titles["d8", "c"], titles["d0", "c"]) == ("new", "p1", "t")


def test_an_article_under_a_new_link_has_one_version(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d1", "old1", 0, "t", "u1"), ("d1", "old2", 1, "t", "u1")), 0)
    store.write(points(spark, ("d1", "new", 0, "t", "u2")), 1)
    assert [r.chunk_id for r in store.current().collect()] == ["new"]


def test_another_writer_overwrites_nothing(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    rows = [(f"d{i}", f"c{i}", 0, "t", f"u{i}") for i in range(8)]
    store.write(points(spark, *rows[:5]), 0, "one")
    asked = points(spark, *rows[3:]).withColumn("url", F.col("metadata.url"))
    for _ in range(2):  # the second time as a retry
        fresh = store.only_new(asked, 0, writer="two").drop("url")
        store.write(fresh, 0, "two")
    assert sorted(r.doc_id for r in store.current().collect()) == [f"d{i}" for i in range(8)]
    assert store.points().count() == 8 and store.keys().count() == 8


def test_a_vector_of_another_size_is_refused(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d1", "c1", 0, "t", "u1")), 0)
    longer = points(spark, ("d2", "c2", 0, "t", "u2")).withColumn(
        "embedding", F.array(*[F.lit(0.5).cast("float")] * 3)
    )
    with pytest.raises(Exception, match="size 3 in a store of size 2"):
        store.write(longer, 1)
    declared = VectorStore(spark, str(tmp_path / "t"), dimensions=3)
    declared.write(longer, 0)
    with pytest.raises(Exception, match="size 2 in a store of size 3"):
        declared.write(points(spark, ("d1", "c1", 0, "t", "u1")), 1)


def test_an_empty_batch_stores_nothing(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"))
    store.write(points(spark, ("d1", "c1", 0, "t", "u1")).limit(0), 0)
    assert store.current().count() == 0
    store.write(points(spark, ("d1", "c1", 0, "t", "u1")), 1)
    assert store.current().count() == 1


def test_a_hot_key_is_split(spark):
    """Three quarters of the rows ask for one URL."""
    from tidewire.operators.dedup import exists_in

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        hot = F.when(F.col("id") % 4 != 0, F.lit("N/A")).otherwise(F.col("id").cast("string"))
        rows = spark.range(0, 40_000, 1, 8).select(hot.alias("url"), F.expr("uuid()").alias("pad"))
        keys = spark.range(1000).select(F.col("id").cast("string").alias("url"))
        found = exists_in(rows, keys)
        found.write.format("noop").mode("overwrite").save()
        flags = {r.stored: r["count"] for r in found.groupBy("stored").count().collect()}
        assert flags == {True: 250, False: 39_750}
        done = found._jdf.queryExecution().executedPlan()
        found.collect()
        assert "skew=true" in done.toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
