"""Selection, ranking, deduplication and membership."""

from pyspark.sql import functions as F

from tidewire.operators.dedup import exists_in, first_wins, only_new
from tidewire.operators.ranking import top_n
from tidewire.operators.select import latest_per_feed, on_topic, recent


def test_top_n_of_a_hot_group_beyond_the_map_side_limit(spark):
    # one group holds most rows, and n is above what the optimizer limits early
    rows = spark.range(20000).select(
        F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id") % 3).alias("g"), "id"
    )
    kept = top_n(rows, ["g"], [F.col("id").desc()], 1500).collect()
    expected = {}
    for row in sorted(rows.collect(), key=lambda r: -r.id):
        expected.setdefault(row.g, []).append(row.id)
    got = {}
    for row in sorted(kept, key=lambda r: r["rank"]):
        got.setdefault(row.g, []).append(row.id)
    assert got == {g: ids[:1500] for g, ids in expected.items()}


def test_first_wins_is_idempotent(spark):
    rows = spark.createDataFrame(
        [("u", 2, "b"), ("u", 1, "a"), ("N/A", 4, "d"), ("N/A", 3, "c"), ("v", 5, "e")],
        "url string, pos int, x string",
    )
    once = first_wins(rows, "url", [F.col("pos")])
    assert sorted(r.x for r in once.collect()) == ["a", "c", "e"]
    assert sorted(first_wins(once, "url", [F.col("pos")]).collect()) == sorted(once.collect())


def test_membership(spark):
    rows = spark.createDataFrame([("u",), ("v",), ("v",)], "url string")
    stored = spark.createDataFrame([("v",), ("v",), ("w",)], "url string")
    assert [r.url for r in only_new(rows, stored).collect()] == ["u"]
    flags = sorted((r.url, r.stored) for r in exists_in(rows, stored).collect())
    assert flags == [("u", False), ("v", True), ("v", True)]


def test_latest_topic_and_recency(spark):
    rows = spark.createDataFrame(
        [("a", f"k{i}", "en" if i % 2 else "fr", f"word{i} cats", f"2024-01-0{i + 1} 00:00:00")
         for i in range(9)],
        "feed string, article_id string, lang string, title string, at string",
    ).withColumn("published_ts", F.col("at").cast("timestamp_ntz"))
    newest = latest_per_feed(rows, 2).orderBy("rank").collect()
    assert [r.article_id for r in newest] == ["k8", "k7"]
    assert [r.article_id for r in on_topic(rows, "CATS word3", "title").collect()] == ["k3"]
    assert recent(rows, "2024-01-03 00:00:00", 24).count() == 2
