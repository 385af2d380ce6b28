"""State that a stream carries: newest per feed, totals by sketches, keys that expire."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators.counts import ingest_counts
from tidewire.operators.select import latest_per_feed
from tidewire.streaming.state import Generations, IngestTotals, LatestPerFeed, first_within

ARTICLES = "feed string, published_ts timestamp_ntz, article_id string"


def articles(spark, seed, count):
    """Most rows in one feed; null and equal stamps, null ids, repeated rows, a null feed."""
    draw = random.Random(seed)
    made = [
        (
            draw.choice(["hot"] * 6 + ["cold", None]),
            None if draw.random() < 0.1 else f"2024-01-{draw.randint(1, 28):02d} 0{draw.randint(0, 2)}:00:00",
            None if draw.random() < 0.05 else str(draw.randint(0, 60)),
        )
        for _ in range(count)
    ]
    strings = spark.createDataFrame(made, "feed string, published_ts string, article_id string")
    return strings.withColumn("published_ts", F.col("published_ts").cast("timestamp_ntz"))


def listed(rows):
    return sorted(map(repr, map(tuple, rows.select("feed", "rank", "published_ts", "article_id").collect())))


def test_newest_per_feed_after_every_batch(spark, tmp_path):
    newest = LatestPerFeed(spark, str(tmp_path / "newest"), n=4)
    assert newest.current() is None
    so_far = spark.createDataFrame([], ARTICLES)
    for batch_id, count in enumerate([30, 0, 50, 7]):
        batch = articles(spark, batch_id, count)
        so_far = so_far.unionByName(batch)
        newest.add(batch, batch_id)
        assert listed(newest.current()) == listed(latest_per_feed(so_far, 4))
        newest.add(batch, batch_id)  # a batch that runs again changes nothing
        assert listed(newest.current()) == listed(latest_per_feed(so_far, 4))
    assert Generations(spark, newest.root).numbers() == [2, 3]


def test_a_version_without_all_files_does_not_count(spark, tmp_path):
    state = Generations(spark, str(tmp_path / "state"))
    for number in (0, 1, 2):
        state.replace(number, spark.range(number + 1))
    assert state.numbers() == [1, 2]
    (tmp_path / "state" / "generation=2" / "_SUCCESS").unlink()
    assert state.latest().count() == 2
    assert state.before(2).count() == 2 and state.before(1) is None


def records(spark, first, count, feed):
    """URLs from ``first`` on; every tenth record is rejected."""
    reason = F.when(F.col("id") % 10 == 0, F.lit("malformed"))
    rows = spark.range(first, first + count)
    return rows.select(F.lit(feed).alias("feed"), reason.alias("reason"), F.concat(F.lit("u"), "id").alias("url"))


def test_totals_are_within_the_stated_error(spark, tmp_path):
    totals = IngestTotals(spark, str(tmp_path / "totals"))
    assert totals.totals() is None
    whole = None
    for batch_id in range(4):
        batch = records(spark, 6_000 * batch_id, 15_000, "a").unionByName(records(spark, 0, 50, "b"))
        whole = batch if whole is None else whole.unionByName(batch)
        totals.add(batch, batch_id)
        totals.add(batch, batch_id)  # run again
    # Another checkpoint of the same feeds, from batch 0 again.
    batch = records(spark, 20_000, 15_000, "a")
    totals.add(batch, 0, "other")
    whole = whole.unionByName(batch)
    url = F.when(F.col("reason").isNull(), F.col("url")).alias("url")
    exact = {r["feed"]: r for r in ingest_counts(whole.select("feed", "reason", url)).collect()}
    found = {r["feed"]: r for r in totals.totals().collect()}
    assert set(found) == set(exact) == {"a", "b", "all"}
    for feed, r in found.items():
        assert (r["fetched"], r["rejected"]) == (exact[feed]["fetched"], exact[feed]["rejected"])
        assert r["unique_urls"] == pytest.approx(exact[feed]["unique_urls"], rel=3 * totals.error)
        assert r["duplicates"] == r["fetched"] - r["rejected"] - r["unique_urls"]
    assert found["b"]["unique_urls"] == 45
    # One row per feed and writer, however many batches there were.
    assert Generations(spark, f"{totals.root}/writer=main").latest().count() == 2


def run_batches(spark, tmp_path, hours, files, name):
    """Files as batches of (url, minute of arrival); passed rows and the state's size per batch."""
    landing, out = tmp_path / f"{name}-in", tmp_path / f"{name}-out"
    landing.mkdir()
    for k, rows in enumerate(files):
        lines = [json.dumps({"url": u, "arrived": m}) for u, m in rows]
        (landing / f"{k:03d}.json").write_text("\n".join(lines))
        os.utime(landing / f"{k:03d}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    landed = spark.readStream.schema("url string, arrived timestamp")
    landed = landed.option("maxFilesPerTrigger", 1).json(str(landing))
    once = first_within(landed, "url", "arrived", hours)
    sizes = []
    writer = once.writeStream.format("parquet").option("path", str(out)).trigger(availableNow=True)
    query = writer.option("checkpointLocation", str(tmp_path / f"{name}-at")).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(r["url"] or "" for r in spark.read.parquet(str(out)).collect()), sizes


def stamp(minute):
    return f"2024-01-01T{minute // 60:02d}:{minute % 60:02d}:00Z"


def test_state_stays_flat_over_fifty_batches(spark, tmp_path):
    files = [[(f"u{k}-{i}", stamp(10 * k)) for i in range(20)] * 2 for k in range(50)]
    passed, sizes = run_batches(spark, tmp_path, 1, files, "flat")
    assert passed == sorted(f"u{k}-{i}" for k in range(50) for i in range(20))
    assert len(sizes) >= 50
    # Two hours hold 12 batches of 20 keys; a key leaves with the batch after.
    assert max(sizes) <= 13 * 20 and max(sizes[15:]) == sizes[15]


def test_repeats_within_the_hours_later_ones_and_late_rows(spark, tmp_path):
    files = [
        [("x", stamp(0)), ("x", stamp(1)), (None, stamp(2)), (None, stamp(2))],
        [("x", stamp(30)), ("y", stamp(50))],  # x within the hour of the first: dropped
        [("z", stamp(200))],  # moves time on; x expires
        [("w", stamp(201))],
        [("x", stamp(202)), ("late", stamp(20)), ("v", stamp(150))],  # x is new again
    ]
    passed, _ = run_batches(spark, tmp_path, 1, files, "late")
    assert passed == ["", "v", "w", "x", "x", "y", "z"]
    with pytest.raises(ValueError):
        first_within(spark.range(1), "id", hours=0)


def test_rows_without_a_time_arrive_with_their_batch(spark, tmp_path):
    files = [[("x", None), ("y", None), ("x", None)], [("x", None)]]
    passed, _ = run_batches(spark, tmp_path, 1, files, "none")
    assert passed == ["x", "y"]
