"""Merged keys: nothing is missed, nothing grows with the number of batches."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_store import points, urls
from tidewire.sources.archive import KeyArchive, folders, partition_values
from tidewire.sources.store import KEY_SCHEMA, VectorStore


def batch(spark, number, size=6):
    ids = [f"{number}-{i}" for i in range(size)]
    return points(spark, *[(f"d{i}", f"c{i}", 0, "t", f"u{i}") for i in ids])


def key_rows(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "url string")
    return rows.select(
        F.lit("d").alias("doc_id"), "url", F.lit(False).alias("repeated"),
        F.lit("2024-01-01").cast("timestamp").alias("written_at"),
        F.pmod(F.xxhash64("url"), F.lit(4)).cast("int").alias("url_bucket"),
        F.lit("w").alias("writer"), F.lit(0).cast("bigint").alias("batch_id"),
    )


@pytest.fixture(scope="module")
def piled(spark, tmp_path_factory):
    """A store of 14 batches, whose keys were merged every third one, runs every second merge."""
    store = VectorStore(
        spark, str(tmp_path_factory.mktemp("piled")), url_buckets=4, merge_after=3, filter_pages=2
    )
    sizes = []
    for number in range(14):
        store.write(batch(spark, number), number)
        sizes.append(looked_at(store))
    return store, sizes


def looked_at(store):
    """Files, and bytes, that a lookup of new URLs reads: recent keys and the filter."""
    now = store.archive.generation()
    where = [Path(store.root) / "keys"]
    if now:
        where.append(Path(store.root) / f"filter/generation={now[0]}-{now[1]}")
    found = [p for w in where for p in w.rglob("*.parquet")]
    return len(found), sum(p.stat().st_size for p in found)


def test_no_stored_url_is_missed(spark, piled):
    store, _ = piled
    stored = [f"u{n}-{i}" for n in range(14) for i in range(6)]
    new = [f"new{i}" for i in range(50)]
    assert sorted(r.url for r in store.only_new(urls(spark, *stored, *new), 99).collect()) == sorted(new)
    flags = {r.url: r.stored for r in store.exists(urls(spark, *stored, *new)).collect()}
    assert all(flags[u] for u in stored) and not any(flags[u] for u in new)
    assert store.keys().count() == len(stored) and store.current().count() == len(stored)


def test_lookups_stay_flat(piled):
    _, sizes = piled
    early = [s for s in sizes[4:8]]
    late = [s for s in sizes[-4:]]
    assert max(files for files, _ in late) <= max(files for files, _ in early)
    assert max(size for _, size in late) <= 1.5 * max(size for _, size in early)


def test_new_urls_open_no_run(spark, piled, plan_of):
    store, _ = piled
    store.archive.filter().count()
    wide = VectorStore(spark, store.root, url_buckets=4, merge_after=3, filter_pages=2)
    plan = plan_of(wide.only_new(urls(spark, "another", "one more"), 99))
    assert "archive" not in plan
    assert "archive" in plan_of(wide.only_new(urls(spark, "u1-1"), 99))


def test_runs_are_merged_and_old_ones_removed(spark, tmp_path):
    archive = KeyArchive(spark, str(tmp_path / "a"), KEY_SCHEMA, pages=3, most_runs=2)
    names = [[f"u{n}-{i}" for i in range(5)] for n in range(7)]
    for number, own in enumerate(names):
        archive.merge(key_rows(spark, own))
        assert archive.generation()[0] == number
        assert archive.keys().count() == 5 * (number + 1)
        seen = [n for part in names[: number + 1] for n in part]
        assert {r.url for r in archive.maybe(urls(spark, *seen)).collect()} == set(seen)
    assert len(folders(spark, f"{tmp_path}/a/archive/run=*")) <= 4
    assert len(folders(spark, f"{tmp_path}/a/filter/generation=*")) == 2


def test_false_positives_change_no_answer(spark, tmp_path, monkeypatch):
    """A filter that lets everything through: the runs decide."""
    store = VectorStore(spark, str(tmp_path / "s"), url_buckets=4, merge_after=1, filter_pages=1)
    for number in range(4):
        store.write(batch(spark, number), number)
    full = F.lit(bytes([255]) * 4096)
    monkeypatch.setattr(
        KeyArchive, "filter", lambda self: spark.range(1).select(F.col("id").alias("page"), full.alias("bits"))
    )
    asked = urls(spark, "u0-1", "u3-5", "never")
    assert [r.url for r in store.archive.maybe(urls(spark, "never")).collect()] == ["never"]
    assert [r.url for r in store.only_new(asked, 9).collect()] == ["never"]


def test_a_merge_cut_short_is_begun_again(spark, tmp_path, monkeypatch):
    """Keys in both places, a run without its filter: no lookup and no view minds."""
    store = VectorStore(spark, str(tmp_path / "s"), url_buckets=4, merge_after=2)
    import tidewire.sources.store as module

    kept = module.remove
    monkeypatch.setattr(module, "remove", lambda spark, path: None)  # dies before the removal
    for number in range(4):
        store.write(batch(spark, number), number)
    assert store.keys().select("url").distinct().count() == 24 < store.keys().count()
    assert store.current().count() == 24
    monkeypatch.setattr(module, "remove", kept)
    # dies after the run, before the filter
    number, _ = store.archive.generation()
    key_rows(spark, ["ghost"]).drop("url_bucket").withColumn("url_bucket", F.lit(0)).write.partitionBy(
        "url_bucket"
    ).parquet(f"{store.root}/archive/run={number + 1}")
    assert store.only_new(urls(spark, "ghost"), 9).count() == 1
    store.write(batch(spark, 4), 4)
    stored = [f"u{n}-{i}" for n in range(5) for i in range(6)]
    assert [r.url for r in store.only_new(urls(spark, *stored, "ghost"), 9).collect()] == ["ghost"]
    assert store.current().count() == 30


def test_the_latest_batch_of_each_writer_can_run_again(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "s"), url_buckets=4, merge_after=2)
    for number in range(3):
        store.write(batch(spark, number), number, "one")
        store.write(batch(spark, f"x{number}"), number, "two, with=signs")
    left = {
        (v["writer"], v["batch_id"])
        for v in map(partition_values, folders(spark, f"{store.root}/keys/url_bucket=*/writer=*/batch_id=*"))
    }
    assert ("one", "2") in left and ("two, with=signs", "2") in left and len(left) <= 4
    again = batch(spark, 2).withColumn("url", F.col("metadata.url"))
    assert store.only_new(again, 2, writer="one").count() == 6
    assert store.only_new(again, 3, writer="one").count() == 0
