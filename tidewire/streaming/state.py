"""What a stream carries from batch to batch: a small table per stream, and keys that expire.

``Generations`` holds a table that each micro-batch replaces by itself and
the batch before, so its size follows the groups, not the number of batches.
The rows of a batch are reduced before they meet it, map-side, so a feed that
holds a third of all rows costs a few rows per task.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewire.operators.select import latest_per_feed
from tidewire.sources.archive import folders, partition_values, remove
from tidewire.sources.store import MAIN


@dataclass(frozen=True)
class Generations:
    """Versions of a small table under ``root``, one for each batch of one stream.

    Batch N is made of the version below N and replaces its own, so it can run
    again with the same result. The version it was made of stays until the
    next batch is done. A version counts once its files are complete.
    """

    spark: SparkSession
    root: str

    def numbers(self) -> list[int]:
        done = folders(self.spark, f"{self.root}/generation=*/_SUCCESS")
        return sorted(int(partition_values(path)["generation"]) for path in done)

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self._path(number))

    def before(self, batch_id: int) -> DataFrame | None:
        """What the batches below ``batch_id`` left."""
        older = [n for n in self.numbers() if n < batch_id]
        return self.read(older[-1]) if older else None

    def latest(self) -> DataFrame | None:
        numbers = self.numbers()
        return self.read(numbers[-1]) if numbers else None

    def replace(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(batch_id))
        older = [n for n in self.numbers() if n < batch_id]
        for number in older[:-1]:
            remove(self.spark, self._path(number))

    def _path(self, number: int) -> str:
        return f"{self.root}/generation={number}"


@dataclass(frozen=True)
class LatestPerFeed:
    """The newest ``n`` articles of each feed over a stream's whole life.

    After each batch ``current`` equals ``latest_per_feed`` over all rows so
    far: nothing comes too late, repeated rows count each, and rows without a
    stamp come last. Keep one ``root`` for one checkpoint.
    """

    spark: SparkSession
    root: str
    n: int = 5
    feed: str = "feed"
    stamp: str = "published_ts"
    key: str = "article_id"

    def _top(self, rows: DataFrame) -> DataFrame:
        return latest_per_feed(rows, self.n, self.feed, self.stamp, self.key)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        state = Generations(self.spark, self.root)
        before = state.before(batch_id)
        if before is not None:
            batch = batch.unionByName(before.drop("rank"))
        state.replace(batch_id, self._top(batch).coalesce(1))

    def start(self, articles: DataFrame, checkpoint: str) -> DataStreamWriter:
        writer = articles.writeStream.foreachBatch(self.add)
        return writer.option("checkpointLocation", checkpoint)

    def current(self) -> DataFrame | None:
        """Rows with their ``rank``; None before the first batch."""
        return Generations(self.spark, self.root).latest()


@dataclass(frozen=True)
class IngestTotals:
    """Fetched, rejected and distinct URLs per feed over a stream's whole life.

    The distinct count comes from HyperLogLog sketches of 2^``precision``
    registers, which unite without counting twice; ``error`` is its relative
    standard error. Each writer has versions of its own, united on reading, so
    a new checkpoint adds to what an old one counted.
    """

    spark: SparkSession
    root: str
    precision: int = 12

    @property
    def error(self) -> float:
        return 1.04 / sqrt(2**self.precision)

    def _united(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("feed").agg(
            F.sum("fetched").alias("fetched"),
            F.sum("rejected").alias("rejected"),
            F.hll_union_agg("urls", F.lit(True)).alias("urls"),
        )

    def add(self, checked: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        """Count checked records: ``feed``, ``reason`` (null when valid), ``url``."""
        url = F.when(F.col("reason").isNull(), F.col("url"))
        batch = checked.groupBy("feed").agg(
            F.count(F.lit(1)).alias("fetched"),
            F.count("reason").alias("rejected"),
            F.hll_sketch_agg(url, F.lit(self.precision)).alias("urls"),
        )
        state = Generations(self.spark, f"{self.root}/writer={writer}")
        before = state.before(batch_id)
        if before is not None:
            batch = self._united(batch.unionByName(before))
        state.replace(batch_id, batch.coalesce(1))

    def totals(self) -> DataFrame | None:
        """feed, fetched, rejected, unique_urls (an estimate), duplicates; plus "all".

        None before the first batch.
        """
        roots = folders(self.spark, f"{self.root}/writer=*")
        found = [Generations(self.spark, root).latest() for root in roots]
        parts = [part for part in found if part is not None]
        if not parts:
            return None
        united = parts[0]
        for part in parts[1:]:
            united = united.unionByName(part)
        whole = united.rollup("feed").agg(
            F.sum("fetched").alias("fetched"),
            F.sum("rejected").alias("rejected"),
            F.hll_sketch_estimate(F.hll_union_agg("urls", F.lit(True))).alias("unique_urls"),
            F.grouping("feed").alias("_all"),
        )
        return whole.select(
            F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("feed")).alias("feed"),
            "fetched",
            "rejected",
            "unique_urls",
            (F.col("fetched") - F.col("rejected") - F.col("unique_urls")).alias("duplicates"),
        )


def first_within(
    stream: DataFrame, key: str, arrived: str | None = None, hours: float = 24
) -> DataFrame:
    """One row of each ``key`` in ``hours`` of arrival; older keys leave the state.

    ``arrived`` is a timestamp that goes back by less than ``hours`` between
    batches, as a file's time does; null, or no such column: the time of the
    batch. A repeat within ``hours`` of the first is dropped, one within twice
    that may be, a later one passes as new, for the store's lookup to find. A
    row that arrives further back than ``hours`` behind the newest of earlier
    batches is dropped. Of equal keys in a batch any one stays; null is a key.
    So the state holds the keys of twice ``hours``, however long the stream
    lives.
    """
    if hours <= 0:
        raise ValueError("hours must be positive")
    now = F.current_timestamp()
    stamp = now if arrived is None else F.coalesce(F.col(arrived).cast("timestamp"), now)
    stamped = stream.withColumn("_arrived", stamp).withWatermark(
        "_arrived", f"{round(hours * 3600)} seconds"
    )
    return stamped.dropDuplicatesWithinWatermark([key]).drop("_arrived")
