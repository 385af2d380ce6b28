"""Ingest: landed feed records to stored vectors, in batch or as a stream."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidewire.operators.chunk import MAX_CHARS, MAX_TOKENS, OVERLAP, Tokens, chunk, refine
from tidewire.operators.dedup import first_wins
from tidewire.operators.embed import Predict, embed_dense
from tidewire.sources.feeds import FEEDS, feed_rank, landed_articles, rejected, valid
from tidewire.sources.store import MAIN, VectorStore
from tidewire.streaming.state import IngestTotals

# Fixed value: seconds between two looks at the landing folder.
POLL_SECONDS = 5
# Where a record stood, apart from its line: files as they came, then position.
FILE_ORDER = ("_file_time", "_file", "_block")

log = logging.getLogger(__name__)


def _fetched() -> list[Column]:
    """Counts taken while a batch is written: fetched and rejected, per feed."""
    counts = []
    for feed in FEEDS:
        here = F.col("feed") == feed.name
        counts.append(F.count_if(here).alias(f"fetched_{feed.name}"))
        bad = here & F.col("reason").isNotNull()
        counts.append(F.count_if(bad).alias(f"rejected_{feed.name}"))
    return counts


@dataclass(frozen=True)
class Ingest:
    """One ingest job.

    ``as_of`` stands in for unreadable dates. ``select`` narrows the articles
    (recency, topic, batch size) before anything is compared or embedded.
    The new articles of a batch are spread over ``embed_tasks`` tasks for
    chunking and the model: one per core if unset, as they come if 0.
    ``tokens`` plugs the model's tokenizer into the chunk windows. ``totals``
    counts over the stream's life what ``counted`` tells of a batch.
    """

    store: VectorStore
    as_of: datetime | str
    model: Callable[[], Predict] | None = None
    select: Callable[[DataFrame], DataFrame] | None = None
    max_chars: int = MAX_CHARS
    overlap: int = OVERLAP
    max_tokens: int = MAX_TOKENS
    embed_tasks: int | None = None
    tokens: Tokens = Tokens()
    totals: IngestTotals | None = None

    def points(self, articles: DataFrame) -> DataFrame:
        """Articles to embedded chunks."""
        refined = refine(articles)
        tasks = self.embed_tasks
        if tasks is None:
            tasks = articles.sparkSession.sparkContext.defaultParallelism
        if tasks:
            refined = refined.repartition(tasks)
        # Windows the store would overwrite anyway are not embedded.
        keep = "last" if self.store.granularity == "document" else "distinct"
        chunks = chunk(refined, self.max_chars, self.overlap, self.max_tokens, keep, self.tokens)
        narrow = chunks.select("doc_id", "chunk_id", "pos", "text", "metadata")
        return embed_dense(narrow, model=self.model)

    def check(self, landed: DataFrame) -> DataFrame:
        """Landed records (with arrival) as checked articles; works on a stream too.

        ``content`` is stored nowhere, so it isn't cleaned either.
        """
        return landed_articles(landed, self.as_of, keep=FILE_ORDER).drop("content")

    def store_batch(self, checked: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        """Store what is new among ``checked`` as batch ``batch_id``; quarantine the rest.

        URLs are made unique and compared with the store before chunking, so
        the model never sees a duplicate. The checked records are kept for the
        length of the batch, since quarantine, lookup and write each need them.
        """
        numbered = checked.withColumn("_line", F.monotonically_increasing_id()).persist()
        try:
            counts = Observation(f"batch {batch_id}")
            bad = rejected(numbered.observe(counts, *_fetched()))
            self._quarantine(bad, batch_id, writer)
            articles = valid(numbered)
            if self.select is not None:
                articles = self.select(articles)
            order = [feed_rank(F.col("feed")), *[F.col(name) for name in (*FILE_ORDER, "_line")]]
            unique = Observation(f"unique {batch_id}")
            once = first_wins(articles, "url", order).observe(unique, F.count("*").alias("unique"))
            fresh = Observation(f"new {batch_id}")
            new = self.store.only_new(once, batch_id, writer=writer)
            new = new.observe(fresh, F.count("*").alias("new"))
            self.store.write(self.points(new), batch_id, writer)
            found = counts.get | unique.get | fresh.get
            found["skipped"] = found["unique"] - found["new"]
            self.counted(writer, batch_id, found)
            if self.totals is not None:
                self.totals.add(numbered, batch_id, writer)
        finally:
            numbered.unpersist()

    def counted(self, writer: str, batch_id: int, found: dict[str, int]) -> None:
        """What a batch held: fetched and rejected per feed; unique, new and skipped URLs.

        Logged here; override it to send the counts elsewhere.
        """
        log.info("%s batch %d: %s", writer, batch_id, found)

    def run(self, landed: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        """Ingest a table of landed records as one batch.

        A large backlog is better streamed with ``max_files``, which takes it
        in batches that can each be repeated.
        """
        self.store_batch(self.check(landed), batch_id, writer)

    def _quarantine(self, bad: DataFrame, batch_id: int, writer: str) -> None:
        (
            bad.withColumn("writer", F.lit(writer))
            .withColumn("batch_id", F.lit(batch_id).cast("bigint"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("writer", "batch_id")
            .parquet(f"{self.store.root}/quarantine")
        )


def with_arrival(landed: DataFrame) -> DataFrame:
    """Add the file columns that order records by arrival."""
    return landed.select(
        "value",
        "feed",
        F.col("_metadata.file_modification_time").alias("_file_time"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def stream_landing(
    spark: SparkSession, landing: str, max_files: int | None = None, archive: str | None = None
) -> DataFrame:
    """The landing folder as a stream, one sub-folder per feed.

    ``max_files`` bounds a micro-batch. A look that finds nothing gives no
    batch; the stream does not end by itself. With ``archive`` files are moved
    there once ingested, which keeps the listing of the landing folder short.
    """
    reader = spark.readStream.schema("value string, feed string").format("text")
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_arrival(reader.load(landing))


def ingest_stream(
    landed: DataFrame, job: Ingest, checkpoint: str, until_caught_up: bool = False
) -> DataStreamWriter:
    """A writer ready to ``start()``; it resumes from ``checkpoint``.

    Records are parsed and mapped in the streaming plan, where each feed's
    branch reads only the files of its own folder. Batches are stored under the
    id that the checkpoint holds: another checkpoint is another writer.
    """
    spark = landed.sparkSession

    @cache
    def query_id() -> str:
        return spark.read.json(f"{checkpoint}/metadata").first()["id"]

    def store(checked: DataFrame, batch_id: int) -> None:
        job.store_batch(checked, batch_id, query_id())

    writer = job.check(landed).writeStream.foreachBatch(store)
    writer = writer.option("checkpointLocation", checkpoint)
    if until_caught_up:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{POLL_SECONDS} seconds")
