"""The vector store: Parquet tables written one batch at a time.

``points`` holds the chunks with vector and metadata, partitioned by writer and
batch. ``keys`` holds one narrow row per stored article, partitioned by a hash
of its URL, writer and batch. Asking which URLs are known opens only the
directories the asked URLs fall into, and finding out which articles have
several versions never touches the vectors.

Once the keys of ``merge_after`` batches have piled up they move to an archive
(``KeyArchive``) while the stream goes on. A lookup then reads the keys of the
latest batches and a filter of fixed size, and opens the archive only for URLs
that the filter lets through, so it doesn't grow with the number of batches.
The latest batch of each writer stays where it is, as it may be run again.

A writer is one stream (its checkpoint) or one series of batch runs. Its batch
N replaces only its own partition N in both tables, and lookups for it see all
rows but those. So a batch that fails half way can be run again with the same
result, and a new checkpoint, whose numbers begin at 0 again, overwrites
nothing. One job writes at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.dedup import exists_in, only_new
from tidewire.operators.ranking import top_n
from tidewire.plans.session import shared_folder
from tidewire.sources.archive import KeyArchive, folders, partition_values, remove
from tidewire.sources.schemas import METADATA_FIELDS

POINT_COLUMNS = ("doc_id", "chunk_id", "pos", "text", "embedding", "metadata")
POINT_SCHEMA = (
    "doc_id string, chunk_id string, pos int, text string, embedding array<float>, "
    f"metadata struct<{', '.join(f'{name}: string' for name in METADATA_FIELDS)}>, "
    "written_at timestamp, writer string, batch_id bigint"
)
# "repeated" marks an article with several points of one identity in its batch.
KEY_SCHEMA = (
    "doc_id string, url string, repeated boolean, written_at timestamp,"
    " url_bucket int, writer string, batch_id bigint"
)
# The writer of batches that name none.
MAIN = "main"

# What identifies a point, and which of several points with one identity is current.
IDENTITY = {"chunk": ["doc_id", "chunk_id"], "document": ["doc_id"]}


@dataclass(frozen=True)
class VectorStore:
    """A store under ``root``; it comes into being with its first batch.

    ``granularity`` "chunk" keeps every chunk of an article, "document" one
    point per article, the last chunk winning. ``url_buckets`` is fixed for
    the life of a store; choose it so that one bucket's URLs stay a small file.
    ``dimensions`` is the size of its vectors; without it that of the vectors
    already stored. A vector of another size is refused on writing.
    ``filter_pages``, fixed as well, are the pages of the archive's filter.
    """

    spark: SparkSession
    root: str
    granularity: str = "chunk"
    url_buckets: int = 16
    dimensions: int | None = None
    merge_after: int = 16
    filter_pages: int = 256

    def __post_init__(self):
        if self.granularity not in IDENTITY:
            raise ValueError(f"granularity must be one of {sorted(IDENTITY)}")

    # --- reading

    def points(self) -> DataFrame:
        """Every stored version of every point."""
        return self._read("points", POINT_SCHEMA)

    def current(self) -> DataFrame:
        """The current points: of each article those of its latest batch.

        An article stored again replaces all its older chunks. Of several
        points with one identity in a batch the last position counts. Ingest
        stores an article once, so as a rule nothing has a second version and
        this is a plain scan. Which articles are the exception is read from the
        keys when this is called; only their points are shuffled.
        """
        points, several = self.points(), self._several_versions()
        if several.isEmpty():
            return points
        batch = F.struct("written_at", "writer", "batch_id")
        newest = several.withColumnRenamed("newest", "_newest")
        latest = points.join(newest, "doc_id").where(batch == F.col("_newest")).drop("_newest")
        order = [F.col("pos").desc(), F.col("chunk_id").asc()]
        once = top_n(latest, IDENTITY[self.granularity], order, 1, "_v").drop("_v")
        return points.join(several, "doc_id", "left_anti").unionByName(once)

    def _several_versions(self) -> DataFrame:
        """Articles written more than once, or with a point repeated in a batch; newest batch."""
        written = self.keys().groupBy("doc_id")
        # A merge that was cut short leaves keys in both places; they have one batch.
        counted = written.agg(
            F.count_distinct("writer", "batch_id", "url").alias("n"),
            F.bool_or("repeated").alias("again"),
            F.max(F.struct("written_at", "writer", "batch_id")).alias("newest"),
        )
        return counted.where((F.col("n") > 1) | F.col("again")).select("doc_id", "newest")

    @property
    def archive(self) -> KeyArchive:
        return KeyArchive(self.spark, self.root, KEY_SCHEMA, self.filter_pages)

    def keys(self, but: tuple[str, int] | None = None) -> DataFrame:
        """URLs stored so far, without those of the writer and batch ``but``."""
        return self._without(self._read("keys", KEY_SCHEMA).unionByName(self.archive.keys()), but)

    def _without(self, keys: DataFrame, but: tuple[str, int] | None) -> DataFrame:
        if but is None:
            return keys
        own = (F.col("writer") == but[0]) & (F.col("batch_id") == but[1])
        return keys.where(~own)

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    # --- lookups

    def bucket(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.url_buckets)).cast("int")

    def only_new(
        self, articles: DataFrame, batch_id: int, url: str = "url", writer: str = MAIN
    ) -> DataFrame:
        """Articles whose URL no other batch has stored."""
        return only_new(articles, self._keys_for(articles, (writer, batch_id), url), url)

    def exists(self, articles: DataFrame, url: str = "url") -> DataFrame:
        """``articles`` with a flag ``stored``."""
        return exists_in(articles, self._keys_for(articles, None, url), url)

    def _keys_for(self, articles: DataFrame, but: tuple[str, int] | None, url: str) -> DataFrame:
        """Stored keys among which are all that ``articles`` ask for.

        Of the latest batches those in the buckets they fall into, at most
        ``url_buckets`` numbers; of the archive those the filter lets through.
        The URLs asked for are written once, so ``articles`` isn't planned again.
        """
        path = shared_folder(self.spark, "asked")
        articles.select(F.col(url).alias("url")).distinct().write.parquet(path)
        asked = self.spark.read.schema("url string").parquet(path)
        latest = self._read("keys", KEY_SCHEMA).where(
            F.col("url_bucket").isin(self._buckets_of(asked))
        )
        keys = self._without(latest, but).select("url")
        if self.archive.generation() is not None:
            path = shared_folder(self.spark, "maybe")
            self.archive.maybe(asked).write.parquet(path)
            maybe = self.spark.read.schema("url string").parquet(path)
            if buckets := self._buckets_of(maybe):
                older = self.archive.keys().where(F.col("url_bucket").isin(buckets))
                older = self._without(older, but).select("url")
                keys = keys.unionByName(older.join(maybe, "url", "left_semi"))
        return keys.select(F.col("url").alias(url))

    def _buckets_of(self, urls: DataFrame) -> list[int]:
        return [row["b"] for row in urls.select(self.bucket(F.col("url")).alias("b")).distinct().collect()]

    # --- writing

    def write(self, points: DataFrame, batch_id: int, writer: str = MAIN) -> None:
        """Upsert one batch of points (see ``POINT_COLUMNS``)."""
        now = datetime.now(UTC)
        stamp = [
            F.lit(now).alias("written_at"),
            F.lit(writer).alias("writer"),
            F.lit(batch_id).cast("bigint").alias("batch_id"),
        ]
        sized = self._of_size(points.select(*POINT_COLUMNS))
        self._overwrite(sized.select("*", *stamp), "points", "writer", "batch_id")
        # The keys are read back from the partition just stored, without the vectors.
        stored = self._partition(writer, batch_id)
        kept = F.lit(1) if self.granularity == "document" else F.count_distinct("chunk_id")
        articles = stored.groupBy("doc_id", F.col("metadata.url").alias("url")).agg(
            (F.count(F.lit(1)) > kept).alias("repeated")
        )
        keys = articles.select("*", stamp[0], self.bucket(F.col("url")).alias("url_bucket"), *stamp[1:])
        self._overwrite(keys.hint("rebalance", "url_bucket"), "keys", "url_bucket", "writer", "batch_id")
        self._merge_keys()

    def _merge_keys(self) -> None:
        """Move the keys of all but each writer's latest batch to the archive, if many lie here.

        They are removed here only once the archive's filter covers them. A
        crash before that leaves some in both places, which no lookup minds.
        """
        found = folders(self.spark, f"{self.root}/keys/url_bucket=*/writer=*/batch_id=*")
        batch_of = {}
        for path in found:
            values = partition_values(path)
            batch_of[path] = values["writer"], int(values["batch_id"])
        if len(set(batch_of.values())) <= self.merge_after:
            return
        latest = {}
        for writer, batch in batch_of.values():
            latest[writer] = max(batch, latest.get(writer, batch))
        keys = self._read("keys", KEY_SCHEMA)
        for newest in latest.items():
            keys = self._without(keys, newest)
        self.archive.merge(keys)
        for path, (writer, batch) in batch_of.items():
            if batch < latest[writer]:
                remove(self.spark, path)

    def _partition(self, writer: str, batch_id: int) -> DataFrame:
        """One batch as stored; only its own directory is listed."""
        names = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        path = f"{self.root}/points/writer={names.escapePathName(writer)}/batch_id={batch_id}"
        try:
            return self.spark.read.schema(POINT_SCHEMA).parquet(path)
        except AnalysisException as error:  # a batch without points leaves no directory
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], POINT_SCHEMA)

    def _of_size(self, points: DataFrame) -> DataFrame:
        size = self.dimensions
        if size is None:
            sizes = self.points().where("embedding IS NOT NULL").select(F.size("embedding"))
            found = sizes.first()
            size = found[0] if found else None
        if size is None:
            return points
        fits = F.col("embedding").isNull() | (F.size("embedding") == size)
        fault = F.raise_error(
            F.format_string(f"a vector of size %d in a store of size {size}", F.size("embedding"))
        )
        return points.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(fault))

    def _overwrite(self, rows: DataFrame, table: str, *partitions: str) -> None:
        (
            rows.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*partitions)
            .parquet(f"{self.root}/{table}")
        )

    def rewrite(self, root: str, batch_id: int) -> VectorStore:
        """Current points as the single batch ``batch_id`` of a new store.

        For when many small batches have piled up: stop the stream, rewrite,
        and go on with the new store. ``batch_id`` must lie below the stream's
        next batch.
        """
        fresh = VectorStore(
            self.spark, root, self.granularity, self.url_buckets, self.dimensions
        )
        fresh.write(self.current().hint("rebalance"), batch_id)
        return fresh
