"""Keys of merged batches: runs of files, and a filter that tells which are worth opening.

The filter is a Bloom filter of a fixed number of pages. All bits of a key lie
in one page, so a lookup joins its keys to the pages once. A key that was
merged is never missed: the runs are written before the filter that covers
them, and a filter only gains bits. Keys it lets through are then looked up in
the runs, so a false one costs time only. Of each merge there is a generation,
in whose folder's name stand its number and the first run that is still used;
a generation counts once its files are complete.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits of a page: those of one value of Spark's bitmap aggregate, 4 KB.
PAGE_BITS = 32_768
# Bits that a key sets in its page.
HASHES = 4
GENERATION = re.compile(r"generation=(\d+)-(\d+)$")


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, as the file system of the store spells them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().toString() for status in found or [])


def remove(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partition_values(path: str) -> dict[str, str]:
    """``name=value`` parts of a path."""
    return dict(map(unquote, part.split("=", 1)) for part in path.split("/") if "=" in part)


@dataclass(frozen=True)
class KeyArchive:
    """The archive under ``root``; ``schema`` is that of the key rows, with ``url`` and ``url_bucket``.

    ``pages`` is fixed for the life of an archive. With ten bits a key, 256
    pages serve 800,000 keys at one false key in a hundred; beyond that more
    lookups open the runs. ``most_runs``: so many runs are merged into one.
    """

    spark: SparkSession
    root: str
    schema: str
    pages: int = 256
    most_runs: int = 16

    def generation(self) -> tuple[int, int] | None:
        """(number, first run) of the latest complete generation."""
        done = folders(self.spark, f"{self.root}/filter/generation=*/_SUCCESS")
        found = [GENERATION.search(path.rsplit("/", 1)[0]) for path in done]
        return max(((int(m[1]), int(m[2])) for m in found if m), default=None)

    def keys(self) -> DataFrame:
        """All merged key rows."""
        now = self.generation()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, run int").parquet(f"{self.root}/archive")
        return rows.where(F.col("run").between(now[1], now[0])).drop("run")

    def filter(self) -> DataFrame:
        """page, bits."""
        now = self.generation()
        if now is None:
            return self.spark.createDataFrame([], "page long, bits binary")
        return self._filter(*now)

    def _filter(self, number: int, first: int) -> DataFrame:
        path = f"{self.root}/filter/generation={number}-{first}"
        return self.spark.read.schema("page long, bits binary").parquet(path)

    def _page(self, url: Column) -> Column:
        return F.pmod(F.xxhash64(url), F.lit(self.pages)).alias("page")

    def _places(self, url: Column) -> Column:
        return F.array(
            *(F.pmod(F.xxhash64(url, F.lit(k)), F.lit(PAGE_BITS)) for k in range(HASHES))
        )

    def maybe(self, urls: DataFrame) -> DataFrame:
        """Those of ``urls`` (one column ``url``) that may have been merged; all that were."""
        asked = urls.select("url", self._page(F.col("url")), self._places(F.col("url")).alias("places"))
        there = F.forall(
            "places",
            lambda place: F.conv(
                F.hex(F.substring("bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10
            )
            .cast("int")
            .bitwiseAND(F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (place % 8).cast("int") + 1))
            != 0,
        )
        return asked.join(self.filter(), "page").where(there).select("url")

    def merge(self, keys: DataFrame) -> None:
        """Add key rows as a new run and write the filter that covers it.

        When runs have piled up, the new run takes in all of them. A merge that
        failed half way is begun again under the same number.
        """
        now = self.generation()
        number, first = (now[0] + 1, now[1]) if now else (0, 0)
        columns = [c.split()[0] for c in self.schema.split(",")]
        rows = keys.select(*columns)
        if number - first >= self.most_runs:
            rows, first = rows.unionByName(self.keys().select(*columns)), number
        run = f"{self.root}/archive/run={number}"
        dealt = rows.repartition("url_bucket").sortWithinPartitions("url_bucket", "url")
        dealt.write.mode("overwrite").partitionBy("url_bucket").parquet(run)
        written = self.spark.read.schema(self.schema).parquet(run)
        pages = (
            written.select(self._page(F.col("url")), F.explode(self._places(F.col("url"))).alias("place"))
            .groupBy("page")
            .agg(F.bitmap_construct_agg("place").alias("bits"))
        )
        if now:
            pages = pages.unionByName(self._filter(*now))
        merged = pages.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
        merged.coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/filter/generation={number}-{first}"
        )
        self._clear(number, first)

    def _clear(self, number: int, first: int) -> None:
        """Remove runs and generations no reader begins to use any more; one older one is kept."""
        for path in folders(self.spark, f"{self.root}/filter/generation=*"):
            if int(GENERATION.search(path)[1]) < number - 1:
                remove(self.spark, path)
        kept = min(
            [first, *(int(GENERATION.search(p)[2]) for p in folders(self.spark, f"{self.root}/filter/generation=*"))]
        )
        for path in folders(self.spark, f"{self.root}/archive/run=*"):
            if int(path.rsplit("=", 1)[1]) < kept:
                remove(self.spark, path)
