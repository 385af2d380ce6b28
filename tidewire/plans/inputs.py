"""The two feeds and the questions, derived from the given tables.

Neither pages nor documents has a publication date or an image, so both follow
from the id: the date is 2024-01-01 plus id minutes (starting over after a
year), written in one of five forms; every third article has no image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.partitioning import spread

AS_OF = "2024-02-01 00:00:00"
FIRST_DAY = "2024-01-01 00:00:00"
MINUTES_OF_YEAR = 365 * 24 * 60


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are about to be cleaned or embedded row by row."""
    return spread(table(spark, folder, name))


def written_date(key: Column) -> Column:
    """ISO, ISO with offset, RFC-822, US, or unreadable, by id modulo 5."""
    day = F.lit(FIRST_DAY).cast("timestamp_ntz")
    minutes = F.pmod(key, F.lit(MINUTES_OF_YEAR)).cast("int")
    stamp = day + F.make_dt_interval(mins=minutes)

    def as_text(pattern: str) -> Column:
        return F.date_format(stamp, pattern)

    form = F.pmod(key, F.lit(5))
    return (
        F.when(form == 0, as_text("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 1, as_text("yyyy-MM-dd HH:mm:ss'+02:00'"))
        .when(form == 2, as_text("EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
        .when(form == 3, as_text("MM/dd/yyyy HH:mm:ss"))
        .otherwise(F.lit("some time ago"))
    )


def image(key: Column, folder: str) -> Column:
    link = F.concat(F.lit(f"https://img.example/{folder}/"), key.cast("string"), F.lit(".jpg"))
    return F.when(F.pmod(key, F.lit(3)) != 0, link)


def pages_as_feed_a(spark: SparkSession, folder: str, deliveries: int = 1) -> DataFrame:
    """Pages as feed A records, each delivered ``deliveries`` times; ``pos`` is arrival."""
    key = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    again = F.explode(F.sequence(F.lit(0), F.lit(deliveries - 1))).alias("delivery")
    return (
        texts(spark, folder, "pages")
        .select("*", again)
        .select(
            F.concat_ws("-", "delivery", F.lpad(key.cast("string"), 12, "0")).alias("pos"),
            F.struct(
                F.lit(None).cast("string").alias("id"),
                F.regexp_extract("url", "^https?://([^/]+)", 1).alias("name"),
            ).alias("source"),
            F.lit(None).cast("string").alias("author"),
            # A later delivery has a changed headline, so it shows which one won.
            F.when(F.col("delivery") > 0, F.concat(F.lit("updated "), title))
            .otherwise(title)
            .alias("title"),
            F.regexp_replace("html", "<[^>]+>", "").alias("description"),
            "url",
            image(key, "page").alias("urlToImage"),
            written_date(key).alias("publishedAt"),
            F.lit(None).cast("string").alias("content"),
        )
    )


def documents_as_feed_b(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as feed B records; ``pos`` is arrival."""
    key = F.col("doc_id")
    none = F.lit(None).cast("string")
    return texts(spark, folder, "documents").select(
        F.concat_ws("-", F.lit("0"), F.lpad(key.cast("string"), 12, "0")).alias("pos"),
        key.cast("string").alias("article_id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(
            F.lit("https://"), F.col("source"), F.lit(".example/"), key.cast("string")
        ).alias("link"),
        F.col("text").alias("description"),
        written_date(key).alias("pubDate"),
        F.col("source").alias("source_id"),
        none.alias("source_url"),
        none.alias("source_icon"),
        F.lit(None).cast("array<string>").alias("creator"),
        image(key, "doc").alias("image_url"),
        none.alias("content"),
    )


def landed_lines(spark: SparkSession, folder: str, damage: bool = True) -> DataFrame:
    """Both feeds as JSON lines: ``feed``, ``pos``, ``value``.

    With ``damage`` some records miss a required field or are cut short, by
    id, so that validation has work to do.
    """
    a = pages_as_feed_a(spark, folder)
    b = documents_as_feed_b(spark, folder)
    number = F.substring_index("pos", "-", -1).cast("bigint")
    if damage:
        a = a.withColumn("url", F.when(F.pmod(number, F.lit(11)) != 3, F.col("url")))
        b = b.withColumn(
            "description", F.when(F.pmod(number, F.lit(9)) != 4, F.col("description"))
        )
    lines = []
    for feed, rows in (("a", a), ("b", b)):
        names = [c for c in rows.columns if c != "pos"]
        keep_null = {"ignoreNullFields": "false"}
        value = F.to_json(F.struct(*names))
        if feed == "b":
            # An even id writes its null description, an odd one leaves the key out.
            value = F.when(
                F.pmod(number, F.lit(2)) == 0, F.to_json(F.struct(*names), keep_null)
            ).otherwise(value)
        if damage:
            cut = F.substring(value, 1, 40)
            value = F.when(F.pmod(number, F.lit(13)) == 5, cut).otherwise(value)
        lines.append(rows.select(F.lit(feed).alias("feed"), "pos", value.alias("value")))
    return lines[0].unionByName(lines[1])
