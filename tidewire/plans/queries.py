"""One registered query per operator, over the given tables as a whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.dates import format_timestamp, parse_timestamp, published_timestamp
from tidewire.functions.ids import content_id
from tidewire.functions.text import clean_full, collapse_space, strip_tags
from tidewire.operators import chunk as chunks
from tidewire.operators import quantised, search
from tidewire.operators.counts import ingest_counts as count_ingest
from tidewire.operators.dedup import first_wins
from tidewire.operators.embed import embed_dense as dense
from tidewire.operators.embed import embed_sparse as sparse
from tidewire.operators.embed import in_budget
from tidewire.operators.inverted import search_index, write_index
from tidewire.operators.knn_join import nearest_by_pivots
from tidewire.operators.select import latest_per_feed as latest
from tidewire.operators.select import on_topic, recent
from tidewire.plans.inputs import (
    AS_OF,
    documents_as_feed_b,
    landed_lines,
    pages_as_feed_a,
    table,
    texts,
    written_date,
)
from tidewire.plans.session import shared_folder
from tidewire.sources.feeds import (
    FEED_A_SPEC,
    FEED_B_SPEC,
    common_from_a,
    common_from_b,
    feed_rank,
    landed_articles,
    parse_records,
    read_landing,
)
from tidewire.sources.polled import LineLog, stream_feeds
from tidewire.sources.store import VectorStore
from tidewire.streaming.ingest import Ingest, ingest_stream, stream_landing, with_arrival
from tidewire.streaming.state import IngestTotals, LatestPerFeed, first_within

TOPIC = "the that"
# Articles up to this time count as stored already, later ones as incoming.
STORED_UNTIL = "2024-01-01 05:00:00"


def _articles(spark: SparkSession, folder: str, deliveries: int = 1) -> DataFrame:
    """Both feeds in the common schema, with ``feed`` and arrival ``pos``."""
    a = pages_as_feed_a(spark, folder, deliveries).withColumn("feed", F.lit("a"))
    b = documents_as_feed_b(spark, folder).withColumn("feed", F.lit("b"))
    keep = ("feed", "pos")
    return common_from_a(a, AS_OF, keep).unionByName(common_from_b(b, AS_OF, keep))


def _unique_articles(spark: SparkSession, folder: str) -> DataFrame:
    order = [feed_rank(F.col("feed")), F.col("pos")]
    return first_wins(_articles(spark, folder, deliveries=2), "url", order)


def _searchable(spark: SparkSession, folder: str) -> DataFrame:
    """Refined articles of both feeds."""
    return chunks.refine(_articles(spark, folder))


# --- sources, selection, sink


def feed_union(spark: SparkSession, folder: str) -> DataFrame:
    return _unique_articles(spark, folder).select(
        "feed", "article_id", "title", "url", "published_at", "source_name"
    )


def recency_window(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return recent(events, "2024-01-15 12:00:00", 24, stamp="ts").select(
        "event_id", "event_type", format_timestamp(F.col("ts")).alias("at")
    )


def topic_filter(spark: SparkSession, folder: str) -> DataFrame:
    titled = table(spark, folder, "documents").withColumn(
        "title", F.substring_index("text", "\n", 1)
    )
    return on_topic(titled, TOPIC, "title", "text").select("doc_id", "source")


def latest_per_feed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return latest(events, 10, feed="event_type", stamp="ts", key="event_id").select(
        "event_type", "rank", "event_id"
    )


def store_latest(spark: SparkSession, folder: str) -> DataFrame:
    """Store all documents, then the labelled ones again with a new title and other chunks."""
    store = VectorStore(spark, shared_folder(spark, "store"))
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select("doc_id", "quality")

    def points(rows: DataFrame, title: Column) -> DataFrame:
        key = content_id(F.col("text"))
        none = F.lit(None).cast("string")
        return rows.select(
            key.alias("doc_id"),
            F.concat_ws("-", title, key).alias("chunk_id"),
            F.lit(0).alias("pos"),
            "text",
            F.array(F.length("text").cast("float")).alias("embedding"),
            F.struct(
                title.alias("title"),
                key.alias("url"),
                none.alias("published_at"),
                none.alias("source_name"),
                none.alias("image_url"),
            ).alias("metadata"),
        )

    store.write(points(documents, F.lit("first")), 0)
    labelled = documents.join(labels, "doc_id")
    store.write(points(labelled, F.lit("labelled")), 1)
    return store.current().select(
        "doc_id",
        F.col("metadata.title").alias("title"),
        "batch_id",
        F.col("embedding")[0].cast("double").alias("first_weight"),
    )


# --- mapping and validation


def common_articles(spark: SparkSession, folder: str) -> DataFrame:
    return _articles(spark, folder).drop("pos", "published_ts", "language")


def validate_split(spark: SparkSession, folder: str) -> DataFrame:
    lines = landed_lines(spark, folder)
    parts = [
        parse_records(lines.where(F.col("feed") == feed.name), feed).select("feed", "pos", "reason")
        for feed in (FEED_A_SPEC, FEED_B_SPEC)
    ]
    return parts[0].unionByName(parts[1])


def refine(spark: SparkSession, folder: str) -> DataFrame:
    return _searchable(spark, folder).select("doc_id", "full_text", "metadata.*")


# --- text and dates


def html_strip(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "pages").select(
        "page_id", collapse_space(strip_tags(F.col("html"))).alias("text")
    )


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = clean_full(F.col("text")).alias("text")
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    parts = [
        texts(spark, folder, "documents").select(
            F.lit("documents").alias("origin"), F.col("doc_id").cast("string").alias("id"), cleaned
        ),
        table(spark, folder, "conversations").select(
            F.lit("conversations").alias("origin"), turn.alias("id"), cleaned
        ),
        table(spark, folder, "benchmark").select(
            F.lit("benchmark").alias("origin"), F.col("item_id").cast("string").alias("id"), cleaned
        ),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def parse_published(spark: SparkSession, folder: str) -> DataFrame:
    dated = texts(spark, folder, "documents").select(
        "doc_id", written_date(F.col("doc_id")).alias("written")
    )
    return dated.select(
        "doc_id",
        "written",
        format_timestamp(published_timestamp(F.col("written"), AS_OF)).alias("published_at"),
        parse_timestamp(F.col("written")).isNotNull().alias("readable"),
    )


# --- chunks


def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("text")
    )
    split = cleaned.select("doc_id", F.posexplode_outer(chunks.sections(F.col("text"))))
    return split.where(F.col("col").isNotNull()).select(
        "doc_id",
        "pos",
        F.length("col").alias("n_chars"),
        content_id(F.col("col")).alias("section_id"),
    )


def chunk_tokens(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = texts(spark, folder, "documents").select(
        "doc_id", "source", clean_full(F.col("text")).alias("full_raw_text")
    )
    return chunks.explode_windows(cleaned, "full_raw_text", "doc_id", "source")


def chunk_subwords(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 254 pieces of at most five letters, as a subword tokenizer would cut."""

    def cut(text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(" ?[^ ]{1,5}"), F.lit(0))

    cleaned = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("cleaned")
    )
    tokens = chunks.Tokens(cut, joined_by="")
    return chunks.explode_windows(cleaned, "cleaned", "doc_id", tokens=tokens)


def _windows(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("cleaned")
    )
    return chunks.explode_windows(cleaned, "cleaned", "doc_id").select("doc_id", "pos", "text")


# --- embedding


def _weights(embedded: DataFrame) -> DataFrame:
    """Non-zero weights of the model's vectors, one row each."""
    entries = F.filter(
        F.transform("embedding", lambda x, at: F.struct(at.alias("bucket"), x.alias("weight"))),
        lambda entry: entry["weight"] != 0,
    )
    vectors = embedded.select("doc_id", "pos", F.explode(entries).alias("e"))
    return vectors.select("doc_id", "pos", "e.*").select(
        "doc_id", "pos", "bucket", F.round(F.col("weight").cast("double"), 6).alias("weight")
    )


def embed_dense(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(dense(_windows(spark, folder)))


def embed_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The same vectors from calls of texts of like length, 8,192 padded tokens at most."""
    return _weights(dense(_windows(spark, folder), model=in_budget(), batch_size=4_096))


def embed_sparse(spark: SparkSession, folder: str) -> DataFrame:
    weights = sparse(_windows(spark, folder), "doc_id", "pos")
    return weights.withColumn("weight", F.round("weight", 6))


# --- dedup and membership


def dedup_first(spark: SparkSession, folder: str) -> DataFrame:
    keyed = texts(spark, folder, "documents").select(
        "doc_id", "source", content_id(clean_full(F.col("text"))).alias("content_key")
    )
    return first_wins(keyed, "content_key", [F.col("doc_id")])


def _stored_and_all(spark: SparkSession, folder: str) -> tuple[VectorStore, DataFrame]:
    store = VectorStore(spark, shared_folder(spark, "store"))
    articles = _articles(spark, folder)
    early = articles.where(F.col("published_ts") <= F.lit(STORED_UNTIL).cast("timestamp_ntz"))
    refined = chunks.refine(early)
    none = F.lit(None)
    store.write(
        refined.select(
            "doc_id",
            content_id(F.col("full_text")).alias("chunk_id"),
            F.lit(0).alias("pos"),
            F.col("full_text").alias("text"),
            none.cast("array<float>").alias("embedding"),
            "metadata",
        ),
        0,
    )
    return store, articles


def new_only(spark: SparkSession, folder: str) -> DataFrame:
    store, articles = _stored_and_all(spark, folder)
    return store.only_new(articles, 1).select("feed", "article_id", "url")


def url_exists(spark: SparkSession, folder: str) -> DataFrame:
    store, articles = _stored_and_all(spark, folder)
    return store.exists(articles.select("feed", "url"))


# --- search


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors to the mean vector of every label."""
    rows, questions, vectors = _vectors(spark, folder)
    hits = search.nearest(rows.drop("label"), questions, vectors, ties=("vec_id",))
    return hits.select("topic", "rank", "vec_id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, folder: str):
    rows = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    means = (
        rows.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at")
        .agg(F.avg(F.col("x").cast("double")).alias("mean"))
        .groupBy("label")
        .agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("entries"))
    )
    questions = means.select(F.col("label").alias("topic"), F.col("entries.mean").alias("vector"))
    return rows, questions, search.Vectors("embedding", 64)


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest documents to every question."""
    documents = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("cleaned")
    )
    hits = search.search_text(
        documents,
        table(spark, folder, "benchmark"),
        text="cleaned",
        ties=("doc_id",),
        question="item_id",
    )
    return hits.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def search_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The same hits from an inverted index of 2 ** 18 buckets, written first."""
    documents = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("cleaned")
    )
    path = shared_folder(spark, "index")
    index = write_index(documents, path, text="cleaned", keys=("doc_id",), dimensions=1 << 18)
    hits = search_index(index, table(spark, folder, "benchmark"), question="item_id").hits
    return hits.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def search_many(spark: SparkSession, folder: str) -> DataFrame:
    """The first line of every document as a question, in several blocks."""
    cleaned = texts(spark, folder, "documents").select(
        "doc_id", clean_full(F.col("text")).alias("cleaned")
    )
    asked = table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), F.substring_index("text", "\n", 1).alias("text")
    )
    hits = search.search_text(
        cleaned, asked, 3, text="cleaned", ties=("doc_id",), question="item_id", block_rows=512
    )
    return hits.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _ingested(spark: SparkSession, folder: str) -> VectorStore:
    """Both feeds landed and ingested as one batch."""
    landing = shared_folder(spark, "landing")
    lines = landed_lines(spark, folder, damage=False).select("feed", "value")
    lines.write.partitionBy("feed").text(landing)
    store = VectorStore(spark, shared_folder(spark, "store"), dimensions=384)
    Ingest(store, AS_OF).run(with_arrival(read_landing(spark, landing)), 0)
    return store


def search_stored(spark: SparkSession, folder: str) -> DataFrame:
    """Questions against the ingested store, whose vectors are read as they are."""
    points = _ingested(spark, folder).current()
    hits = search.search_stored(points, table(spark, folder, "benchmark"), question="item_id")
    return hits.withColumn("score", F.round("score", 6))


def search_stored_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same among the articles of one source; the filter reaches the store's scan."""
    points = _ingested(spark, folder).current().where(F.col("metadata.source_name") == "src3")
    hits = search.search_stored(points, table(spark, folder, "benchmark"), question="item_id")
    return hits.withColumn("score", F.round("score", 6))


def search_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Hits over the articles of both feeds, as shown on a result page."""
    hits = search.search_text(
        _searchable(spark, folder),
        table(spark, folder, "benchmark"),
        text="full_text",
        ties=("doc_id",),
        question="item_id",
    )
    shown = search.as_hits(hits, "item_id")
    return shown.withColumn("score", F.round("score", 6))


def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Search among the articles of one source, chosen by payload."""
    one_source = _searchable(spark, folder).where(F.col("metadata.source_name") == "src3")
    hits = search.search_text(
        one_source.select("doc_id", "full_text"),
        table(spark, folder, "benchmark"),
        text="full_text",
        ties=("doc_id",),
        question="item_id",
    )
    return hits.select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def search_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk-level search, each article counted once by its best chunk."""
    hits = search.search_text(
        _windows(spark, folder).withColumn("chunk_id", content_id(F.col("text"))).drop("pos"),
        table(spark, folder, "benchmark"),
        text="text",
        ties=("doc_id", "chunk_id"),
        question="item_id",
        group="doc_id",
    )
    return hits.select("item_id", "rank", "doc_id", "chunk_id", F.round("score", 6).alias("score"))


def knn_join(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to every tenth one, itself included, by Voronoi cells."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % 10 == 0).withColumnRenamed("vec_id", "query_id")
    hits, _ = nearest_by_pivots(rows, asked, search.Vectors("embedding", 64), ties=("vec_id",))
    return hits.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _in_cells(spark: SparkSession, folder: str):
    """Vectors stored by cell, so that a search opens only the cells it probes."""
    rows, questions, vectors = _vectors(spark, folder)
    cells = search.Cells(64, bits=5)
    path = shared_folder(spark, "cells")
    search.write_cells(rows.select("vec_id", "embedding"), "embedding", cells, path)
    return spark.read.parquet(path), questions, vectors, cells


def knn_lsh(spark: SparkSession, folder: str) -> DataFrame:
    """The same neighbours by way of cells: few at first, then those not ruled out."""
    assigned, questions, vectors, cells = _in_cells(spark, folder)
    hits = search.nearest_in_cells(assigned, questions, vectors, cells, n_probe=8, ties=("vec_id",))
    return hits.select("topic", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    """One pass over the nearest cells only: recall and share of all pairs scored."""
    assigned, questions, vectors, cells = _in_cells(spark, folder)
    near = search.nearest_in_cells(
        assigned, questions, vectors, cells, n_probe=28, ties=("vec_id",), exact=False
    )
    share = search.pairs_scored(assigned, questions, vectors, cells, 28)
    exact = knn_topk(spark, folder).select("topic", "vec_id")
    return _recall(exact, near, "topic").withColumn("share_of_pairs", F.lit(round(share, 6)))


def _recall(exact: DataFrame, near: DataFrame, question: str) -> DataFrame:
    """Share of the exact neighbours that are among the near ones."""
    hit = near.select(question, "vec_id", F.lit(1).alias("hit"))
    found = exact.select(question, "vec_id").join(hit, [question, "vec_id"], "left")
    return found.agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


def knn_codes_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth vector against codes of all: recall, share of codes read and of pairs scored."""
    rows = table(spark, folder, "embeddings").select("vec_id", "embedding")
    asked = rows.where(F.col("vec_id") % 10 == 0).withColumnRenamed("vec_id", "query_id")
    vectors, keys, path = search.Vectors("embedding", 64), ("vec_id",), shared_folder(spark, "codes")
    quantiser = quantised.trained(rows, vectors)
    quantised.write_codes(rows, vectors, quantiser, keys, path)
    codes = quantised.read_codes(spark, path)
    probed = len(quantiser.pivots) * 7 // 8
    near = quantised.nearest_by_codes(codes, rows, asked, vectors, quantiser, probed, keys=keys)
    read = quantised.share_of_codes(codes, asked, vectors, quantiser, probed)
    scored = quantised.AGAIN * search.TOP_K / max(codes.count(), 1)
    return _recall(knn_join(spark, folder), near, "query_id").select(
        "recall",
        F.lit(round(read, 6)).alias("share_of_codes"),
        F.lit(round(min(scored, 1.0), 6)).alias("share_of_pairs"),
    )


# --- monitoring and the pipeline


def ingest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every record delivered twice, counted by its cleaned URL."""
    lines = landed_lines(spark, folder, damage=False)
    checked = landed_articles(lines.unionByName(lines), AS_OF)
    url = F.when(F.col("reason").isNull(), F.col("url"))
    return count_ingest(checked.select("feed", "reason", url.alias("url")))


def _stored_chunks(store: VectorStore) -> DataFrame:
    return store.current().select(
        "doc_id", "chunk_id", F.length("text").alias("n_chars"), "metadata.*"
    )


def _land(spark: SparkSession, folder: str, deliveries: int = 2) -> str:
    """Both feeds as files, delivered several times."""
    landing = shared_folder(spark, "landing")
    lines = landed_lines(spark, folder, damage=False)
    for _ in range(deliveries):
        out = lines.select("feed", "value").write.mode("append").partitionBy("feed")
        out.text(landing)
    return landing


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Land both feeds as files, twice, stream them in, and read the store.

    The second landing repeats every record, so each article must be stored
    once only.
    """
    landing = _land(spark, folder)
    store = VectorStore(spark, shared_folder(spark, "store"), dimensions=384)
    job = Ingest(store, AS_OF)
    stream = stream_landing(spark, landing, max_files=16)
    checkpoint = shared_folder(spark, "offsets")
    ingest_stream(stream, job, checkpoint, until_caught_up=True).start().awaitTermination()
    return _stored_chunks(store)


def stream_polled(spark: SparkSession, folder: str) -> DataFrame:
    """Poll both feeds from their positions, restart, poll what came since; read the store."""
    landing = shared_folder(spark, "feeds")
    store = VectorStore(spark, shared_folder(spark, "store"), dimensions=384)
    job, checkpoint = Ingest(store, AS_OF), shared_folder(spark, "offsets")
    lines = landed_lines(spark, folder, damage=False)
    feeds = {feed.name: LineLog(f"{landing}/feed={feed.name}") for feed in (FEED_A_SPEC, FEED_B_SPEC)}
    for delivery in range(2):
        out = lines.select("feed", F.lit(delivery).alias("delivery"), "value").write.mode("append")
        out.partitionBy("feed", "delivery").text(landing)
        polled = stream_feeds(spark, feeds)
        ingest_stream(polled, job, checkpoint, until_caught_up=True).start().awaitTermination()
    return _stored_chunks(store)


def stream_latest_per_feed(spark: SparkSession, folder: str) -> DataFrame:
    """The newest events of each type, kept up to date batch by batch."""
    events = table(spark, folder, "events").select("event_type", "ts", "event_id")
    landing = shared_folder(spark, "events")
    events.repartition(8).write.parquet(landing)
    newest = LatestPerFeed(
        spark, shared_folder(spark, "newest"), 10, feed="event_type", stamp="ts", key="event_id"
    )
    landed = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(landing)
    writer = newest.start(landed, shared_folder(spark, "offsets")).trigger(availableNow=True)
    writer.start().awaitTermination()
    return newest.current().select("event_type", "rank", "event_id")


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The URLs of articles delivered twice, each passed on once."""
    landed = stream_landing(spark, _land(spark, folder), max_files=16)
    checked = landed_articles(landed, AS_OF, keep=("_file_time",))
    articles = checked.where(F.col("reason").isNull()).select("url", "_file_time")
    once = first_within(articles, "url", "_file_time").select("url")
    found = shared_folder(spark, "once")
    writer = once.writeStream.option("checkpointLocation", shared_folder(spark, "offsets"))
    writer = writer.format("parquet").option("path", found).trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema("url string").parquet(found)


def stream_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Counts over a stream's life; the distinct URLs within three standard errors of the exact."""
    landed = stream_landing(spark, _land(spark, folder), max_files=8)
    checked = landed_articles(landed, AS_OF).select("feed", "reason", "url")
    totals = IngestTotals(spark, shared_folder(spark, "totals"))
    writer = checked.writeStream.foreachBatch(totals.add).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", shared_folder(spark, "offsets"))
    writer.start().awaitTermination()
    exact = ingest_counts(spark, folder).select("feed", F.col("unique_urls").alias("exact"))
    far = F.abs(F.col("unique_urls") - F.col("exact"))
    return totals.totals().join(exact, "feed").select(
        "feed",
        "fetched",
        "rejected",
        (far <= 3 * totals.error * F.col("exact")).alias("unique_is_close"),
    )


REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "search_text": search_text,
    "feed_union": feed_union,
    "recency_window": recency_window,
    "topic_filter": topic_filter,
    "latest_per_feed": latest_per_feed,
    "store_latest": store_latest,
    "common_articles": common_articles,
    "validate_split": validate_split,
    "refine": refine,
    "html_strip": html_strip,
    "clean_full": clean_text,
    "parse_published": parse_published,
    "chunk_recursive": chunk_recursive,
    "chunk_tokens": chunk_tokens,
    "chunk_subwords": chunk_subwords,
    "embed_dense": embed_dense,
    "embed_budget": embed_budget,
    "embed_sparse": embed_sparse,
    "dedup_first": dedup_first,
    "new_only": new_only,
    "url_exists": url_exists,
    "knn_topk": knn_topk,
    "search_hits": search_hits,
    "search_filtered": search_filtered,
    "search_articles": search_articles,
    "search_indexed": search_indexed,
    "search_many": search_many,
    "search_stored": search_stored,
    "search_stored_filtered": search_stored_filtered,
    "knn_join": knn_join,
    "knn_lsh": knn_lsh,
    "knn_lsh_recall": knn_lsh_recall,
    "knn_codes_recall": knn_codes_recall,
    "ingest_counts": ingest_counts,
    "stream_ingest": stream_ingest,
    "stream_polled": stream_polled,
    "stream_latest_per_feed": stream_latest_per_feed,
    "stream_dedup": stream_dedup,
    "stream_totals": stream_totals,
}
