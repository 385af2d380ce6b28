"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import (
    codec,
    collocations,
    metric_tree,
    neighbour_votes,
    packing,
    periodic_runs,
    quality,
    secrets,
    simhash,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)
from tidewire.llm.oracle import ORACLES  # noqa: F401
from tidewire.plans.session import shared_folder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed along a Hilbert curve into sequences of 2048 ids, per piece."""
    pieces = packing.pack(
        _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, found through a ledger of blobs that begins empty."""
    found = secrets.scan(_table(spark, folder, "documents"), shared_folder(spark, "ledger"))
    names = [rule.name for rule in secrets.BASE]
    base = F.filter("findings", lambda f: f["kind"].isin(names))
    counts = [
        F.size(F.expr(f"filter(findings, f -> f.kind = '{name}')")).cast("long").alias(f"n_{name}")
        for name in names
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.written(base).cast("binary"), 256).alias("base_sha256"),
        secrets.written(F.col("findings")).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document."""
    return token_counts.token_counts(
        _table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op4_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    """Word statistics of every document and whether the quality rules keep it."""
    return quality.quality(_table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_compression_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of a quarter of the ids are held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.learned(docs, labels.where(~held_out))
    return toxicity.scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that a 100-byte string repeats from further ahead, removed."""
    cut = suffix_dedup.remove_later_copies(_table(spark, folder, "documents"), 100)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_global_words(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by byte-level BPE, and their bytes again."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = codec.encode(_table(spark, folder, "documents"), ranks)
    decimal = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return codec.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_difference_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a 20-word window repeats from further ahead, removed."""
    cut = substring_dedup.remove_repeated_windows(_table(spark, folder, "documents"), 20)
    return cut.select(
        "doc_id",
        "n_words",
        F.col("removed").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_metric_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return metric_tree.nearest(
        _table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256
    )


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(_table(spark, folder, "documents"), radius=4, words=4)
    digits = F.lower(F.lpad(F.hex("bits"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.collocations(_table(spark, folder, "documents"))


def op12_neighbour_votes(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; labels of a third of the ids are held out."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = neighbour_votes.learned(docs, labels.where(~held_out))
    return neighbour_votes.scores(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted"
    )


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The documents; of a tenth of them the words from some place on repeat with some period."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    chosen = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    # For a row that isn't chosen nothing below is evaluated but ``chosen``.
    shaped = docs.select(
        "doc_id",
        "text",
        F.when(chosen, words).alias("words"),
        F.floor(F.crc32(F.col("doc_id").cast("string")) / 10).alias("g"),
    ).withColumn("n", F.size("words"))
    placed = shaped.withColumn("a", F.expr("if(n > 0, g % n, null)")).withColumn(
        "p", F.expr("1 + (n - a) div (3 + g % 8)")
    )
    repeated = F.expr(
        "array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p AS int)])), ' ')"
    )
    return placed.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of the words of every document, and its words with each run collapsed."""
    docs = _made_periodic(_table(spark, folder, "documents"))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = F.col("strongest")
    return periodic_runs.collapse_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_packing": op1_packing,
    "op2_blob_ledger": op2_blob_ledger,
    "op3_token_counts": op3_token_counts,
    "op4_robust_outliers": op4_robust_outliers,
    "op5_compression_distance": op5_compression_distance,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_global_words": op7_global_words,
    "op8_difference_cover": op8_difference_cover,
    "op9_metric_tree": op9_metric_tree,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_neighbour_votes": op12_neighbour_votes,
    "op13_periodic_runs": op13_periodic_runs,
}
