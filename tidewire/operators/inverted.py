"""Text search by an inverted index: postings in blocks of articles, blocks skipped by bounds.

Articles lie in blocks. For each bucket that occurs in a block the index has
the postings (article, count) and the largest weight, count / norm, of the
block. The sum over a question's buckets of its weight times that largest
weight bounds every score in the block. A search reads the largest weights
first, scores the blocks of the highest bounds, a few and then some more, and
at last all whose bound reaches the k-th score found; the postings of the
others are never opened. The result is the one of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.functions.text import clean_full
from tidewire.functions.vectors import DIMENSIONS, bucket_counts, word_buckets
from tidewire.operators.partitioning import computed_once
from tidewire.operators.ranking import top_n
from tidewire.operators.search import TOP_K, Ranking, _best
from tidewire.plans.session import shared_folder

# Articles of a block, and neighbouring blocks that are scored in one group.
BLOCK_ROWS, GROUP_BITS = 64, 6
# Question words (distinct per question) that go to the tasks at once: 24 MB.
SENT_WORDS = 1 << 20
# Blocks of the highest bounds scored for each question, in turn, before the rest is judged by
# the k-th score found.
FIRST_BLOCKS = (4, 32)
# (question, block) pairs of one group, and question words in one matrix product.
GROUP_PAIRS, TOGETHER_WORDS = 65_536, 4096
# Stands for a bucket in the row that lists a block's articles.
HEAD = -1
# Allowance for the rounding of a bound's sum.
SLACK = 1e-9


@dataclass(frozen=True)
class TextIndex:
    """An index written by ``write_index``: ``blocks`` (one row each) and ``postings``.

    ``keys`` names the columns that identify an article, in the order that
    breaks ties.
    """

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    dimensions: int

    def blocks(self) -> DataFrame:
        """block, buckets, largest (per bucket), members (per article: place, squares, keys)."""
        return self.spark.read.parquet(f"{self.path}/blocks")

    def postings(self) -> DataFrame:
        """block, bucket, entries (place, tf)."""
        return self.spark.read.parquet(f"{self.path}/postings")


def _terms(text, dimensions: int):
    return bucket_counts(word_buckets(text, dimensions))


def _squares(terms: str):
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda total, t: total + t["tf"] * t["tf"])


def write_index(
    articles: DataFrame,
    path: str,
    *,
    text: str,
    keys: tuple[str, ...],
    dimensions: int = DIMENSIONS,
    block_rows: int = BLOCK_ROWS,
) -> TextIndex:
    """Write an index of ``articles`` (cleaned ``text``, ``keys``) to ``path``.

    Blocks hold articles with the same most frequent word, as a rule one
    language, and about one length: weights are shares of a length, so their
    largest ones are close to all. An article is one posting per distinct
    bucket; blank ones are left out.
    """
    spark = articles.sparkSession
    found = computed_once(articles.select(*keys, text), "terms", _terms(F.col(text), dimensions))
    frequent = F.array_max(F.transform("terms", lambda t: F.struct(t["tf"], t["bucket"])))["bucket"]
    sized = found.where("terms IS NOT NULL").select(
        *keys, "terms", _squares("terms").alias("squares"), frequent.alias("_frequent")
    )
    near = ["_frequent", "squares", *keys]
    low = F.col("_id").bitwiseAND((1 << 33) - 1)
    placed = _stored(
        sized.repartitionByRange(*near)
        .sortWithinPartitions(*near)
        .withColumn("_id", F.monotonically_increasing_id()),
        "placed",
    ).select(
        ((F.col("_id") - low) + F.floor(low / block_rows)).alias("block"),
        (low % block_rows).cast("int").alias("place"),
        "squares",
        *keys,
        "terms",
    )
    # Shuffled once, before the terms are rows: whole articles by their block.
    of_block = placed.repartition("block")
    each = of_block.select("block", "place", "squares", F.explode("terms").alias("t")).select(
        "block", "place", "t.bucket", F.col("t.tf").cast("int").alias("tf"),
        (F.col("t.tf") / F.sqrt("squares")).alias("weight"),
    )
    grouped = each.groupBy("block", "bucket").agg(
        F.sort_array(F.collect_list(F.struct("place", "tf"))).alias("entries"),
        F.max("weight").alias("largest"),
    )
    grouped.sortWithinPartitions("block", "bucket").write.parquet(f"{path}/postings")
    heads = (
        spark.read.parquet(f"{path}/postings")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("bucket", "largest"))).alias("heads"))
    )
    members = placed.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("place", "squares", *keys))).alias("members")
    )
    heads.join(members, "block").select(
        "block", F.col("heads.bucket").alias("buckets"), F.col("heads.largest").alias("largest"), "members"
    ).write.parquet(f"{path}/blocks")
    return TextIndex(spark, path, keys, dimensions)


def _stored(rows: DataFrame, purpose: str) -> DataFrame:
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@dataclass(frozen=True)
class Sent:
    """Questions as sent to the tasks: numbers, words with their owner and weight, scores to beat."""

    numbers: np.ndarray
    owner: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    floor: np.ndarray

    def bounds(self, buckets: np.ndarray, largest: np.ndarray) -> np.ndarray:
        """For each question the most that a score in a block can be."""
        at = np.minimum(np.searchsorted(buckets, self.buckets), len(buckets) - 1)
        weight = np.where(buckets[at] == self.buckets, largest[at] * self.weights, 0)
        return np.bincount(self.owner, weight, len(self.numbers))


def _sent(table: pa.Table, floor: dict[int, float]) -> Sent:
    terms = table["terms"].combine_chunks()
    flat = terms.flatten()
    owner = np.repeat(np.arange(len(table)), np.diff(terms.offsets.to_numpy()))
    squares = table["squares"].to_numpy()
    numbers = table["_no"].to_numpy()
    return Sent(
        numbers,
        owner,
        flat.field("bucket").to_numpy(),
        flat.field("tf").to_numpy() / np.sqrt(squares)[owner],
        np.array([floor.get(n, -np.inf) for n in numbers.tolist()]),
    )


def _scan(index: TextIndex, sent, first: int | None) -> DataFrame:
    """(_no, block, bound): per question the blocks that reach its floor, the ``first`` of a task or all."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Sent = sent.value
        names = ["_no", "block", "bound"]
        blocks = np.zeros((0, len(asked.numbers)), np.int64)
        best = np.zeros((0, len(asked.numbers)))
        for batch in batches:
            for block, buckets, largest in zip(batch["block"].to_pylist(), batch["buckets"], batch["largest"]):
                bounds = asked.bounds(buckets.values.to_numpy(), largest.values.to_numpy())
                if first is None:
                    at = np.flatnonzero(bounds >= asked.floor - SLACK)
                    columns = [asked.numbers[at], np.full(len(at), block), bounds[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                    continue
                best = np.vstack([best, np.where(bounds >= asked.floor - SLACK, bounds, -1)])
                blocks = np.vstack([blocks, np.full(len(bounds), block)])
                if len(best) > first:
                    order = np.argsort(-best, axis=0, kind="stable")[:first]
                    best, blocks = (np.take_along_axis(x, order, axis=0) for x in (best, blocks))
        at = np.flatnonzero(best >= 0)
        if len(at):
            columns = [np.tile(asked.numbers, len(best))[at], blocks.ravel()[at], best.ravel()[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return index.blocks().select("block", "buckets", "largest").mapInArrow(
        look, "_no long, block long, bound double"
    )


def _of_block(here: pa.Table, there: pa.Table, ranking: Ranking) -> pa.Table:
    """The best articles of a block for each question: _no, score, keys."""
    keys = list(ranking.ties)
    buckets = here["bucket"].to_numpy()
    members = here["members"][int(np.flatnonzero(buckets == HEAD)[0])].values
    squares = members.field("squares").to_numpy().astype(float)
    articles = pa.table([members.field(c) for c in keys], names=keys)
    order = np.argsort(buckets)
    entries = here["entries"].combine_chunks()
    asked = _sent(there, {})
    sizes = np.sqrt(there["squares"].to_numpy())
    counts = np.rint(asked.weights * sizes[asked.owner])
    together = np.cumsum(np.bincount(asked.owner, minlength=len(asked.numbers))) // TOGETHER_WORDS
    best = []
    for one in np.unique(together):
        questions = np.flatnonzero(together == one)
        words = slice(*np.searchsorted(asked.owner, [questions[0], questions[-1] + 1]).tolist())
        local, at = np.unique(asked.buckets[words], return_inverse=True)
        wanting = np.zeros((len(questions), len(local)))
        wanting[asked.owner[words] - questions[0], at] = counts[words]
        holding = np.zeros((len(squares), len(local)))
        place = order[np.minimum(np.searchsorted(buckets[order], local), len(order) - 1)]
        for column in np.flatnonzero(buckets[place] == local).tolist():
            own = entries[int(place[column])].values
            holding[own.field("place").to_numpy(), column] = own.field("tf").to_numpy()
        scores = (holding @ wanting.T) / (np.sqrt(squares)[:, None] * sizes[questions][None, :])
        low = len(scores) - ranking.k
        floor = np.partition(scores, low, axis=0)[low] if low > 0 else -np.inf
        rows, who = np.nonzero(scores >= floor)
        hits = articles.take(rows)
        hits = hits.append_column("_question", pa.array(questions[who], pa.int32()))
        hits = hits.append_column("score", pa.array(scores[rows, who]))
        best.append(hits.take(_best(hits, ranking)))
    found = pa.concat_tables(best).combine_chunks()
    numbers = pa.array(asked.numbers).take(found["_question"].combine_chunks())
    return pa.table([numbers, found["score"], *(found[c] for c in keys)], names=["_no", "score", *keys])


def _scored(index: TextIndex, wanted: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The ``k`` best articles of each wanted (_no, block): _no, score, keys."""
    words = wanted.join(asked.select("_no", F.col("terms.bucket").alias("bucket")), "_no").select(
        "block", F.explode("bucket").alias("bucket")
    )
    group = F.shiftright("block", GROUP_BITS).alias("_group")
    parts = wanted.groupBy(group).agg(
        F.ceil(F.count(F.lit(1)) / GROUP_PAIRS).cast("int").alias("_parts")
    )
    postings = index.postings().join(words.distinct(), ["block", "bucket"], "left_semi")
    wide = postings.schema["entries"].dataType, index.blocks().schema["members"].dataType
    rows = postings.select("block", "bucket", "entries", F.lit(None).cast(wide[1]).alias("members"))
    heads = (
        index.blocks()
        .join(wanted.select("block").distinct(), "block", "left_semi")
        .select("block", F.lit(HEAD).alias("bucket"), F.lit(None).cast(wide[0]).alias("entries"), "members")
    )
    left = rows.unionByName(heads).withColumn("_group", group).join(parts, "_group").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part")
    )
    right = (
        wanted.withColumn("_group", group)
        .join(parts, "_group")
        .select("_no", "block", "_group", F.pmod(F.xxhash64("_no"), F.col("_parts")).cast("int").alias("_part"))
        .join(asked.select("_no", "terms", "squares"), "_no")
    )
    member = index.blocks().schema["members"].dataType.elementType
    schema = T.StructType(
        [T.StructField("_no", T.LongType()), T.StructField("score", T.DoubleType())]
        + [member[c] for c in index.keys]
    )
    ranking = Ranking(k, index.keys)

    def score(here: pa.Table, there: pa.Table) -> pa.Table:
        if not there.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in _arrow_types(schema)})
        best = []
        here, there = here.sort_by("block"), there.sort_by("block")
        blocks, asking = here["block"].to_numpy(), there["block"].to_numpy()
        for block in np.unique(asking).tolist():
            rows = slice(*np.searchsorted(blocks, [block, block + 1]).tolist())
            asked = slice(*np.searchsorted(asking, [block, block + 1]).tolist())
            best.append(
                _of_block(
                    here.slice(rows.start, rows.stop - rows.start),
                    there.slice(asked.start, asked.stop - asked.start),
                    ranking,
                )
            )
        return pa.concat_tables(best).rename_columns(schema.names)

    groups = ["_group", "_part"]
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(score, schema)


def _arrow_types(schema: T.StructType) -> list[tuple[str, pa.DataType]]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in schema]


@dataclass(frozen=True)
class Found:
    """Ranked hits, and which blocks were read for which question (``_no``, ``block``)."""

    hits: DataFrame
    read: DataFrame
    asked: DataFrame
    index: TextIndex

    def share_read(self) -> float:
        """Of the postings of the questions' words, the share that was read."""
        sizes = self.index.postings().select("block", "bucket", F.size("entries").alias("n"))
        words = self.asked.select("_no", F.explode("terms.bucket").alias("bucket"))
        all_of = words.join(sizes.groupBy("bucket").agg(F.sum("n").alias("n")), "bucket")
        some = words.join(self.read, "_no").join(sizes, ["block", "bucket"])
        total = all_of.agg(F.sum("n")).first()[0] or 0
        return float((some.agg(F.sum("n")).first()[0] or 0) / total) if total else 0.0


def search_index(
    index: TextIndex,
    questions: DataFrame,
    k: int = TOP_K,
    *,
    question: str,
    question_text: str = "text",
) -> Found:
    """The ``k`` indexed articles nearest to each question, as ``search.search_text`` ranks them.

    Questions are cleaned and counted as articles are, their words sent to the
    tasks in blocks of a fixed size, one after the other; jobs run when this
    is called, their results lie in the shared folder. Blank questions have no
    hits; a repeated id is a question of its own.
    """
    spark = index.spark
    terms = _terms(clean_full(F.col(question_text)), index.dimensions)
    asked = computed_once(questions.select(question, question_text), "terms", terms)
    asked = asked.where("terms IS NOT NULL").select(question, "terms", _squares("terms").alias("squares"))
    asked = _stored(asked.withColumn("_no", F.monotonically_increasing_id()), "questions")
    total = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, ceil(total / (0.8 * SENT_WORDS)))
    order = [F.col("score").desc(), *[F.col(name).asc() for name in index.keys]]
    folder = shared_folder(spark, "found")
    for at in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("_no"), F.lit(blocks)) == at)
        table = own.select("_no", "terms", "squares").toArrow()
        read = near = None
        floor: dict[int, float] = {}
        for first in (*FIRST_BLOCKS, None):
            sent = spark.sparkContext.broadcast(_sent(table, floor))
            wanted = _scan(index, sent, first)
            if first is not None:
                wanted = top_n(wanted, ["_no"], [F.desc("bound"), F.asc("block")], first)
            wanted = wanted.select("_no", "block")
            if read is not None:
                wanted = wanted.join(read, ["_no", "block"], "left_anti")
            wanted = _stored(wanted, "wanted")
            sent.destroy()
            found = _scored(index, wanted, own, k)
            found = found if near is None else near.drop("rank").unionByName(found)
            near = _stored(top_n(found, ["_no"], order, k), "near")
            read = wanted if read is None else read.unionByName(wanted)
            floor = {r["_no"]: r["score"] for r in near.where(F.col("rank") == k).collect()}
        near.write.parquet(f"{folder}/hits/at={at}")
        read.write.parquet(f"{folder}/read/at={at}")
    hits = spark.read.parquet(f"{folder}/hits").drop("at")
    named = hits.join(asked.select("_no", question), "_no")
    columns = [question, "score", *index.keys, "rank"]
    return Found(named.select(*columns), spark.read.parquet(f"{folder}/read").drop("at"), asked, index)
