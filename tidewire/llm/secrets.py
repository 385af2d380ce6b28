"""Secret scans over a ledger of content-addressed texts. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import stored, with_text
from tidewire.plans.session import shared_folder

LEDGER = "blob string, rule string, version int, spans array<struct<start: int, end: int>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of ``pattern`` that don't overlap, if group ``part`` is long enough."""

    name: str
    pattern: str
    part: int = 0
    least: int = 1
    version: int = 1


#: The three base kinds.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
BASE = (
    Rule("assign", ASSIGN, part=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def blob_of(text: Column | str) -> Column:
    """The content address of a text: SHA-256 of its bytes; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(column, F.lit("")).cast("binary"), 256)


def _pieces(text: Column, rule: Rule) -> Column:
    """An entry for each match: code points before it since the last one, its own, if it counts."""
    pattern = F.lit(rule.pattern)
    gaps = F.split(text, rule.pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.regexp_extract_all(text, pattern, F.lit(rule.part))
    entries = F.transform(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), parts.alias("part")),
        lambda x: F.struct(
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["hit"]).alias("size"),
            (F.char_length(x["part"]) >= rule.least).alias("counts"),
        ),
    )
    return F.when(text.rlike(rule.pattern), F.filter(entries, lambda x: x["size"].isNotNull()))


def _matches(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, rule, version, spans) for every due rule of ``texts`` that matches.

    ``texts``: blob, text, due (names of rules).
    """
    found = texts.select(
        "blob",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(rule.name).alias("rule"),
                        F.when(
                            F.array_contains("due", rule.name), _pieces(F.col("text"), rule)
                        ).alias("pieces"),
                    )
                    for rule in rules
                )
            )
        ).alias("found"),
    ).select("blob", "found.rule", F.posexplode("found.pieces").alias("at", "piece"))
    found = found.distinct()  # rows repeated with their id
    upto = F.expr("sum(piece.gap + piece.size) OVER (PARTITION BY blob, rule ORDER BY at)")
    placed = found.select("blob", "rule", "piece", upto.cast("int").alias("end")).where(
        "piece.counts"
    )
    span = F.struct((F.col("end") - F.col("piece.size")).alias("start"), "end")
    return placed.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """What has been scanned: one row per blob, rule and version, without matches too."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except Exception as error:  # the first scan: nothing there yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and findings of every row of ``docs``; the ledger at ``path`` grows.

    ``docs`` may hold many versions of a document, one per row. Each text is
    addressed by its SHA-256. Pairs of blob and rule version that the ledger
    hasn't are due: one row of each due blob is read, its text scanned for its
    due rules, and the pairs are appended, with or without matches. Findings
    then join back to every row that has the blob. ``findings``: kind, start
    and end (code points, end exclusive), by start, then in the order of rules.

    A scan that fails before its append leaves nothing; one repeated after it
    finds nothing due. The text moves once, for due blobs; all else is narrow.
    The joins on blob are between written tables, so a blob that many rows
    share can be split.

    Null text: empty, without findings. Null doc_id and repeated rows: kept.
    No rows: no rows.
    """
    spark = docs.sparkSession
    paths = stored(docs.select("doc_id", blob_of("text").alias("blob")), "paths")
    wanted = F.array(
        *(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules)
    )
    firsts = paths.groupBy("blob").agg(F.min("doc_id").alias("first_id"))
    pairs = firsts.select("*", F.explode(wanted).alias("pair")).select(
        "blob", "first_id", "pair.*"
    )
    known = ledger(spark, path).select("blob", "rule", "version")
    due = stored(pairs.join(known, ["blob", "rule", "version"], "left_anti"), "due")
    asked = due.groupBy("blob", "first_id").agg(F.collect_set("rule").alias("due"))
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("blob", blob_of("text"))
        .join(
            asked.withColumnRenamed("blob", "asked"),
            (F.col("blob") == F.col("asked")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
        )
        .select("blob", "text", "due")
    )
    spans = _matches(texts, rules)
    rows = due.join(spans, ["blob", "rule"], "left").select(
        "blob",
        "rule",
        "version",
        F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"),
    )
    rows.write.mode("append").option("compression", "zstd").parquet(path)
    order = F.array(*(F.lit(r.name) for r in rules))
    entry = F.transform(
        "spans",
        lambda s: F.struct(
            s["start"].alias("start"),
            F.array_position(order, F.col("rule")).alias("no"),
            s["end"].alias("end"),
            F.col("rule").alias("kind"),
        ),
    )
    current = F.struct("rule", "version").isin(
        *(F.struct(F.lit(r.name), F.lit(r.version)) for r in rules)
    )
    by_blob = stored(
        ledger(spark, path)
        .where(current & (F.size("spans") > 0))
        .dropDuplicates(["blob", "rule", "version"])
        .select("blob", entry.alias("entries"))
        .groupBy("blob")
        .agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries")),
        "findings",
    )
    findings = F.transform(
        F.coalesce("entries", F.array().cast(by_blob.schema["entries"].dataType)),
        lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["end"].alias("end")),
    )
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", findings.alias("findings"))


def written(findings: Column) -> Column:
    """kind:start:end of findings, joined by commas."""
    each = F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"]))
    return F.array_join(each, ",")


def masked(text: Column, findings: Column, mark: str = "[secret]") -> Column:
    """``text`` with every found span, overlapping ones as one, replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, found: Column) -> Column:
        before = F.substring(text, state["at"] + 1, found["start"] - state["at"])
        return F.when(
            found["start"] >= state["at"],
            F.struct(
                found["end"].alias("at"),
                F.concat(state["out"], before, F.lit(mark)).alias("out"),
            ),
        ).otherwise(
            F.struct(F.greatest(state["at"], found["end"]).alias("at"), state["out"].alias("out"))
        )

    rest = lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.lit(2**31 - 1)))
    return F.aggregate(findings, start, step, rest)


def without_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with their secrets masked in ``text``; ``n_chars`` follows.

    The ledger is at ``path``, or a new one in the shared folder.
    """
    found = scan(docs, path or shared_folder(docs.sparkSession, "ledger"))
    secret = stored(
        found.where(F.size("findings") > 0)
        .select(F.col("doc_id").alias("secret_id"), F.col("blob").alias("secret_blob"), "findings")
        .dropDuplicates(["secret_id", "secret_blob"]),
        "secrets",
    )
    same = docs["doc_id"].eqNullSafe(secret["secret_id"]) & (
        blob_of(docs["text"]) == secret["secret_blob"]
    )
    text = F.when(
        F.col("findings").isNotNull(), masked(F.col("text"), F.col("findings"))
    ).otherwise(F.col("text"))
    return with_text(docs.join(secret, same, "left"), docs.columns, text)
