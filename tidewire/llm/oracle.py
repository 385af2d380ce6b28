"""SQL of the queries that SQL can express, for DuckDB over the same tables.

Without: op1, op3, op7 (tokenizers), op4 (covariance determinants), op5
(dictionaries), op10 (XXH64, components).
"""

from __future__ import annotations

from tidewire.llm.secrets import RULES

WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    hits = " UNION ALL ".join(
        f"""SELECT doc_id, {no} AS no, {_quoted(r.name)} AS kind,
        regexp_extract_all(text, {_quoted(r.pattern)}, 0) AS hits,
        regexp_extract_all(text, {_quoted(r.pattern)}, {r.part}) AS parts,
        string_split_regex(text, {_quoted(r.pattern)}) AS gaps, {r.least} AS least
        FROM texts WHERE regexp_matches(text, {_quoted(r.pattern)})"""
        for no, r in enumerate(RULES)
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({hits}),
each_match AS (
  SELECT doc_id, no, kind, least, unnest(range(1, len(hits) + 1)) AS i, hits, parts, gaps
  FROM matches),
placed AS (
  SELECT doc_id, no, kind, length(parts[i]) >= least AS counts,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS start,
    length(hits[i]) AS size
  FROM each_match),
found AS (
  SELECT doc_id, kind, no, start::BIGINT AS start,
    kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT AS span
  FROM placed WHERE counts),
by_doc AS (
  SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY start, no) FILTER (no < 3) AS base,
    string_agg(span, ',' ORDER BY start, no) AS spans
  FROM found GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM texts t LEFT JOIN by_doc USING (doc_id)"""


#: Windows of bytes as hexadecimal digits, two for each byte.
SUFFIXES = """
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
sized AS (SELECT doc_id, digits, len(digits) // 2 AS n FROM texts),
windows AS (
  SELECT doc_id, unnest(range(0, n - 99)) AS pos, digits FROM sized WHERE n >= 100),
keyed AS (SELECT doc_id, pos, substring(digits, 2 * pos + 1, 200) AS key FROM windows),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS no FROM keyed)
  WHERE no > 1),
stretches AS (
  SELECT doc_id, pos, max(pos + 100) OVER (PARTITION BY doc_id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM later),
numbered AS (
  SELECT doc_id, pos, sum(CASE WHEN reach IS NULL OR pos > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM stretches),
runs AS (
  SELECT doc_id, run, min(pos) AS begin_at, max(pos) + 100 AS end_at
  FROM numbered GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, begin_at, end_at, coalesce(lag(end_at) OVER w, 0) AS kept_from,
    row_number() OVER w AS no, count(*) OVER (PARTITION BY doc_id) AS runs_of_doc
  FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY begin_at)),
cut AS (
  SELECT s.doc_id, s.n, sum(end_at - begin_at) AS gone, count(*) AS spans,
    string_agg(substring(digits, 2 * kept_from + 1, 2 * (begin_at - kept_from))
      || CASE WHEN no = runs_of_doc THEN substring(digits, 2 * end_at + 1) ELSE '' END,
      '' ORDER BY begin_at) AS kept
  FROM gaps JOIN sized s USING (doc_id) GROUP BY s.doc_id, s.n)
SELECT s.doc_id, s.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed,
  coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, digits))) AS kept_sha256
FROM sized s LEFT JOIN cut USING (doc_id)"""

WINDOWS = rf"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS pos, words FROM texts WHERE len(words) >= 20),
keyed AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS key FROM windows),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS no FROM keyed)
  WHERE no > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS i FROM later),
by_doc AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT t.doc_id, len(words) AS n, coalesce(len(gone), 0) AS n_gone,
    CASE WHEN gone IS NULL THEN words ELSE list_transform(
      list_filter(range(1, len(words) + 1), lambda i: NOT list_contains(gone, i)), lambda i: words[i])
    END AS words
  FROM texts t LEFT JOIN by_doc USING (doc_id))
SELECT doc_id, n AS n_words, n_gone AS n_removed,
  sha256(array_to_string(words, ' ')) AS kept_sha256
FROM kept"""

NEAREST = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored) WHERE rank <= 5"""

#: Phrases of 2 to 4 words, cut in two, per language.
PHRASES = r"""
WITH pieces AS (
  SELECT doc_id, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM (
    SELECT doc_id, coalesce(lang, 'und') AS lang,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents)),
cut AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words
  FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM cut GROUP BY lang),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2),
    lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM cut, sizes WHERE len(words) >= size),
counted AS (
  SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase
  HAVING count(*) >= 30),
split AS (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE size > 1),
cuts AS (
  SELECT lang, phrase, f, k, array_to_string(words[1:k], ' ') AS head,
    array_to_string(words[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM split)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, k, h.f AS l, t.f AS r,
    (2000000::HUGEINT * c.f) // (h.f::HUGEINT + t.f) AS score
  FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head
    JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail),
least AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS no FROM scored)
  WHERE no = 1),
inside AS (
  SELECT lang, f, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM (
    SELECT lang, f, words, m, unnest(range(1, size - m + 2)) AS i FROM (
      SELECT *, unnest(range(2, size)) AS m FROM split WHERE size > 2))),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase),
free AS (
  SELECT s.* FROM least s LEFT JOIN longer x ON x.lang = s.lang AND x.phrase = s.phrase
  WHERE x.f IS NULL OR 100::HUGEINT * x.f < 80::HUGEINT * s.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
  JOIN totals USING (lang) WHERE rank <= 2000"""

ORACLES = {
    "op2_blob_ledger": _secrets(),
    "op6_suffix_dedup": SUFFIXES,
    "op8_difference_cover": WINDOWS,
    "op9_metric_tree": NEAREST,
    "op11_collocations": PHRASES,
}
