"""The registered queries as DuckDB SQL over the same tables.

Written step by step from the meaning of each operator, not from the Spark
plans: the fused cleaning patterns, for one, are spelled out here as the
separate steps they stand for.
"""

from __future__ import annotations

from tidewire.plans.inputs import AS_OF, FIRST_DAY, MINUTES_OF_YEAR
from tidewire.plans.queries import STORED_UNTIL, TOPIC

# White space in any script, as a pattern class.
WS = (
    r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
BULLETS = (
    r"[\x{95}\x{b7}\x{2022}\x{2023}\x{2043}\x{204c}\x{204d}\x{2219}\x{25cb}\x{25cf}\x{25d8}"
    r"\x{25e6}\x{2619}\x{2765}\x{2767}\x{29be}\x{29bf}\x{3164}*]"
)


def _sub(text: str, pattern: str, by: str = "", every: bool = True) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}'{', ' + repr('g') if every else ''})"


def _strip(text: str) -> str:
    return _sub(text, f"^{WS}+|{WS}+$")


def _clean(text: str) -> str:
    text = f"lower({text})"
    text = _strip(_sub(text, r"[-\x{2013}]", " "))
    text = _strip(_sub(_sub(text, r"[\n\x{a0}]", " "), " {2,}", " "))
    text = _strip(_sub(text, f"^{BULLETS}", every=False))
    text = f"replace({text}, '&apos;', '''')"
    return _sub(_sub(text, r"[^\x00-\x7F]"), r"\pP")


def _clean_or_na(text: str) -> str:
    return f"CASE WHEN coalesce({text}, '') = '' THEN 'N/A' ELSE {_clean(text)} END"


def _url_or_na(url: str) -> str:
    cleaned = f"trim({_sub(_sub(url, '<[^>]+>'), f'{WS}+', ' ')})"
    return f"coalesce(nullif({cleaned}, ''), 'N/A')"


def _uuid(text: str) -> str:
    return f"regexp_replace(md5({text}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3-\\4-')"


def _published(key: str) -> str:
    stamp = f"TIMESTAMP '{FIRST_DAY}' + to_minutes(({key} % {MINUTES_OF_YEAR})::INT)"
    shown = f"CASE WHEN {key} % 5 = 4 THEN TIMESTAMP '{AS_OF}' ELSE {stamp} END"
    return f"strftime({shown}, '%Y-%m-%d %H:%M:%S')"


def _image(key: str, folder: str) -> str:
    return (
        f"CASE WHEN {key} % 3 = 0 THEN 'N/A' "
        f"ELSE 'https://img.example/{folder}/' || {key} || '.jpg' END"
    )


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{WS}+'), lambda w: w <> '')"


# --- shared CTEs -----------------------------------------------------------

FEEDS = f"""
feed_a AS (
  SELECT page_id AS key, url AS raw_url, {_url_or_na("url")} AS url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS raw_title,
         {_sub("html", "<[^>]+>")} AS raw_description,
         regexp_extract(url, '^https?://([^/]+)', 1) AS source_name
  FROM pages
),
feed_b AS (
  SELECT doc_id AS key, 'https://' || source || '.example/' || doc_id AS url,
         split_part(text, chr(10), 1) AS raw_title, text AS raw_description, source AS source_name
  FROM documents
),
articles AS (
  SELECT 'a' AS feed, key, {_uuid("url")} AS article_id, {_clean_or_na("raw_title")} AS title, url,
         {_published("key")} AS published_at, source_name, {_image("key", "page")} AS image_url,
         {_clean_or_na("raw_description")} AS description, 'N/A' AS content
  FROM feed_a
  UNION ALL
  SELECT 'b', key, key::VARCHAR, {_clean_or_na("raw_title")}, url,
         {_published("key")}, source_name, {_image("key", "doc")},
         {_clean_or_na("raw_description")}, 'N/A'
  FROM feed_b
)"""

REFINED = f"""{FEEDS},
refined AS (
  SELECT article_id AS doc_id, title || '.' || description AS full_text,
         title, url, published_at, source_name, image_url
  FROM articles
)"""

WINDOWED = f"""
cleaned AS (SELECT doc_id, source, {_clean("text")} AS text FROM documents),
tokens AS (SELECT doc_id, source, text, {_words("text")} AS words FROM cleaned),
windows AS (
  SELECT doc_id, source, text AS full_raw_text, (idx // 254)::INT AS pos,
         array_to_string(list_slice(words, idx + 1, idx + 254), ' ') AS text
  FROM (SELECT *, unnest(range(0, greatest(len(words), 1), 254)) AS idx FROM tokens)
)"""


def _cosine_search(
    corpus: str,
    keys: str,
    ties: str,
    group: str = "",
    asked: str = "benchmark",
    k: int = 10,
    buckets: int = 384,
) -> str:
    """CTEs from ``corpus(text, keys...)`` to ``ranked``: ``k`` per question of ``asked``."""
    bucket = f"('0x' || substr(md5(word), 1, 8))::BIGINT % {buckets}"
    one_per_group = (
        f"QUALIFY row_number() OVER (PARTITION BY item_id, {group} ORDER BY score DESC, {ties}) = 1"
        if group
        else ""
    )
    return f"""
numbered AS (SELECT row_number() OVER () AS row_id, * FROM ({corpus})),
row_terms AS (
  SELECT row_id, {bucket} AS bucket, count(*) AS tf
  FROM (SELECT row_id, unnest({_words("text")}) AS word FROM numbered)
  GROUP BY ALL
),
row_norms AS (SELECT row_id, sqrt(sum(tf * tf)) AS norm FROM row_terms GROUP BY row_id),
asked_terms AS (
  SELECT item_id, {bucket} AS bucket, count(*) AS tf
  FROM (SELECT item_id, unnest({_words(_clean("text"))}) AS word FROM {asked})
  GROUP BY ALL
),
asked_norms AS (SELECT item_id, sqrt(sum(tf * tf)) AS norm FROM asked_terms GROUP BY item_id),
dots AS (
  SELECT item_id, row_id, sum(d.tf * q.tf)::DOUBLE AS dot
  FROM row_terms d JOIN asked_terms q USING (bucket) GROUP BY ALL
),
scored AS (
  -- a text without a common word scores zero and is still a neighbour
  SELECT item_id, {keys}, coalesce(dot, 0) / (d.norm * q.norm) AS score
  FROM row_norms d CROSS JOIN asked_norms q LEFT JOIN dots USING (item_id, row_id)
  JOIN numbered USING (row_id)
),
single AS (SELECT * FROM scored {one_per_group}),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {ties}))::INT AS rank
  FROM single
  QUALIFY rank <= {k}
)"""


def _sections(source: str) -> str:
    """CTEs from ``source(doc_id, text)`` to ``sections(doc_id, pos, section)``.

    Texts here hold no line breaks and no word of 4,000 characters, so the
    space is the only separator that comes into play.
    """
    return f"""
whole AS (SELECT row_number() OVER () AS row_id, * FROM ({source})),
pieces AS (
  SELECT row_id, idx, len(CASE WHEN idx = 1 THEN word ELSE ' ' || word END) AS size
  FROM (SELECT row_id, unnest(string_split(text, ' ')) AS word,
               generate_subscripts(string_split(text, ' '), 1) AS idx
        FROM whole WHERE len(text) > 4000)
),
lengths AS (
  SELECT row_id, list_prepend(0, list(upto ORDER BY idx)) AS ends
  FROM (SELECT row_id, idx, (sum(size) OVER (PARTITION BY row_id ORDER BY idx))::BIGINT AS upto
        FROM pieces WHERE size > 0)
  GROUP BY row_id
),
runs AS (
  WITH RECURSIVE walk AS (
    SELECT row_id, ends, 1 AS start, len(list_filter(ends, lambda e: e <= 4000)) AS stop
    FROM lengths
    UNION ALL
    SELECT row_id, ends, start,
           len(list_filter(ends, lambda e: e <= ends[start] + 4000)) AS stop
    FROM (
      SELECT row_id, ends,
             1 + len(list_filter(ends, lambda e:
                 e < greatest(ends[stop] - 200, ends[stop + 1] - 4000))) AS start
      FROM walk WHERE stop < len(ends)
    )
  )
  SELECT row_id, start, ends[start] AS from_char, ends[stop] AS to_char FROM walk
),
cut AS (
  SELECT row_id, start,
         {_strip("substr(text, from_char + 1, to_char - from_char)")} AS section
  FROM runs JOIN whole USING (row_id)
  UNION ALL
  SELECT row_id, 0, {_strip("text")} FROM whole WHERE len(text) <= 4000
),
sections AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY row_id ORDER BY start) - 1)::INT AS pos, section
  FROM cut JOIN whole USING (row_id) WHERE section <> ''
)"""


# Damage done to the landed records, by id; see plans/inputs.py.
REASONS = f"""
reasons AS (
  SELECT 'a' AS feed, '0-' || lpad(page_id::VARCHAR, 12, '0') AS pos, page_id AS key, url AS link,
         CASE WHEN page_id % 13 = 5 THEN 'malformed'
              WHEN page_id % 11 = 3 THEN 'missing url' END AS reason
  FROM pages
  UNION ALL
  SELECT 'b', '0-' || lpad(doc_id::VARCHAR, 12, '0'), doc_id,
         'https://' || source || '.example/' || doc_id,
         CASE WHEN doc_id % 13 = 5 THEN 'malformed'
              WHEN doc_id % 9 = 4 AND doc_id % 2 = 1 THEN 'missing description' END
  FROM documents
)"""

STORED = f"published_at <= '{STORED_UNTIL}'"


def _whole_word(word: str, column: str) -> str:
    return rf"regexp_matches({column}, '(?i)(^|[^\pL\pN_]){word}([^\pL\pN_]|$)')"


ORACLES: dict[str, str] = {
    "search_text": f"""
WITH {_cosine_search(f'SELECT doc_id, {_clean("text")} AS text FROM documents', "doc_id", "doc_id")}
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked
""",
    "feed_union": f"""
WITH {FEEDS}
-- page urls are distinct and the first delivery comes first, so the second one never wins
SELECT feed, article_id, title, url, published_at, source_name FROM articles
QUALIFY row_number() OVER (PARTITION BY url ORDER BY feed, key) = 1
""",
    "recency_window": """
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-14 12:00:00' AND TIMESTAMP '2024-01-15 12:00:00'
""",
    "topic_filter": f"""
SELECT doc_id, source FROM documents WHERE lang = 'en' AND
{" AND ".join(_whole_word(word, "text") for word in TOPIC.split())}
""",
    "latest_per_feed": """
SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id))::INT AS rank,
       event_id
FROM events QUALIFY rank <= 10
""",
    "store_latest": """
WITH versions AS (
  SELECT md5(text) AS doc_id, 'first' AS title, 0::BIGINT AS batch_id, len(text) AS size FROM documents
  UNION
  SELECT md5(text), 'labelled', 1, len(text) FROM documents JOIN labels USING (doc_id)
)
SELECT doc_id, title, batch_id, size::DOUBLE AS first_weight FROM versions
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY batch_id DESC) = 1
""",
    "common_articles": f"""
WITH {FEEDS}
SELECT feed, article_id, title, url, published_at, source_name, image_url, description, content
FROM articles
""",
    "validate_split": f"WITH {REASONS} SELECT feed, pos, reason FROM reasons",
    "refine": f"""
WITH {REFINED}
SELECT doc_id, full_text, title, url, published_at, source_name, image_url FROM refined
""",
    "html_strip": f"""
SELECT page_id, trim({_sub(_sub("html", "<[^>]+>"), f"{WS}+", " ")}) AS text FROM pages
""",
    "clean_full": f"""
SELECT 'documents' AS origin, doc_id::VARCHAR AS id, {_clean("text")} AS text FROM documents
UNION ALL
SELECT 'conversations', conv_id || '/' || turn, {_clean("text")} FROM conversations
UNION ALL
SELECT 'benchmark', item_id::VARCHAR, {_clean("text")} FROM benchmark
""",
    "parse_published": f"""
WITH dated AS (
  SELECT doc_id, 
         TIMESTAMP '{FIRST_DAY}' + to_minutes((doc_id % {MINUTES_OF_YEAR})::INT) AS stamp FROM documents
),
written AS (
  SELECT doc_id, CASE doc_id % 5
    WHEN 0 THEN strftime(stamp, '%Y-%m-%dT%H:%M:%SZ')
    WHEN 1 THEN strftime(stamp, '%Y-%m-%d %H:%M:%S+02:00')
    WHEN 2 THEN strftime(stamp, '%a, %d %b %Y %H:%M:%S GMT')
    WHEN 3 THEN strftime(stamp, '%m/%d/%Y %H:%M:%S')
    ELSE 'some time ago' END AS written
  FROM dated
),
parsed AS (
  SELECT doc_id, written,
         try_strptime(regexp_replace(written, '(Z|[+]02:00| GMT)$', ''),
           ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%a, %d %b %Y %H:%M:%S',
            '%m/%d/%Y %H:%M:%S']) AS stamp
  FROM written
)
SELECT doc_id, written, stamp IS NOT NULL AS readable,
       strftime(coalesce(stamp, TIMESTAMP '{AS_OF}'), '%Y-%m-%d %H:%M:%S') AS published_at
FROM parsed
""",
    "chunk_recursive": f"""
WITH {_sections(f'SELECT doc_id, {_clean("text")} AS text FROM documents')}
SELECT doc_id, pos, len(section)::INT AS n_chars, md5(section) AS section_id FROM sections
""",
    "chunk_tokens": f"""
WITH {WINDOWED}
SELECT doc_id, source, pos, md5(text) AS chunk_id, text FROM windows
""",
    "chunk_subwords": f"""
WITH cleaned AS (SELECT doc_id, {_clean("text")} AS text FROM documents),
tokens AS (SELECT doc_id, regexp_extract_all(text, ' ?[^ ]{{1,5}}') AS pieces FROM cleaned),
windows AS (
  SELECT doc_id, (idx // 254)::INT AS pos,
         {_strip("array_to_string(list_slice(pieces, idx + 1, idx + 254), '')")} AS text
  FROM (SELECT *, unnest(range(0, greatest(len(pieces), 1), 254)) AS idx FROM tokens)
)
SELECT doc_id, pos, md5(text) AS chunk_id, text FROM windows
""",
    "embed_dense": f"""
WITH {WINDOWED},
terms AS (
  SELECT doc_id, pos, (('0x' || substr(md5(word), 1, 8))::BIGINT % 384)::INT AS bucket,
         count(*) AS tf
  FROM (SELECT doc_id, pos, unnest(string_split(text, ' ')) AS word FROM windows WHERE text <> '')
  GROUP BY ALL
)
SELECT doc_id, pos, bucket,
       round((tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, pos)))::FLOAT::DOUBLE, 6) AS weight
FROM terms
""",
    "embed_sparse": f"""
WITH {WINDOWED},
terms AS (
  SELECT doc_id, pos, (('0x' || substr(md5(word), 1, 8))::BIGINT % 384)::INT AS bucket,
         count(*) AS tf
  FROM (SELECT doc_id, pos, unnest(string_split(text, ' ')) AS word FROM windows WHERE text <> '')
  GROUP BY ALL
)
SELECT doc_id, pos, bucket,
       round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, pos)), 6) AS weight
FROM terms
""",
    "dedup_first": f"""
SELECT doc_id, source, md5({_clean("text")}) AS content_key FROM documents
QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY doc_id) = 1
""",
    "new_only": f"""
WITH {FEEDS}
SELECT feed, article_id, url FROM articles
WHERE url NOT IN (SELECT url FROM articles WHERE {STORED})
""",
    "url_exists": f"""
WITH {FEEDS}
SELECT feed, url, url IN (SELECT url FROM articles WHERE {STORED}) AS stored FROM articles
""",
    "knn_topk": """
WITH entries AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
         generate_subscripts(embedding, 1) AS idx
  FROM embeddings
),
means AS (SELECT label AS topic, idx, avg(x) AS mean FROM entries GROUP BY ALL),
scored AS (
  SELECT topic, vec_id,
         sum(x * mean) / (sqrt(sum(x * x)) * sqrt(sum(mean * mean))) AS score
  FROM entries JOIN means USING (idx) GROUP BY ALL
)
SELECT topic, vec_id, round(score, 6) AS score,
       (row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, vec_id))::INT AS rank
FROM scored QUALIFY rank <= 10
""",
    "knn_join": """
WITH sized AS (
  SELECT vec_id, embedding::DOUBLE[] AS v,
         sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
  FROM embeddings
),
scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_dot_product(q.v, r.v) / (q.norm * r.norm) AS score
  FROM sized q JOIN sized r ON q.vec_id % 10 = 0 AND q.norm > 0 AND r.norm > 0
)
SELECT query_id, vec_id, round(score, 6) AS score,
       (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id))::INT AS rank
FROM scored QUALIFY rank <= 10
""",
    "search_hits": f"""
WITH {REFINED},
{_cosine_search(
    "SELECT *, full_text AS text FROM refined",
    "doc_id, title, image_url, published_at, url", "doc_id")}
SELECT item_id, rank, round(score, 6) AS score, printf('%.2f%%', 100 * score) AS score_percent,
       title, image_url, published_at AS date, url
FROM ranked
""",
    "search_indexed": f"""
WITH {_cosine_search(
    f'SELECT doc_id, {_clean("text")} AS text FROM documents', "doc_id", "doc_id",
    buckets=1 << 18)}
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked
""",
    "search_many": f"""
WITH first_lines AS (
  SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS text FROM documents),
{_cosine_search(
    f'SELECT doc_id, {_clean("text")} AS text FROM documents', "doc_id", "doc_id",
    asked="first_lines", k=3)}
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked
""",
    "search_filtered": f"""
WITH {REFINED},
{_cosine_search(
    "SELECT doc_id, full_text AS text FROM refined WHERE source_name = 'src3'",
    "doc_id", "doc_id")}
SELECT item_id, rank, doc_id, round(score, 6) AS score FROM ranked
""",
    "search_articles": f"""
WITH {WINDOWED},
{_cosine_search(
    "SELECT doc_id, md5(text) AS chunk_id, text FROM windows",
    "doc_id, chunk_id", "doc_id, chunk_id", group="doc_id")}
SELECT item_id, rank, doc_id, chunk_id, round(score, 6) AS score FROM ranked
""",
    "ingest_counts": f"""
WITH {FEEDS}, delivered AS (SELECT feed, url FROM articles, range(2))
SELECT CASE WHEN grouping(feed) = 1 THEN 'all' ELSE feed END AS feed, count(*) AS fetched,
       0::BIGINT AS rejected, count(DISTINCT url) AS unique_urls,
       fetched - rejected - unique_urls AS duplicates
FROM delivered GROUP BY ROLLUP (feed)
""",
    "stream_ingest": f"""
WITH {FEEDS},
good AS (
  SELECT article_id AS doc_id, title, url, published_at, source_name, image_url,
         title || '.' || description AS text
  FROM articles
),
{_sections("SELECT doc_id, text FROM good")},
tokens AS (SELECT doc_id, {_words("section")} AS words FROM sections),
windows AS (
  SELECT doc_id, array_to_string(list_slice(words, idx + 1, idx + 254), ' ') AS text
  FROM (SELECT *, unnest(range(0, len(words), 254)) AS idx FROM tokens)
)
SELECT DISTINCT doc_id, md5(windows.text) AS chunk_id, len(windows.text)::INT AS n_chars,
       title, url, published_at, source_name, image_url
FROM windows JOIN good USING (doc_id)
""",
}

# Searching by cells is a way to the same result.
ORACLES["knn_lsh"] = ORACLES["knn_topk"]
# So is polling, keeping the newest batch by batch, and calling the model with other batches.
ORACLES["stream_polled"] = ORACLES["stream_ingest"]
ORACLES["stream_latest_per_feed"] = ORACLES["latest_per_feed"]
ORACLES["embed_budget"] = ORACLES["embed_dense"]
ORACLES["stream_dedup"] = f"WITH {FEEDS} SELECT DISTINCT url FROM articles"
ORACLES["stream_totals"] = f"""
SELECT feed, fetched, rejected, TRUE AS unique_is_close FROM ({ORACLES["ingest_counts"]})
"""
