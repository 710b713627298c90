"""The opN_ queries: each operator over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat", "n_maximal_repeats")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contaminated documents only: a row for each document and item that it holds."""
    from .decontam import contaminated_passages

    return contaminated_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import near_duplicate_components

    return near_duplicate_components(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list stands in for a block list: the urls of every fiftieth page."""
    from .urlfilter import url_verdicts

    pages = _table(spark, sf_dir, "pages")
    return url_verdicts(pages, pages.filter("page_id % 50 = 0").select("url")).select("page_id", "host", "path", "rule", "verdict")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans, span_digests

    return span_digests(secret_spans(_table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc_round_trip

    return warc_round_trip(_table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences

    return pack_sequences(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeated_windows

    return remove_repeated_windows(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .negatives import mine_hard_negatives

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_hard_negatives(vectors, anchor=F.col("vec_id") % 100 == 0, label=label)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import group_variants, variant_words

    return group_variants(variant_words(_table(spark, sf_dir, "documents")))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import token_round_trip

    return token_round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_url_filters": op4_url_filters,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_files": op13_token_files,
}

#: Repeats of at least 10 words cover what repeated 10-word windows cover; a repeat of over 100 words is a repeated 101-word window.
OP1_SQL = r"""
WITH w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT doc_id, sum(n - 1) AS d FROM (
            SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL) GROUP BY doc_id),
g3 AS (SELECT doc_id, p, array_to_string(ws[p:p + 2], ' ') AS g FROM w, unnest(range(1, len(ws) - 1)) AS t(p)),
g10 AS (SELECT doc_id, p, array_to_string(ws[p:p + 9], ' ') AS g FROM w, unnest(range(1, len(ws) - 8)) AS t(p)),
g101 AS (SELECT doc_id, md5(array_to_string(ws[p:p + 100], ' ')) AS g FROM w, unnest(range(1, len(ws) - 99)) AS t(p)),
r3 AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g3), range(3) AS t(k) WHERE c > 1 GROUP BY doc_id),
r10 AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g10), range(10) AS t(k) WHERE c > 1 GROUP BY doc_id),
r101 AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, g FROM g101 GROUP BY ALL HAVING count(*) > 1)),
b AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(lines.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r3.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(r10.n, 0) AS BIGINT) AS n_covered_words, r101.doc_id IS NOT NULL AS too_long
      FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN r10 USING (doc_id) LEFT JOIN r101 USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered_words <= 30 * n_words AND NOT too_long AS kept
FROM b
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY ALL
"""

OP4_SQL = r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www[.]', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE page_id % 50 = 0 AND canonical IS NOT NULL),
r AS (SELECT page_id, host, path, l.canonical IS NOT NULL AS listed,
        CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
             WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
             WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
      FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""

OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS g
        FROM w, unnest(range(1, len(ws) - 18)) AS t(p)),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, p + k AS i FROM late, range(20) AS t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT words.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS left_text
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.i GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(left_text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

#: Base32 of a SHA-1: five hex digits are four characters.
OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM p)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(hex, 5 * (k // 4) + 1, 5))::INTEGER >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id < response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM r
"""

OP11_SQL = r"""
WITH q AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: CAST(greatest(-4194304, least(4194304, floor(256 * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
        CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
      FROM q a JOIN q b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST) AS k FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank,
        s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON p.a = s.a AND NOT s.same WHERE p.k <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT * FROM n WHERE rank <= 10
"""

#: The crc32 goes by a table of 256 values; neighbours share a word less one character.
OP12_SQL = r"""
WITH RECURSIVE t(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM t WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS c FROM (
           SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
coded AS (SELECT run, c, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
            lambda ch: CASE WHEN ord(ch) < 128 THEN [CAST(ord(ch) AS BIGINT)] ELSE [CAST(192 + (ord(ch) >> 6) AS BIGINT), 128 + (ord(ch) & 63)] END)) AS bytes FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda crc, b: xor(crc >> 8, tab[1 + (xor(crc, b) & 255)])), 4294967295) AS h FROM coded, tab),
variants AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM variants WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS d FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
near AS (SELECT l.word AS a, w.word AS b, w.n FROM less l JOIN words w ON l.d = w.word
         UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON l.d = w.word
         UNION SELECT l.word, r.word, r.n FROM less l JOIN less r ON l.d = r.d AND l.i = r.i AND l.word <> r.word),
best AS (SELECT *, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * w.n THEN b END AS form, CASE WHEN best.n >= 10 * w.n THEN best.n END AS form_n
          FROM words w LEFT JOIN best ON a = w.word AND k = 1),
way AS (SELECT word, word AS last FROM forms UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON way.last = forms.word WHERE forms.form IS NOT NULL)
SELECT forms.*, last AS root FROM forms JOIN way USING (word) WHERE NOT EXISTS (SELECT 1 FROM forms f WHERE f.word = way.last AND f.form IS NOT NULL)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_ngram_jaccard_join": OP3_SQL,
    "op4_url_filters": OP4_SQL,
    "op7_warc": OP7_SQL,
    "op10_substring_dedup": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
}
