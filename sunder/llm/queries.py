"""Queries of the corpus operators over whole tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sunder.llm import chat, html_text, language_id, line_dedup, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-first quality rules over every document."""
    return quality_rules.line_first_quality(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_join.ngram_components(_table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents after later repeated runs of lines are gone, as digests."""
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_words", F.length("text").cast("long").alias("n_chars_left"), F.md5("text").alias("text_md5"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of 150 % of the corpus takes of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract_pages(_table(spark, sf_dir, "pages"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered."""
    out = chat.format_chats(_table(spark, sf_dir, "conversations"))
    return out.withColumn("n_chars", F.length("rendered").cast("long"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows for each row of embeddings whose id 100 divides."""
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two co-trained views."""
    return quality_classifier.co_train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the piece ids of every document, and whether they decode to its text."""
    return sentencepiece.encode_texts(_table(spark, sf_dir, "documents"), digest=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_sentencepiece, op3_quality_rules, op4_html_extraction, op5_ngram_jaccard_join,
        op6_line_dedup, op7_language_id, op8_mix_sources, op9_chat_formatting, op10_exact_topk,
    )
}



def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_W = r"[^\x20\x09-\x0D]+"

#: Document-wide counts, and the line rules of quality_rules, over RE2.
_OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, regexp_extract_all(text, '{_W}') AS w FROM d),
g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS k, w FROM t WHERE len(w) >= 3
), g2 AS (
  SELECT r, k, count(*) OVER (PARTITION BY r, w[k], w[k + 1], w[k + 2]) AS c FROM g
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM g2 WHERE c > 1) GROUP BY r
), l0 AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), l1 AS (
  SELECT r, i, line, regexp_extract_all(line, '{_W}') AS w,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^!]', '', 'g')) AS bangs,
         length(regexp_replace(line, '[^|»]', '', 'g')) AS pipes,
         length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper_n,
         length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters
  FROM l0
), l2 AS (
  SELECT *, len(w) AS n,
         len(list_filter(range(1, len(w) + 1), lambda k: k = 1 OR w[k] <> w[k - 1])) AS changed,
         row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth
  FROM l1
), m0 AS (
  SELECT r, i, n <= 4 AND NOT regexp_matches(line, '{_quoted(quality_rules.ENDED)}') AS short FROM l2 WHERE n > 0
), m1 AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY i) - row_number() OVER (PARTITION BY r, short ORDER BY i) AS island FROM m0
), m2 AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, short, island) AS c FROM m1) WHERE short AND c >= 4
), l3 AS (
  SELECT l2.*, n > 0 AND (10 * (symbols + bangs) > 3 * n OR (pipes >= 2 AND 4 * pipes >= n)
            OR (n <= 12 AND regexp_matches(line, '{_quoted(quality_rules.ELLIPSIS)}'))
            OR (n >= 5 AND 10 * upper_n > 9 * letters)
            OR (n <= 5 AND NOT regexp_matches(line, '{_quoted(quality_rules.ENDED)}') AND regexp_matches(line, '{_quoted(quality_rules.BULLET)}'))
            OR m2.i IS NOT NULL
            OR {" OR ".join(f"(n <= {most} AND regexp_matches(line, '{_quoted(p)}'))" for p, most in quality_rules.NOTICES)}
            OR (n >= 10 AND 4 * changed < n)) AS failed
  FROM l2 LEFT JOIN m2 ON m2.r = l2.r AND m2.i = l2.i
), a AS (
  SELECT r, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (failed) AS BIGINT) AS n_removed_lines,
         CAST(coalesce(sum(n) FILTER (failed), 0) AS BIGINT) AS removed_words, CAST(sum(symbols) AS BIGINT) AS n_symbols,
         CAST(count(*) FILTER (n > 0 AND nth > 1) AS BIGINT) AS n_dup_lines
  FROM l3 GROUP BY r
), b AS (
  SELECT d.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(t.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         a.n_symbols, a.n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, a.n_lines, a.n_removed_lines, a.removed_words
  FROM d JOIN t USING (r) JOIN a USING (r) LEFT JOIN rep USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * removed_words <= n_words AS kept
FROM b
"""

#: All pairs by shared shingles, then reachability.
_OP5 = rf"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_W}') AS w FROM documents
), s AS (
  SELECT DISTINCT r, CASE WHEN len(w) < 3 THEN list_aggregate(w, 'string_agg', ' ')
         ELSE w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] END AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM t WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (
  SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL
), e AS (
  SELECT x, y FROM i JOIN n p ON p.r = x JOIN n q ON q.r = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT r, r FROM n UNION SELECT reach.x, e.y FROM reach JOIN e ON e.x = reach.y
)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CASE WHEN n.n IS NULL THEN t.doc_id ELSE m.c END AS component_id
FROM t LEFT JOIN n USING (r) LEFT JOIN (SELECT x, min(t.doc_id) AS c FROM reach JOIN t ON t.r = reach.y GROUP BY x) m ON m.x = t.r
"""

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": _OP3,
    "op5_ngram_jaccard_join": _OP5,
    "op9_chat_formatting": chat.ORACLE_SQL,
    "op10_exact_topk": topk.ORACLE_SQL,
}
