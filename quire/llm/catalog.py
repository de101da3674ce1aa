"""The training-data queries by name; each takes (spark, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..runtime import spread
from . import ann, bpe_chunks, html_extract, line_dedup, media, near_dedup, packing, quality, token_count, url_filter
from .common import read_table

BPE_JSON = str(public_tokenizers.path("byte_bpe_50k.json"))
BPE_RANKS = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, spread(read_table(spark, sf_dir, "documents")), width=4, percent=80)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(spark, spread(read_table(spark, sf_dir, "documents")), BPE_JSON, limit=512)


def op3_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(spark, spread(read_table(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spread(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "labels")
    return quality.classify(spark, docs, labels)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, read_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, read_table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(spark, read_table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_decode_digests(spread(read_table(spark, sf_dir, "documents")), BPE_RANKS)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, spread(read_table(spark, sf_dir, "documents")), BPE_JSON, capacity=2048)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark, spread(read_table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_interleaved_media": op3_interleaved_media,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_html_extraction": op10_html_extraction,
}

ORACLES: dict[str, str] = {
    "op1_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.other)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reached r ON r.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id""",
    "op6_url_filter": url_filter.oracle(),
    "op7_line_dedup": """
WITH p AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
counts AS (
  SELECT source, line, count(*) AS pages
  FROM (SELECT DISTINCT doc_id, source, trim(u) AS line FROM (SELECT doc_id, source, unnest(lines) AS u FROM p))
  WHERE line <> '' GROUP BY source, line),
marks AS (
  SELECT source, list(line) AS marks FROM counts JOIN totals USING (source)
  WHERE pages >= 2 AND pages * 100 > total * 5 GROUP BY source),
cut AS (
  SELECT p.*, CASE WHEN marks IS NULL THEN lines
              ELSE list_filter(lines, lambda x: trim(x) = '' OR NOT list_contains(marks, trim(x))) END AS kept
  FROM p LEFT JOIN marks USING (source))
SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text,
       coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped
FROM cut""",
}
