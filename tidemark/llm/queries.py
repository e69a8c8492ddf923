"""One query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, exact_substrings, fuzzy_lines, hamming_search, html_text, jaccard_join, language, mixing, quality
from ._common import table


def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every document in a mixture where a source of n documents weighs the square root of n."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; statistics from labelled rows outside the held-out quarter only."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.training_sample(docs.where(~language.held_out())))
    return language.identify(docs.withColumn("held_out", language.held_out()), model, keep=("held_out",))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest sign codes of every fiftieth vector."""
    return hamming_search.top_k(table(spark, sf_dir, "embeddings"))


def op5_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte under a 50-byte string of an earlier document removed."""
    return exact_substrings.remove_repeats(table(spark, sf_dir, "documents"), text=False)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat, up to a fifth of the words, an earlier one."""
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return jaccard_join.components_by_jaccard(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit audio, read back, and its features digested into one string."""
    media = audio.media_columns(table(spark, sf_dir, "documents"), media=False)
    spans = F.transform("segments", lambda s: F.format_string("%.3f-%.3f", s["start_s"], s["end_s"]))
    feature = F.concat_ws(";", F.format_string("frames=%d", "n_frames"), F.concat(F.lit("log_mel="), F.sha2("tensors", 256)), F.concat(F.lit("spans="), F.concat_ws(",", spans)))
    return media.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document from its text, its source and its language within the source."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the public 50k vocabulary and decoded again."""
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pfair_mixing": op1_pfair_mixing,
    "op2_language_id": op2_language_id,
    "op3_html_extraction": op3_html_extraction,
    "op4_hamming_search": op4_hamming_search,
    "op5_exact_substrings": op5_exact_substrings,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_audio_features": op8_audio_features,
    "op9_quality": op9_quality,
    "op10_byte_bpe": op10_byte_bpe,
}

_OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words),
rows_ AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM both_ JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.c AS component_id
FROM sets s JOIN (SELECT x, min(y) AS c FROM reach GROUP BY x) r ON r.x = s.doc_id
"""

_OP5 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, CAST(2 * i + 1 AS BIGINT), 100) AS s FROM b, unnest(range(len(h) // 2)) AS u(i)),
f AS (SELECT doc_id, i, substr(s, 1, 2) AS c, CASE WHEN len(s) = 100 AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN 1 ELSE 0 END AS hit FROM w),
g AS (SELECT doc_id, i, c, max(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
t AS (SELECT doc_id, sum(gone) AS gone, sum(CASE WHEN gone = 1 AND before = 0 THEN 1 ELSE 0 END) AS spans,
             string_agg(c, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT b.doc_id, CAST(len(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(t.gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(t.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
FROM b LEFT JOIN t USING (doc_id)
"""

_OP4 = """
WITH pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
         CAST(list_sum(list_transform(list_zip(q.embedding, b.embedding),
              lambda z: CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q JOIN embeddings b ON q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM pairs)
SELECT query_id, rank, neighbor_id, distance FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op4_hamming_search": _OP4, "op5_exact_substrings": _OP5, "op7_jaccard_join": _OP7}
