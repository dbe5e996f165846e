"""Registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .html_extract import extract_pages
from .language import fit_language, predict_language
from .line_templates import drop_recurring_lines
from .mixing import mix_sources
from .ngram_join import similar_documents
from .packing import pack_documents
from .paragraph_dedup import dedup_paragraphs
from .topk import top_inner_products
from .toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(doc_id: str = "doc_id"):
    """False for a row without an id, from which nothing is learned either."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", _held_out(), "score", "predicted")


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_paragraphs(_table(spark, sf_dir, "documents"))


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").select("doc_id", "quality")).drop("epochs")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return left.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language(docs.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    return predict_language(docs, model).select("doc_id", _held_out(), "lang_pred", "score", "rejected")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_topk": op5_topk,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_language": op9_language,
    "op10_ngram_join": op10_ngram_join,
}

_OP4 = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""

_OP7 = r"""
WITH q AS (SELECT doc_id, max(quality)::DOUBLE AS quality FROM labels GROUP BY doc_id),
d AS (
  SELECT d.doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, quality,
         (('0x' || substr(md5('mix' || coalesce(d.doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5)
           / 281474976710656.0::DOUBLE AS u
  FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id
), k AS (
  SELECT doc_id, source, size, -ln(u) / coalesce(0.25::DOUBLE + 0.75::DOUBLE * quality, 0.5::DOUBLE) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM k GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio, sum(source_size) OVER () AS all_words FROM s
), l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM c
), v AS (SELECT *, (all_words - capped)::DOUBLE / open_weight AS level FROM l),
f AS (SELECT *, (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, capped LIMIT 1) AS final FROM v),
t AS (SELECT source, source_size, least(cap::DOUBLE, final * weight) AS target FROM f),
p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN start + size / 2.0::DOUBLE < CASE WHEN epochs >= 3 THEN 0.0::DOUBLE ELSE target - epochs * source_size END
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p
"""

_OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p
) WHERE rank <= 5
"""

SQL = {"op5_topk": _OP5, "op4_exact_dedup": _OP4, "op7_mixing": _OP7}
