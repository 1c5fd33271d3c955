"""The registered queries of the training-data operators: thin calls over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, ego_join, exact_dedup, jaccard_join, language_id, license_scan, mixing, pii_surrogates, spelling, suffix_dedup, token_rollup, warc
from .common import documents, shared_folder


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.license_scan(documents(spark, sf_dir))
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentence_ids", "licenses")})


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.pii_surrogates(documents(spark, sf_dir)).select("doc_id", "text", F.size("entities").cast("bigint").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("entities.kind")), ",").alias("kinds"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("kept_text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, some are deleted, others counted anew by the next tokenizer version; two batches are sent twice."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang").withColumn("tenth", F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 4), 16, 10).cast("int") % 10)
    words, pieces = token_rollup.count_words(), token_rollup.count_pieces()
    rollup = token_rollup.TokenRollup(spark, shared_folder(spark, "token_rollup"))
    gone = token_rollup.deletes(docs.where("tenth = 0"), "words-1", words)
    rollup.commit("load", token_rollup.inserts(docs, "words-1", words))
    rollup.commit("takedown", gone)
    rollup.commit("recount", token_rollup.revisions(docs.where("tenth between 1 and 5"), ("words-1", words), ("pieces-2", pieces)))
    rollup.commit("takedown", gone)
    rollup.commit("load", token_rollup.inserts(docs, "words-1", words))
    return rollup.totals()


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(documents(spark, sf_dir), n_words=3, percent=90)


def op8_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.ego_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir))


#: Keep and group by the normalised text; DuckDB has no fixed-width classes to escape here, the characters are listed.
_OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS kept, sha256(norm) AS text_sha256
FROM d
"""


_OP5_SQL = r"""
WITH d AS (
  SELECT coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 4)) AS INT) % 10 AS tenth,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^\x20\x09-\x0DA-Za-z0-9]')) AS pieces
  FROM documents
)
SELECT source, lang, CASE WHEN tenth BETWEEN 1 AND 5 THEN 'pieces-2' ELSE 'words-1' END AS tokenizer, count(*) AS docs, CAST(sum(CASE WHEN tenth BETWEEN 1 AND 5 THEN pieces ELSE words END) AS BIGINT) AS tokens
FROM d WHERE tenth <> 0 GROUP BY ALL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_pii_surrogates, op3_suffix_dedup, op4_mixing, op5_token_rollup, op6_language_id, op7_jaccard_join, op8_ego_join, op9_bpe, op10_exact_dedup, op11_spelling, op12_warc, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.license_sql(), "op5_token_rollup": _OP5_SQL, "op4_mixing": mixing.mixing_sql(), "op10_exact_dedup": _OP10_SQL, "op11_spelling": spelling.SPELLING_SQL, "op12_warc": warc.WARC_SQL, "op13_divergence": divergence.DIVERGENCE_SQL}
