"""Queries over the driver's tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import dartminhash, decontam, htmltext, langid, lexical, licenses, linededup, media, mixing, quality, tokens, triejoin, whitening
from palimpsest.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_language(spark, table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return done.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), kept.alias("kept_sha256"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store(spark, table(spark, sf_dir, "documents"), media=False)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(spark, table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 9))


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents have no paths; each gets one of source, thousand and fifty of its id."""
    path = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 50), F.col("doc_id"))
    return licenses.scan(spark, table(spark, sf_dir, "documents"), path)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.similar_sets(spark, table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_benchmark_decontamination, op3_line_dedup, op4_media_columns, op5_html_extraction, op6_source_mixing, op7_token_counts, op8_license_scan, op9_quality_classifier, op10_minhash_near_dedup, op11_ngram_jaccard_join, op12_embedding_whitening, op13_ranked_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_source_mixing": mixing.oracle(),
        "op11_ngram_jaccard_join": triejoin.oracle(),
        "op13_ranked_lexical_search": lexical.oracle(),
        "op3_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
    FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i)
), keyed AS (
    SELECT doc_id, i, line,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), frequent AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT k.doc_id, k.i, k.line, f.key IS NULL OR f.keeper = k.doc_id AS stays FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
    }
