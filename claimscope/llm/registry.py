"""Registered queries of this package: one thin query for each operator, and the DuckDB counterparts."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimscope.llm import bpe, centroids, jaccard, langid, licenses, linededup, merkle, packing, quality, secrets, topk, windows, wrappers
from claimscope.llm.shared import read


def op1_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.embedding_search(read(spark, folder, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.links(read(spark, folder, "documents"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(read(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed_digests(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip_digests(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_text(read(spark, folder, "pages"))


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(read(spark, folder, "documents"))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_report(read(spark, folder, "documents"))


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_report(read(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.dedup_report(read(spark, folder, "documents"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster_report(read(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return windows.window_report(read(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest_report(read(spark, folder, "documents"))


QUERIES = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_html_extraction": op6_html_extraction,
    "op7_license_scan": op7_license_scan,
    "op8_secret_scan": op8_secret_scan,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op1_exact_top_k": """
        WITH v AS (
            SELECT CAST(vec_id AS BIGINT) id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.id query_id, c.id vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) score
            FROM v q JOIN v c ON c.id <> q.id AND len(c.v) = len(q.v) WHERE q.id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY rank <= 10""",
    "op2_ngram_jaccard_join": jaccard.ORACLE,
    "op7_license_scan": licenses.oracle(),
    "op10_line_dedup": linededup.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op12_substring_dedup": windows.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
