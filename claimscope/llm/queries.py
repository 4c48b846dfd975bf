"""The numbered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import alignment, ctw, decontamination, extraction, licenses, packing, quality, simhash, token_files, toxicity, url_filters, warc, whitening
from claimscope.session import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op2_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filters.as_of(url_filters.dated_captures(pages), url_filters.dated_entries(pages))
    return judged.withColumn("fetched_on", F.col("fetched_on").cast("string"))


def op9_tag_path_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op10_feistel_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.materialised(table(spark, sf_dir, "documents"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_simhash_near_duplicates": op2_simhash_near_duplicates,
    "op3_compression_quality": op3_compression_quality,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_context_tree_scoring": op5_context_tree_scoring,
    "op6_compression_toxicity": op6_compression_toxicity,
    "op7_bm25_decontamination": op7_bm25_decontamination,
    "op8_temporal_url_filters": op8_temporal_url_filters,
    "op9_tag_path_extraction": op9_tag_path_extraction,
    "op10_feistel_token_files": op10_feistel_token_files,
    "op11_license_scan": op11_license_scan,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

ORACLES: dict[str, str] = {"op4_warc_round_trip": warc.ORACLE, "op8_temporal_url_filters": url_filters.ORACLE, "op11_license_scan": licenses.ORACLE}
