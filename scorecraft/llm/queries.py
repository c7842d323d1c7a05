"""Registered queries of this subpackage, each over its whole table with production parameters, and their SQL.

Operators without SQL here (approximate, sampled, learned or library-defined
results) are tested against brute force, the library or held-out data in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorecraft.llm.block_labeller import extract_text
from scorecraft.llm.common import table
from scorecraft.llm.hard_negatives import hard_negatives, shifted_labels
from scorecraft.llm.imatch import fingerprints
from scorecraft.llm.importance import importance_sample
from scorecraft.llm.jaccard_join import jaccard_classes
from scorecraft.llm.licenses import files_of, scan_licenses
from scorecraft.llm.mixing import mix_sources
from scorecraft.llm.permutation_index import nearest
from scorecraft.llm.pieces import piece_digest
from scorecraft.llm.spelling_variants import spelling_variants
from scorecraft.llm.sql import ORACLE_SQL
from scorecraft.llm.token_counts import token_counts
from scorecraft.llm.topk import top_products
from scorecraft.llm.url_filter import judge_urls


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(files_of(table(spark, sf_dir, "documents")))
    return found.withColumnRenamed("file_id", "doc_id")


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(shifted_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_importance_resampling, op2_piece_dropout, op3_token_counts, op4_license_scan, op5_permutation_index,
    op6_source_mixing, op7_jaccard_join, op8_url_filter, op9_exact_topk, op10_html_extraction, op11_document_fingerprints,
    op12_spelling_variants, op13_hard_negatives)}
SQL: dict[str, str] = ORACLE_SQL
