"""The registered queries of the language-model operators, one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import dedup_bytes
from .common import table
from .jaccard import jaccard_components
from .lines import dedup_lines
from .media import to_media
from .mixing import mix
from .oracle import oracle_sql  # noqa: F401
from .packing import pack_documents
from .pages import main_text
from .periods import collapse_runs, planted, run_digests
from .quality import fit, scored
from .simhash import simhash_components
from .substrings import dedup_substrings
from .topk import top_k
from .tries import paths, prefix_trie, shared_heads


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumn("keep", F.col("p_quality") >= 0.5)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"), keep_text=False)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), keep_bytes=False)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_media(table(spark, sf_dir, "documents"), keep_media=False).withColumnRenamed("id", "doc_id")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_mixing_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), share=0.8, epochs=2)


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(collapse_runs(table(spark, sf_dir, "documents"), rebuild=planted))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(paths(table(spark, sf_dir, "conversations"), shared_heads))


def queries() -> dict:
    return {f.__name__: f for f in (op1_exact_top_k, op2_ngram_jaccard_join, op3_quality_classifier, op4_substring_dedup, op5_line_dedup, op6_best_fit_packing, op7_suffix_array_dedup, op8_media_columns, op9_html_extraction, op10_mixing_to_weights, op11_simhash_near_dedup, op12_periodic_runs, op13_conversation_trie)}

