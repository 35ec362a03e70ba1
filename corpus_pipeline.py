"""A corpus pipeline from raw documents to packed sequences; each stage takes all rows that the one before kept.

Stages: quality classifier, line dedup, near-duplicate removal, mixing to target weights, packing.  Every stage but
the last returns the columns of ``documents``.  Each result is written as Parquet and read again before the next stage;
what a stage has written on its way, and its predecessor's result, is deleted then.

Defined cases of every stage: an empty table gives no rows; columns beyond those of ``documents`` are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm.common import discard, made, table
from tilewright.llm.jaccard import one_of_each_group
from tilewright.llm.lines import without_repeated_lines
from tilewright.llm.mixing import mixed_documents
from tilewright.llm.packing import pack_documents
from tilewright.llm.quality import fit, good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null texts, languages, sources and lengths are scored as such; without labels of both classes nothing is rejected;
    copies and repeated ids are scored one by one.
    """
    return good_documents(docs, fit(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and with them documents that hold nothing else.

    Rows with a null id, null or empty texts and texts without words stay; rows of one id are ordered by the hash of
    their text, and equal rows are one document.
    """
    return without_repeated_lines(docs, length_col="n_chars")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose 5-word shingles are similar by 0.8 or more, the one with the least id stays.

    Rows with a null id, and texts without words, are linked with nothing and stay; rows of one id stay or go together.
    """
    return one_of_each_group(docs, n=5, percent=80)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of all words, shared out over domains, languages and sources by their weights.

    Texts without words and rows with a null id are not chosen; null languages and sources are nodes of their own; ties of
    the seeded order are broken by id and text.
    """
    return mixed_documents(docs, share=0.8)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place.

    A null text is a piece with the end id only; repeated rows are packed as often as they occur.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", mixing_to_weights),
    ("best-fit packing", best_fit_packing),
]

#: SQL cannot express the classifier and the packing; tests/llm holds the stages against brute force and their properties.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, made(spark, partial(stage, spark, docs, sf_dir))
        if i:  # the first one reads the given table
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
