"""The rows that decide common windows step by step come in an order that a retry repeats."""

import pytest
from pyspark.sql import functions as F

from tilewright.llm import columns, repeats, substrings


@pytest.mark.parametrize("dedup", [substrings.dedup_substrings, columns.dedup_bytes])
def test_contexts_read_rows_in_order(spark, monkeypatch, dedup):
    seen, contexts = [], repeats.contexts
    monkeypatch.setattr(repeats, "contexts", lambda df, rule: (seen.append(df), contexts(df, rule))[1])
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.repeat(F.lit("common words "), 60)).alias("text"))
    dedup(docs.orderBy(F.desc("doc_id")), fit=1)
    rows = seen[0].select(F.spark_partition_id().alias("p"), "doc_id").collect()
    parts = {p: [r.doc_id for r in rows if r.p == p] for p in {r.p for r in rows}}
    assert len(rows) == 400 and all(ids == sorted(ids) for ids in parts.values())
