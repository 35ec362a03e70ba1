"""The stages of the pipeline against brute force, each on its own input."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from tilewright.llm.common import written

    from .test_operators import linked

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name == pipeline.STAGES[-1][0]:
            assert {r.doc_id for r in out.collect()} == set(before)
            break
        assert out.columns == columns
        out = written(out)
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and after
        if name.startswith("quality"):
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert all((i in after) == (q == 1) for i, q in labels.items())
        if name.startswith("n-gram"):
            assert set(after) == {i for i, (_, c) in linked(sorted(before.items()), 5, 80).items() if i == c}
        docs = out
