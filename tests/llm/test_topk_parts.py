"""Query blocks meet the index without copies: none is broadcast or made for each part, however small Spark thinks them."""

from pyspark.sql import functions as F

from tilewright.llm import topk


def test_queries_are_not_copied_or_broadcast(spark):
    df = spark.range(400).select(F.col("id").alias("vec_id"), F.array(F.col("id") * 1.5, F.col("id") % 7 * 1.0).alias("embedding"))
    plan = topk.top_k(df, F.col("vec_id") % 50 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan and "Generate" not in plan


def test_parts_of_both_sides(spark, monkeypatch):
    monkeypatch.setattr(topk, "PART_QUERIES", 7)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "INDEX_PARTS", 5)
    vectors = {i: [float((i * 37 + d * i * i) % 101 - 50) for d in range(4 if i % 3 else 5)] for i in range(150)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id bigint, embedding array<double>").repartition(6)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 5 == 0, k=4, block_rows=8).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 150, 5):
        scores = sorted((-sum(int(256 * a) * int(256 * b) for a, b in zip(v, vectors[q], strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:4], 1)]
    assert got == want
