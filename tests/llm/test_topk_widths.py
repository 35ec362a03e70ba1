import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import topk


def brute(ids, values, query_ids, queries, k):
    out = []
    for q, query in zip(query_ids.tolist(), queries.tolist(), strict=True):
        scores = [(-sum(a * b for a, b in zip(v, query, strict=True)), i) for i, v in zip(ids.tolist(), values.tolist(), strict=True) if i != q]
        out += [(q, i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("top", [10, 2**20, 2**40, 2**62, 2**63 - 1])
def test_values_of_unequal_width(top):
    r = np.random.default_rng(5)
    values = r.integers(-200, 200, (200, 7))
    values[::9, 3] = r.integers(-top, top, len(values[::9]))
    values[4] = [-(2**63), 2**63 - 1, 0, 1, -1, 5, 9] if top > 2**62 else 0
    ids = r.permutation(200)
    got = list(zip(*(x.tolist() for x in topk.search_block(ids, values, ids[:60], values[:60], 5)), strict=True))
    assert got == brute(ids, values, ids[:60], values[:60], 5)


def test_dimensions_of_unequal_width():
    r = np.random.default_rng(6)
    values = r.integers(0, 256, (500, 8))
    values[:, 2] = values[:, 2] * 300 + 10**6
    ids = np.arange(500)
    got = list(zip(*(x.tolist() for x in topk.search_block(ids, values, ids[:50], values[:50], 5)), strict=True))
    assert got == brute(ids, values, ids[:50], values[:50], 5)


def test_one_wide_value_leaves_few_boundary_rows(sf):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet").to_pydict()
    values, ids = np.floor(256 * np.array(t["embedding"], float)).astype(np.int64), np.array(t["vec_id"])
    values[17, 5] = 256_000 * 256
    parts = topk.indexed(ids, values)
    assert sorted(len(p.ids) for p in parts) == [1, len(ids) - 1]
    left = [sum(len(p.best(int(i), values[ids == i][0], 5)[0]) for p in parts) for i in ids[ids % 50 == 0]]
    assert np.mean(left) <= 0.05 * len(ids)


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 3, 0), (0, 3, 2, -(2**63))]
