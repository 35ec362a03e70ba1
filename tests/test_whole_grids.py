"""Grid queries on more tiles than the 500 of the smallest table, the last row of tiles incomplete."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.plans import registry

TILES, WIDTH, HEIGHT = 513, 200, 168


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("wide"))
    value = lambda i: ((F.col("vec_id") * 31 + i * 17) % 97 / 97).cast("float")
    spark.range(TILES).select(F.col("id").alias("vec_id")).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(63)), value).alias("embedding")).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.mark.parametrize("name", ["q_sobel", "q_symmetry"])
def test_dense_queries_give_every_pixel(spark, wide, name):
    got = registry.queries()[name](spark, wide).select("x", "y").agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("cells"), F.max("x").alias("x"), F.max("y").alias("y")).first()
    assert tuple(got) == (WIDTH * HEIGHT, WIDTH * HEIGHT, WIDTH - 1, HEIGHT - 1)


@pytest.mark.parametrize("name", ["q_hmax", "q_nuclei"])
def test_maxima_reach_the_last_row_of_tiles(spark, wide, name):
    assert registry.queries()[name](spark, wide).agg(F.max("y").alias("y")).first().y >= 160


def test_sobel_beyond_the_first_500_tiles(spark, wide):
    value = {}
    for v in range(TILES):
        for i in range(64):
            value[v % 25 * 8 + i % 8, v // 25 * 8 + i // 8] = math.floor(round(float(np.float32((v * 31 + i * 17) % 97 / 97)), 6) * 1000)
    at = lambda x, y: value.get((min(max(x, 0), WIDTH - 1), min(max(y, 0), HEIGHT - 1)), 0)
    got = {(r.x, r.y): (r.gx, r.gy) for r in registry.queries()["q_sobel"](spark, wide).where("y >= 158").collect()}
    assert len(got) == 10 * WIDTH
    for (x, y), (gx, gy) in got.items():
        around = [(dx, dy, at(x + dx, y + dy)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        assert gx == sum(v * dx * (2 - abs(dy)) for dx, dy, v in around) and gy == sum(v * dy * (2 - abs(dx)) for dx, dy, v in around)


def test_pyramid_keeps_all_tiles(spark, wide):
    got = {r.level: r.n for r in registry.queries()["q_pyramid"](spark, wide).groupBy("level").agg(F.count("*").alias("n")).collect()}
    assert got == {k: TILES * 64 // 4**k for k in range(4)}
