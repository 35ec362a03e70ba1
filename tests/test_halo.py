"""Tiles with a halo against arrays: several slides, channels, gaps, narrow last tiles, and batches that cut a tile's strips apart."""

import random

import numpy as np
import pytest

from tilewright.operators import tilewise

TILES = "slide_id string, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>"


@pytest.mark.parametrize("k,rows", [(1, 4), (2, 10000), (3, 7)])
def test_halo_is_what_lies_around(spark, k, rows):
    r = random.Random(k)
    whole, tiles = {}, []
    for slide, wide, high, c in (("a", 5, 6, 1), ("b", 1, 4, 2), (None, 3, 2, 3)):
        # the last column is narrower, as images end inside a tile
        image = np.full((high * 3 + 2 * k, wide * 4 - 1 + 2 * k, c), -7.0)
        for x in range(wide):
            for y in range(high):
                if r.random() < 0.8:
                    w = 3 if x == wide - 1 else 4
                    samples = [float(r.randrange(100)) for _ in range(3 * w * c)]
                    tiles.append((slide, 0, x, y, w, 3, c, samples))
                    image[k + 3 * y : k + 3 * y + 3, k + 4 * x : k + 4 * x + w] = np.reshape(samples, (3, w, c))
        whole[slide] = image
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        wide = tilewise.with_halo(spark.createDataFrame(tiles, TILES), k, -7.0)
        got = {(t.slide_id, t.tile_x, t.tile_y): (t.tile_w, t.tile_h, t.samples) for t in wide.collect()}
        # strips are put together by batches, not by a Python call for each tile
        assert "FlatMapGroupsInPandas" not in wide._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(tiles)
    for slide, _, x, y, w, _, _, _ in tiles:
        part = whole[slide][3 * y : 3 * y + 3 + 2 * k, 4 * x : 4 * x + w + 2 * k]
        assert got[slide, x, y] == (w + 2 * k, 3 + 2 * k, list(part.ravel()))


def test_no_halo_leaves_tiles(spark):
    tiles = spark.createDataFrame([("a", 0, 0, 0, 2, 2, 1, [1.0, 2.0, 3.0, 4.0])], TILES)
    assert tilewise.with_halo(tiles, 0).collect() == tiles.collect()
