"""Blocks of a store: their number grows with the samples of a slide, not with its tiles; older stores keep their blocks."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_store import TILES, state, tile
from tilewright.operators import store


@pytest.mark.parametrize("rings", [True, False])
def test_long_slides_have_few_blocks(spark, tmp_path, rings):
    path, whole = str(tmp_path / "s"), str(tmp_path / "w")
    tiles = [tile("a", x, y, (x, y).__repr__(), 1, 2, 2) for y in range(-3, 600, 3) for x in (0, 2)]
    for p in (path, whole):
        store.create(spark, p, max_levels=2)
    if not rings:  # as written before blocks had several sizes
        file = tmp_path / "s" / "settings.json"
        (tmp_path / "s" / ".settings.json.crc").unlink()
        file.write_text(json.dumps({k: v for k, v in json.loads(file.read_text()).items() if k != "rings"}))
    store.upsert(spark.createDataFrame(tiles[::2] + [tile("a", 0, 300, "old", 1, 2, 2)], TILES), path)
    store.upsert(spark.createDataFrame(tiles[1::2] + [t for t in tiles if t[2:4] == (0, 300)], TILES), path)
    store.upsert(spark.createDataFrame(tiles, TILES), whole)
    got = state(spark, path)
    assert got == state(spark, whole) and sum(k[1] == 0 for k in got[0]) == len(tiles)
    blocks = len(list((tmp_path / "s" / "tiles" / "slide_id=a" / "level=0").iterdir()))
    assert blocks <= 25 if rings else blocks > 70


def test_blocks_are_bounded_and_hold_all_children(spark):
    conf = store.DEFAULTS | {"rings": True}
    df = spark.range(-600, 3000).select(F.col("id").alias("tile_x"), (F.col("id") * 7 % 5000 - 100).alias("tile_y"))
    for w in (1, 16, 512):
        sized = df.select("*", F.lit(w).alias("tile_w"), F.lit(w).alias("tile_h"), F.lit(1).alias("n_channels"))
        found = sized.select("tile_x", "tile_y", store._block("tile_x", "tile_y", conf).alias("b"), *(store._block(F.floor(F.col("tile_x") / 2) * 2 + i, F.floor(F.col("tile_y") / 2) * 2 + j, conf).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1))).collect()
        assert all({r.b} == {r.c00, r.c01, r.c10, r.c11} for r in found)
        spans = {}
        for r in found:
            spans.setdefault(r.b, []).append((r.tile_x, r.tile_y))
        side = max(max(max(c) - min(c) + 1 for c in zip(*at, strict=True)) for at in spans.values())
        assert side <= 8 or side**2 * w * w <= store.BLOCK_SAMPLES
