import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import morph, raster


def frame(spark, cells):
    return spark.createDataFrame([("s", x, y, float(v)) for (x, y), v in cells.items()], "slide_id string, x bigint, y bigint, value double")


def random_cells(seed, w, h, share):
    r = random.Random(seed)
    return {(x, y): r.choice([1, 2, 3]) for x in range(w) for y in range(h) if r.random() < share}


@pytest.mark.parametrize("neighbours", [4, 8])
def test_components_match_flood_fill(spark, neighbours):
    cells = random_cells(3, 14, 11, 0.5)
    got = {(r.x, r.y): r.label for r in morph.connected_components(frame(spark, cells), 0.5, neighbours).collect()}
    steps = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (-1, -1), (1, -1), (-1, 1)] if neighbours == 8 else [])
    want, n = {}, 0
    for start in sorted(cells, key=lambda p: (p[1], p[0])):
        if start in want:
            continue
        n += 1
        stack = [start]
        while stack:
            p = stack.pop()
            if p in cells and p not in want:
                want[p] = n
                stack += [(p[0] + dx, p[1] + dy) for dx, dy in steps]
    assert got == want


@pytest.mark.parametrize("neighbours", [4, 8])
def test_components_across_bands(spark, monkeypatch, neighbours):
    monkeypatch.setattr(morph, "BAND", 2)
    monkeypatch.setattr(morph, "CELL", 4)
    test_components_match_flood_fill(spark, neighbours)


def test_distance_is_exact_and_capped(spark):
    src = {(3, 2): 1, (9, 7): 1}
    got = {(r.x, r.y): r.d for r in morph.distance_transform(frame(spark, src), (12, 10)).collect()}
    assert len(got) == 120
    assert all(d == min(abs(x - a) + abs(y - b) for a, b in src) for (x, y), d in got.items())
    assert max(r.d for r in morph.distance_transform(frame(spark, src), (12, 10), cap=3).collect()) == 3


def test_reconstruction_and_h_maxima(spark):
    cells = {(x, y): 0.0 for x in range(7) for y in range(5)} | {(1, 1): 5.0, (2, 1): 4.5, (5, 3): 3.0}
    got = {(r.x, r.y) for r in morph.h_maxima(frame(spark, cells), 1.0).collect()}
    assert got == {(1, 1), (5, 3)}


def test_pyramid_of_a_constant_is_constant(spark):
    px = frame(spark, {(x, y): 7 for x in range(16) for y in range(8)})
    got = raster.build_pyramid(px, spark.createDataFrame([("s", 16, 8)], "slide_id string, width int, height int"), 2, 2).groupBy("level").agg(F.min("value").alias("a"), F.max("value").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.level, r.a, r.b, r.n) for r in got} == {(0, 7.0, 7.0, 128), (1, 7.0, 7.0, 32), (2, 7.0, 7.0, 8)}


def test_tiles_round_trip(spark):
    cells = {(x, y): x * 10 + y for x in range(6) for y in range(5)}
    tiles = raster.to_tiles(frame(spark, cells), 4)
    back = {(r.x, r.y): r.value for r in raster.to_pixels(tiles).where("value > 0").collect()}
    assert back == {k: float(v) for k, v in cells.items() if v}


def test_default_threshold_excludes_zero(spark):
    got = {r.x: r.value for r in raster.threshold(frame(spark, {(0, 0): 0, (1, 0): -1, (2, 0): 5})).collect()}
    assert got == {0: 0, 1: 0, 2: 1}


def test_sobel_of_a_ramp(spark):
    px = frame(spark, {(x, y): 2 * x for x in range(6) for y in range(5)})
    got = {(r.x, r.y): (r.gx, r.gy) for r in morph.sobel(px, (6, 5)).collect()}
    assert got[(2, 2)] == (16.0, 0.0) and got[(0, 2)] == (8.0, 0.0)


def test_empty_grid(spark):
    assert morph.connected_components(frame(spark, {(0, 0): 1}).limit(0)).count() == 0


def test_samples_and_spacing(spark):
    tiles = raster.to_tiles(frame(spark, {(1, 2): 9}), 4)
    at = raster.sample_at(F.col("samples"), F.lit(1), F.lit(2), F.lit(0), F.col("tile_w"), F.col("n_channels"))
    assert tiles.select(at.alias("v")).first().v == 9.0
    assert tiles.select(raster.with_sample(F.col("samples"), F.lit(0), F.lit(4.0))[0].alias("v")).first().v == 4.0
    assert raster.patch_min_max(raster.filled(tiles, 2.0)).first().min_value == 2.0
    r = raster.region_with_spacing(raster.read_region(tiles, 0, 0, 4, 4), 0.5, 0.25, 2.0).first()
    assert (r.spacing_x, r.spacing_y, r.min_value, r.max_value) == (1.0, 0.5, 0.0, 9.0)
    assert tiles.select(raster.physical_area(F.lit(8), F.lit(0.5), F.lit(0.5)).alias("a")).first().a == 2.0
