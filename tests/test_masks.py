"""Scanline masks and cells of polygons against the winding number of every pixel."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilewright.operators import raster, scanline, vector

RINGS = "slide_id string, ann_id int, label int, coords array<struct<ord:int,x:double,y:double>>"


def winding(ring, x, y, exact):
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    if not (min(xs) < x < max(xs) and min(ys) < y < max(ys)) and not (exact and min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)):
        return 0
    n = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        cross = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        cross = cross if exact else math.trunc(cross)
        n += (ay <= y < by and cross > 0) - (by <= y < ay and cross < 0)
    return n


def shapes(whole):
    """Stars, loops that cross themselves, slivers and nearly flat edges, overlapping on two slides."""
    r = random.Random(5)
    out = []
    for i in range(14):
        n, cx, cy = r.choice([3, 4, 7, 12]), r.randrange(-5, 60), r.randrange(-5, 60)
        ring = [(cx + r.uniform(-25, 25), cy + r.uniform(-25, 25)) for _ in range(n)]
        if i % 5 == 0:
            ring = [(cx, cy), (cx + 40, cy + 0.05), (cx + 40, cy + 9), (cx, cy + 8.9)]
        ring = [(round(x), round(y)) for x, y in ring] if whole else ring
        out.append(("ab"[i % 2], i, 1 + i * 5 % 9, [(float(x), float(y)) for x, y in ring]))
    return out


def frame(spark, rings):
    return spark.createDataFrame([(s, a, v, [(i, x, y) for i, (x, y) in enumerate(ring)]) for s, a, v, ring in rings], RINGS)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_masks_by_scanline(spark, whole, exact):
    rings = shapes(whole)
    polygons = frame(spark, rings)
    inside = {(s, a): {(x, y) for x in range(-35, 100) for y in range(-35, 100) if winding(ring, x, y, exact)} for s, a, _, ring in rings}
    best, painted = {}, {}
    order = {3: 0, 1: 1, 6: 2, 2: 3, 7: 4}
    for s, a, label, _ in rings:
        for p in inside[(s, a)]:
            best[(s, *p)] = max(best.get((s, *p), 0), label)
            if label in order:
                painted[(s, *p)] = max(painted.get((s, *p), (-1, -1, 0)), (order[label], a, label))

    def pixels(runs):
        out = {}
        for r in runs.collect():
            for x in range(r.x0, r.x1 + 1):
                assert (r.slide_id, x, r.y) not in out
                out[(r.slide_id, x, r.y)] = r.value
        return out

    assert pixels(scanline.mask_runs(polygons, exact=exact, band=8)) == best
    listed = spark.createDataFrame(list(order.items()), "label int, pos int")
    assert pixels(scanline.mask_runs(polygons, listed, exact)) == {k: v[2] for k, v in painted.items()}
    sizes = spark.createDataFrame([("a", 50, 40), ("b", 20, 60)], "slide_id string, width int, height int")
    tiles = raster.to_pixels(scanline.mask_tiles(polygons, 16, exact=exact, sizes=sizes)).where("value <> 0")
    limit = {"a": (50, 40), "b": (20, 60)}
    assert {(r.slide_id, r.x, r.y): r.value for r in tiles.collect()} == {k: v for k, v in best.items() if 0 <= k[1] < limit[k[0]][0] and 0 <= k[2] < limit[k[0]][1]}


@pytest.mark.parametrize("exact", [True, False])
def test_points_by_cells_of_several_sizes(spark, exact):
    rings = [*shapes(False), ("a", 90, 4, [(-30.0, -30.0), (95.0, -28.0), (90.0, 97.0), (30.0, 40.0), (-31.0, 90.0)])]
    points = spark.createDataFrame([(s, x, y) for s in "ab" for x in range(-35, 100) for y in range(-35, 100)], "slide_id string, x int, y int")
    for rule, odd in (("winding", False), ("evenodd", True)):
        if odd and not exact:
            continue
        got = {tuple(r) for r in vector.points_in_polygons(points, frame(spark, rings), rule, exact, cell=3).select("slide_id", "x", "y", "ann_id").collect()}
        if odd:
            def crossings(ring, x, y):
                return sum((ay <= y < by or by <= y < ay) and x < ax + (y - ay) / (by - ay) * (bx - ax) for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
            want = {(s, x, y, a) for s, a, _, ring in rings for x in range(-35, 100) for y in range(-35, 100) if crossings(ring, x, y) % 2}
        else:
            want = {(s, x, y, a) for s, a, _, ring in rings for x in range(-35, 100) for y in range(-35, 100) if winding(ring, x, y, exact)}
        assert got == want


def test_cells_grow_with_the_border(spark):
    """A polygon of 100,000 pixels a side has 2.4 million cells of 64 pixels in its box."""
    big = frame(spark, [("a", 1, 1, [(10.0, 10.0), (100010.0, 3000.0), (90000.0, 100010.0), (2000.0, 95000.0)])])
    border = vector.border_cells(big, True, 64)
    n = border.count()
    rows = border.groupBy("ann_id", "_cy").agg((F.min("_cx") + 1).alias("_from"), (F.max("_cx") - 1).alias("_to")).where("_from <= _to")
    cells = vector.wide_cells(rows, ["ann_id", "_cy"])
    assert n < 4 * 2 * 1600
    assert cells.count() < 40 * 1600
    # the wide cells of a row are disjoint and fill it
    filled = cells.groupBy("ann_id", "_cy").agg(F.sum(F.pow(F.lit(8.0), F.col("_lvl"))).alias("n")).join(rows, ["ann_id", "_cy"])
    assert filled.where("n <> _to - _from + 1").count() == 0
    points = spark.createDataFrame([(50000, 50000), (5, 5), (99000, 2900), (100, 99000)], "x int, y int")
    assert [tuple(r) for r in vector.points_in_polygons(points, big.drop("slide_id"), exact=True).select("x", "y").collect()] == [(50000, 50000)]
