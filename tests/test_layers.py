"""Several slides, levels and channels; stores; mixed folders of annotation files; nuclei and stitching by value."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import catalog, morph, overlay, packed, raster, vector
from tilewright.plans import iterate
from tilewright.sources import annotations

from .test_sources import NATIVE, NDPA

TILES = "slide_id string, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>"


def layered(spark):
    """Two slides with two levels of 4 x 4 tiles and two channels; the value tells slide, level, place and channel."""
    rows = []
    for slide in (0, 1):
        for level, n in ((0, 2), (1, 1)):
            for ty in range(n):
                for tx in range(n):
                    samples = [1000.0 * slide + 500 * level + 10 * (tx * 4 + x) + (ty * 4 + y) + 0.5 * c for y in range(4) for x in range(4) for c in range(2)]
                    rows.append((f"s{slide}", level, tx, ty, 4, 4, 2, samples))
    return spark.createDataFrame(rows, TILES)


def test_retile_keeps_levels_and_channels(spark):
    tiles = layered(spark)
    want = {tuple(r) for r in raster.to_pixels(tiles).collect()}
    again = packed.retiled(packed.retiled(tiles, 3), 4)
    got = {tuple(r) for r in raster.to_pixels(again).where("x < 8 and y < 8 and (level = 0 or (x < 4 and y < 4))").collect()}
    assert got == want


def test_large_tiles_are_linear(spark):
    px = spark.range(512 * 512).select(F.lit("s").alias("slide_id"), (F.col("id") % 512).alias("x"), F.expr("id div 512").alias("y"), F.col("id").alias("value"))
    began = time.time()
    tile = raster.to_tiles(px, 512).first()
    assert list(tile.samples) == list(range(512 * 512)) and time.time() - began < 60


def test_patches_of_levels_and_channels(spark):
    asked = spark.createDataFrame([(1, "s0", 0, 3, 2, 3, 2), (2, "s1", 1, 2, 1, 4, 1), (3, "s0", 1, 9, 9, 1, 1)], "request int, slide_id string, level int, x0 int, y0 int, w int, h int")
    got = {(r.request, r.x, r.y, r.c): r.value for r in raster.extract_patches(layered(spark), asked).collect()}
    want = {(1, x, y, c): 10.0 * x + y + 0.5 * c for x in (3, 4, 5) for y in (2, 3) for c in (0, 1)}
    want |= {(2, x, 1, c): 1500.0 + 10 * x + 1 + 0.5 * c for x in (2, 3) for c in (0, 1)}
    assert got == want
    arrays = {r.request: (r.w, r.h, r.n_channels, list(r.samples)) for r in raster.patch_arrays(layered(spark), asked, fill=255.0).collect()}
    assert arrays[2] == (4, 1, 2, [1521.0, 1521.5, 1531.0, 1531.5, 255, 255, 255, 255]) and arrays[3] == (1, 1, 2, [255, 255])


def test_slides_stay_apart(spark):
    ring = [(0, 0.0, 0.0), (1, 9.0, 0.0), (2, 9.0, 9.0), (3, 0.0, 9.0)]
    polygons = spark.createDataFrame([("a", 1, 3, ring), ("b", 2, 5, [(i, x + 4, y) for i, x, y in ring])], "slide_id string, ann_id int, label int, coords array<struct<ord:int,x:double,y:double>>")
    points = spark.createDataFrame([(s, x, 4) for s in "ab" for x in range(15)], "slide_id string, x int, y int")
    for exact in (False, True):
        got = {(r.slide_id, r.x): r.value for r in vector.rasterize(points, polygons, exact=exact).collect()}
        inside = {("a", x): 3 for x in range(1, 9)} | {("b", x): 5 for x in range(5, 13)}
        assert {k: v for k, v in got.items() if k in inside} == inside and len(got) <= len(inside) + 2


def test_exact_cells_agree_with_tests_of_each_point(spark):
    star = [(i, 50 + (45 if i % 2 else 12) * math.cos(i * 0.6283), 50 + (45 if i % 2 else 12) * math.sin(i * 0.6283)) for i in range(10)]
    polygons = spark.createDataFrame([(1, star)], "ann_id int, coords array<struct<ord:int,x:double,y:double>>")
    points = spark.range(10000).select((F.col("id") % 100).cast("double").alias("x"), F.expr("id div 100").cast("double").alias("y"))
    small = {(r.x, r.y) for r in vector.points_in_polygons(points, polygons, exact=True, cell=4).collect()}
    large = {(r.x, r.y) for r in vector.points_in_polygons(points, polygons, exact=True, cell=1000).collect()}
    assert small == large and len(small) > 500


def test_closure_on_slides_and_cycles(spark):
    groups = spark.createDataFrame([("a", "x", None), ("a", "y", "x"), ("a", "z", "y"), ("b", "x", None), ("b", "y", None), ("c", "p", "q"), ("c", "q", "p"), ("c", "r", "gone")], "slide_id string, name string, parent_name string")
    got = {tuple(r) for r in vector.closure(groups).collect()}
    assert got == {("a", "x", "x"), ("a", "x", "y"), ("a", "x", "z"), ("a", "y", "y"), ("a", "y", "z"), ("a", "z", "z"), ("b", "x", "x"), ("b", "y", "y"), ("c", "p", "p"), ("c", "p", "q"), ("c", "q", "q"), ("c", "q", "p"), ("c", "r", "r")}


SCOPE = '<?xml version="1.0"?><Annotations MicronsPerPixel="0.5"><Annotation Id="3" Name="" LineColor="255"><Regions><Region Id="1" Text="p"><Vertices><Vertex X="0" Y="0"/><Vertex X="100" Y="0"/></Vertices></Region><Region Id="2" Text="q"><Vertices><Vertex X="0" Y="5"/><Vertex X="100" Y="5"/></Vertices></Region></Regions></Annotation></Annotations>'


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "one.xml").write_text(NATIVE.format(g="g"))
    (tmp_path / "two.xml").write_text(SCOPE)
    (tmp_path / "three.ndpa").write_text(NDPA)
    slides = spark.createDataFrame([("three", 100.0, 100.0, 0.5, 0.5, 200.0, 100.0)], "slide_id string, offset_x double, offset_y double, mpp_x double, mpp_y double, width double, height double")
    anns, groups = annotations.read_annotations(spark, str(tmp_path), slides)
    got = {(r.slide_id, r.name, r.group_name): len(r.coords) for r in anns.collect()}
    assert got == {("one", "a", "g"): 2, ("two", "p", "Annotation 3"): 4, ("three", "t_0", None): 2}
    assert {(r.slide_id, r.name) for r in groups.collect()} == {("one", "g"), ("two", "Annotation 3")}
    with pytest.raises(ValueError):
        annotations.read_annotations(spark, str(tmp_path))


def test_stitching_order_and_reversal(spark):
    part = lambda *xs: [(i, float(x), 0.0) for i, x in enumerate(xs)]
    rows = [("f", "g", 0, "", part(0, 50)), ("f", "g", 1, "closed", part(7, 7)), ("f", "g", 2, "n", part(90, 52)), ("f", "g", 3, "far", part(500, 600)), ("f", "g", 4, "", part(-60, -2)), ("f", "h", 0, "x", part(51, 99))]
    df = spark.createDataFrame(rows, "file string, group_name string, ord int, name string, coords array<struct<ord:int,x:double,y:double>>")
    got = {(r.group_name, r.ord): (r.name, [p.x for p in r.coords]) for r in vector.stitch_regions(df, 5.0).collect()}
    assert got == {("g", 0): ("n", [-60, -2, 0, 50, 52, 90]), ("g", 1): ("closed", [7, 7]), ("g", 3): ("far", [500, 600]), ("h", 0): ("x", [51, 99])}


def test_reconstruction_crosses_long_plateaus(spark):
    # a winding corridor of more than 1,000 pixels, over several bands of lines
    corridor = [(x, y) for y in range(0, 60, 2) for x in (range(40) if y % 4 == 0 else range(39, -1, -1))]
    corridor += [(39 if y % 4 == 0 else 0, y + 1) for y in range(0, 58, 2)]
    mask = spark.createDataFrame([("s", x, y, 5.0 if (x, y) in set(corridor) else 1.0) for x in range(40) for y in range(60)], "slide_id string, x bigint, y bigint, value double")
    marker = mask.withColumn("value", F.when((F.col("x") == 0) & (F.col("y") == 0), 4.0).otherwise(0.0))
    got = {(r.x, r.y): r.value for r in morph.reconstruct(marker, mask, band=8).collect()}
    assert all(got[p] == 4.0 for p in corridor) and all(v == 1.0 for p, v in got.items() if p not in set(corridor))


def nuclei_by_numpy(image, radii, h, alpha, beta):
    """The whole chain with arrays: gradients, votes, blurred maps, h-maxima, outer boundaries, centres."""
    height, width = image.shape
    pad = np.pad(image, 1, mode="symmetric")
    shift = lambda dy, dx: pad[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width]
    gx = sum(shift(dy, dx) * dx * (2 - abs(dy)) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    gy = sum(shift(dy, dx) * dy * (2 - abs(dx)) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    mag = np.hypot(gx, gy)
    total = np.zeros_like(image)
    for r in radii:
        votes = np.zeros_like(image)
        for y in range(height):
            for x in range(width):
                if mag[y, x] > 0 and mag[y, x] >= beta * mag.max():
                    tx, ty = x + math.floor(0.5 + r * gx[y, x] / mag[y, x]), y + math.floor(0.5 + r * gy[y, x] / mag[y, x])
                    votes[min(max(ty, 0), height - 1), min(max(tx, 0), width - 1)] += 1
        f = (np.minimum(votes, 9.9) / 9.9) ** alpha
        size = int(r) + 1 if int(r) % 2 == 0 else int(r)
        line = np.exp(-((np.arange(size) - (size - 1) / 2) ** 2) / (2 * (size / 4) ** 2))
        line /= line.sum()
        wide = np.pad(f, size // 2, mode="symmetric")
        total += sum(line[i] * line[j] * wide[i : i + height, j : j + width] for i in range(size) for j in range(size))
    value = total / len(radii)
    low = value - h
    while True:
        wide = np.pad(low, 1, constant_values=-np.inf)
        new = np.minimum(value, np.maximum.reduce([wide[1 + dy : 1 + dy + height, 1 + dx : 1 + dx + width] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
        if np.array_equal(new, low):
            break
        low = new
    top = value - low >= h - 1e-12
    label, n = np.zeros(image.shape, int), 0
    for y in range(height):
        for x in range(width):
            if top[y, x] and not label[y, x]:
                n += 1
                stack = [(y, x)]
                while stack:
                    a, b = stack.pop()
                    if 0 <= a < height and 0 <= b < width and top[a, b] and not label[a, b]:
                        label[a, b] = n
                        stack += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    outside, stack = set(), [(-1, -1)]
    while stack:
        p = stack.pop()
        if p in outside or not (-1 <= p[0] <= height and -1 <= p[1] <= width):
            continue
        if 0 <= p[0] < height and 0 <= p[1] < width and top[p]:
            continue
        outside.add(p)
        stack += [(p[0] + i, p[1] + j) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    edge: dict = {}
    for y, x in zip(*np.nonzero(label)):
        if any((y + i, x + j) in outside for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))):
            edge.setdefault(label[y, x], []).append((x, y))
    return {k: tuple(np.mean(v, axis=0).round(6)) for k, v in edge.items()}


def test_nuclei_by_value(spark):
    rng = np.random.default_rng(4)
    image = 0.05 * rng.random((34, 40))
    for cy, cx in ((8, 9), (20, 28), (25, 10)):
        y, x = np.mgrid[0:34, 0:40]
        image += np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 8)
    df = spark.createDataFrame([("s", x, y, float(image[y, x])) for y in range(34) for x in range(40)], "slide_id string, x bigint, y bigint, value double")
    got = {r.label: (round(r.x, 6), round(r.y, 6)) for r in morph.detect_nuclei(df, (40, 34), h=0.1, beta=0.05, radii=(2.0, 4.0, 1.0)).collect()}
    assert got == nuclei_by_numpy(image, [2.0, 3.0, 4.0], 0.1, 2.0, 0.05) and len(got) >= 3
    tiled = morph.radial_symmetry(df, [2.0], 2.0, 0.05, (40, 34), tile=16).agg(F.sum("value")).first()[0]
    assert tiled > morph.radial_symmetry(df, [2.0], 2.0, 0.05, (40, 34)).agg(F.sum("value")).first()[0]


def test_labels_by_name_and_lookup_table(spark):
    anns = spark.createDataFrame([("a", "n1", "g1"), ("a", "n2", None), ("b", "g1", None), ("b", "zz", None)], "slide_id string, name string, group_name string")
    groups = spark.createDataFrame([("a", "g1")], "slide_id string, name string")
    labels = spark.createDataFrame([("g1", 7)], "name string, label int")
    assert {(r.slide_id, r.name, r.label) for r in vector.named_labels(anns, labels, groups).collect()} == {("a", "n1", 7), ("b", "g1", 7), ("b", "zz", 0)}
    assert {r.label for r in vector.named_labels(anns, None).collect()} == {1}
    assert len(overlay.LUTS["Label"][1]) == 30
    assert catalog.full_frames(spark.createDataFrame([("s", 300, 200)], "slide_id string, width int, height int"), 128).count() == 6


def test_scratch_needs_a_shared_folder_on_clusters():
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        iterate.scratch(Session())
