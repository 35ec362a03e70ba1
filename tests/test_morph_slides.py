"""Distance, boundaries, holes and reconstruction on slides of unequal size, by bands; table functions and checks on tiles."""

import random
from collections import deque

import pytest

from tilewright.operators import morph, tilewise

SIZES = {"a": (23, 17), "b": (5, 30), "c": (9, 1)}


def cells(seed, share):
    r = random.Random(seed)
    return {(s, x, y) for s, (w, h) in SIZES.items() for x in range(w) for y in range(h) if r.random() < share}


def sizes(spark):
    return spark.createDataFrame([(s, w, h) for s, (w, h) in SIZES.items()], "slide_id string, width int, height int")


def frame(spark, found):
    return spark.createDataFrame([(s, x, y, 1.0) for s, x, y in found], "slide_id string, x bigint, y bigint, value double").repartition(3)


@pytest.mark.parametrize("share,band", [(0.01, 4), (0.2, 64)])
def test_distances_cross_bands(spark, share, band, monkeypatch):
    monkeypatch.setattr(morph, "COLUMNS", 7)
    src = cells(4, share) | {("a", 0, 16)}
    got = {(r.slide_id, r.y): list(r.d) for r in morph.distance_lines(frame(spark, src | {("a", 99, 0), ("b", -1, 3)}), sizes(spark), band=band).collect()}
    for s in {s for s, _, _ in src}:
        w, h = SIZES[s]
        for y in range(h):
            assert got[(s, y)] == [min(w + h // 2 + 1, *(abs(x - u) + abs(y - v) for t, u, v in src if t == s)) for x in range(w)] if len([1 for t, *_ in src if t == s]) > 1 else True
    assert {k[0] for k in got} == {s for s, _, _ in src}


def parts(inside, near):
    label, n = {}, 0
    for p in sorted(inside, key=lambda p: (p[1], p[0])):
        if p in label:
            continue
        n += 1
        label[p], todo = n, deque([p])
        while todo:
            x, y = todo.popleft()
            for dx, dy in near:
                q = (x + dx, y + dy)
                if q in inside and q not in label:
                    label[q] = n
                    todo.append(q)
    return label


FOUR = [(1, 0), (-1, 0), (0, 1), (0, -1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


@pytest.mark.parametrize("share", [0.35, 0.6])
def test_boundaries_and_holes(spark, share, monkeypatch):
    monkeypatch.setattr(morph, "BAND", 4)
    found = cells(8, share)
    ring = {("a", x, y) for x in range(3, 12) for y in range(3, 12)} - {("a", x, y) for x in range(4, 11) for y in range(4, 11)}
    found = {c for c in found if not (c[0] == "a" and 2 <= c[1] <= 12 and 2 <= c[2] <= 12)} | ring | {("a", 7, 7)}
    edge, tree = set(), set()
    for s, (w, h) in SIZES.items():
        mine = {(x, y) for t, x, y in found if t == s}
        if not mine:
            continue
        blob = parts(mine, EIGHT)
        back = parts({(x, y) for x in range(-1, w + 1) for y in range(-1, h + 1)} - mine, FOUR)
        edge |= {(s, x, y, n) for (x, y), n in blob.items() if any(back.get((x + dx, y + dy)) == 1 for dx, dy in FOUR)}
        for kind, own, other in (("blob", blob, back), ("hole", back, blob)):
            for n in set(own.values()):
                area = [p for p in own if own[p] == n]
                x, y = min(area, key=lambda p: (p[1], p[0]))
                tree.add((s, kind, n, other.get((x - 1, y)), len(area)))
    assert {tuple(r) for r in morph.outer_boundary(frame(spark, found), sizes(spark)).select("slide_id", "x", "y", "label").collect()} == edge
    got = {tuple(r) for r in morph.containment(frame(spark, found), sizes(spark)).collect()}
    assert got == tree
    inner = next(t for t in got if t[0] == "a" and t[1] == "blob" and t[4] == 1 and t[3] and t[3] > 1)
    assert next(t for t in got if t[:3] == ("a", "hole", inner[3]))[3] is not None


def test_reconstruction_writes_less_each_round(spark):
    """A plateau that starts at the top of one column rises through all bands, one a round; lines beside it are left alone."""
    h, w = 48, 6
    top = {(x, y): 5.0 if x == 0 else 1.0 for x in range(w) for y in range(h)}
    low = {p: 0.0 for p in top} | {(0, 0): 5.0}
    df = lambda cells: spark.createDataFrame([("s", x, y, v) for (x, y), v in cells.items()], "slide_id string, x bigint, y bigint, value double")
    rows = []
    got = {(r.x, r.y): r.value for r in morph.reconstruct(df(low), df(top), band=12, written_rows=rows).collect()}
    assert got == top
    assert rows == [12, 12, 12, 12, 0]


def test_table_function_in_sql(spark):
    tiles = spark.createDataFrame([(7, 0, x, 0, 2, 2, 1, [0.0, 1.0, 2.0, 3.0], "more") for x in range(3)], "slide_id int, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>, other string")
    tiles.createOrReplaceTempView("some_tiles")

    def bright(image, x0, y0):
        return [(int(x + x0), int(y + y0), float(image[y, x, 0])) for y in range(2) for x in range(2) if image[y, x, 0] > 1]

    tilewise.register_tile_function(spark, "bright", bright, "x bigint, y bigint, value double", tilewise.channels(1))
    got = spark.sql("SELECT * FROM bright(TABLE(some_tiles) PARTITION BY slide_id) WHERE x > 1")
    assert got.schema["slide_id"].dataType.simpleString() == "int"
    assert {tuple(r) for r in got.collect()} == {(7, 2 * t + x, 1, 2.0 + x) for t in (1, 2) for x in (0, 1)}
    with pytest.raises(Exception, match="samples"):
        spark.sql("SELECT * FROM bright(TABLE(SELECT slide_id, level FROM some_tiles) PARTITION BY slide_id)").collect()
    tilewise.register_tile_function(spark, "coloured", bright, "x bigint, y bigint, value double", tilewise.channels(3))
    with pytest.raises(Exception, match="1 channels"):
        spark.sql("SELECT * FROM coloured(TABLE(some_tiles) PARTITION BY slide_id)").collect()


def test_tile_functions_check_what_they_get(spark):
    tiles = spark.createDataFrame([(7, 0, 0, 0, 2, 2, 1, [0.0, 1.0, 2.0, 3.0])], "slide_id int, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>")
    assert tilewise.tile_map(tiles, lambda a: a + 1, tilewise.channels(1, 3)).first().slide_id == 7
    for broken in (tilewise.tile_map(tiles, lambda a: a, tilewise.channels(3)), tilewise.tile_map(tiles, lambda a: a[:1]), tilewise.with_halo(tiles, 3)):
        with pytest.raises(Exception, match="refused|became|wider"):
            broken.collect()
    assert list(tilewise.with_halo(tiles, 2).first().samples)[14:16] == [0.0, 1.0]
