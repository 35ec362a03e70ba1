import math
import random

from pyspark.sql import functions as F

from tilewright.functions import color, geom, text
from tilewright.operators import simplify, vector


def ring(points):
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]


def polygons(spark, rings):
    return spark.createDataFrame([(i, i + 1, ring(r)) for i, r in enumerate(rings)], "ann_id int, label int, coords array<struct<ord:int,x:double,y:double>>")


def winding(p, pts):
    n = 0
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
        side = (bx - ax) * (p[1] - ay) - (p[0] - ax) * (by - ay)
        n += (ay <= p[1] < by and side > 0) - (by <= p[1] < ay and side < 0)
    return n


def test_points_in_polygons(spark):
    rings = [[(2, 2), (30, 4), (20, 25), (9, 17)], [(10, 10), (40, 10), (40, 40), (10, 40)]]
    pts = [(x, y) for x in range(0, 45, 2) for y in range(1, 45, 3)]
    got = {(r.x, r.y, r.ann_id) for r in vector.points_in_polygons(spark.createDataFrame(pts, "x int, y int"), polygons(spark, rings), exact=True, cell=8).collect()}
    assert got == {(x, y, i) for i, r in enumerate(rings) for x, y in pts if winding((x, y), r)}


def test_area_and_orientation(spark):
    r = polygons(spark, [[(0, 0), (4, 0), (4, 3), (0, 3)]]).select(geom.area(F.col("coords")).alias("a"), geom.is_clockwise(F.col("coords")).alias("c")).first()
    assert (r.a, r.c) == (12.0, False) or (r.a, r.c) == (12.0, True)


def test_stitching_joins_open_ends(spark):
    rows = [("f", "g", 0, "", ring([(0, 0), (100, 0)])), ("f", "g", 1, "b", ring([(100, 100), (105, 5)])), ("f", "g", 2, "", ring([(0, 0), (1, 1)]))]
    df = spark.createDataFrame(rows, "file string, group_name string, ord int, name string, coords array<struct<ord:int,x:double,y:double>>")
    got = sorted((r.ord, r.name, [(p.x, p.y) for p in r.coords]) for r in vector.stitch_regions(df).collect())
    assert got == [(0, "b", [(0, 0), (100, 0), (105, 5), (100, 100)]), (2, "", [(0, 0), (1, 1)])]


def series(spark, pts):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "key bigint, ord int, x double, y double")


def dp(p, tol):
    if len(p) < 3:
        return p
    d, k = max((simplify._segment(p[0], p[-1], p[i]), -i) for i in range(1, len(p) - 1))
    return [p[0], p[-1]] if d <= tol * tol else dp(p[: -k + 1], tol)[:-1] + dp(p[-k:], tol)


def test_douglas_peucker_matches_recursion(spark):
    r = random.Random(5)
    pts = [(i, 10 * math.sin(i / 5) + r.random()) for i in range(60)]
    got = [(q.x, q.y) for q in simplify.douglas_peucker(series(spark, pts), 1.5, radial=False).orderBy("ord").collect()]
    assert got == [(float(x), float(y)) for x, y in dp(pts, 1.5)]


def test_simplifiers_keep_ends_and_order(spark):
    r = random.Random(6)
    pts = [(i, r.random() * 8) for i in range(40)]
    s = series(spark, pts)
    for out in (simplify.radial_distance(s, 3.0), simplify.perpendicular_distance(s, 2.0), simplify.reumann_witkam(s, 2.0), simplify.opheim(s, 2.0, 9.0), simplify.lang(s, 2.0, 5), simplify.douglas_peucker(s, 2.0), simplify.nth_point(s, 7)):
        ords = [q.ord for q in out.orderBy("ord").collect()]
        assert ords[0] == 0 and ords[-1] == 39 and len(set(ords)) == len(ords) < 40
    assert simplify.douglas_peucker_n(s, 9).count() == 9
    assert simplify.simplify(s, eps=0.0).count() == 40


def test_radial_pass(spark):
    pts = [(0, 0), (1, 0), (3, 0), (3.5, 0), (9, 0), (9.1, 0)]
    got = [q.x for q in simplify.radial_distance(series(spark, pts), 2.0).orderBy("ord").collect()]
    assert got == [0, 3, 9, 9.1]


def test_stain_matrix_inverts():
    q = color.stain_matrix()
    rows = [list(color.HE[0]), list(color.HE[1])]
    for i, v in enumerate(rows):
        n = math.sqrt(sum(c * c for c in v))
        amounts = [sum(q[3 * k + c] * v[c] / n for c in range(3)) for k in range(3)]
        assert all(abs(a - (k == i)) < 1e-9 for k, a in enumerate(amounts))


def test_escape_twice_fails(spark):
    df = spark.createDataFrame([("a#b",)], "s string")
    once = df.select(text.escape_char(F.col("s"), "#").alias("s"))
    assert once.first().s == "a&#35;b"
    try:
        once.select(text.escape_char(F.col("s"), "#")).collect()
    except Exception as e:
        assert "already escaped" in str(e)
    else:
        raise AssertionError


def test_closure_and_cascade(spark):
    groups = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c"), ("z", None)], "name string, parent_name string")
    got = {(r.ancestor, r.name) for r in vector.closure(groups).collect()}
    assert ("a", "d") in got and ("a", "a") in got and ("z", "a") not in got and len(got) == 11
    anns = spark.createDataFrame([(1, "d"), (2, "z")], "ann_id int, group_name string")
    left, kept = vector.drop_groups(anns, groups, spark.createDataFrame([("b",)], "name string"))
    assert [r.ann_id for r in left.collect()] == [2] and {r.name for r in kept.collect()} == {"a", "z"}


def test_number_texts_round_the_binary_value(spark):
    r = random.Random(3)
    values = [0.0, 0.5, 1.5, 2.5, 0.15, 0.25, 70266.25, 70035.45, 1e-9, 0.005, 0.015, 9.995, 99.9999, -0.125, -3.375, 123456789.125, 0.1 + 0.2] + [r.uniform(-1000, 1000) for _ in range(300)] + [r.randrange(10**6) / 10**4 for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for p in (0, 1, 2, 3, 6):
        got = df.select("v", text.number_text(F.col("v"), p).alias("t")).collect()
        assert all(x.t == f"{x.v:.{p}f}" for x in got)


def test_labels_round_by_the_value_itself(spark):
    """5.015 is stored as a little less, so it has 5.01 beside it and not 5.02."""
    values = [5015000.0, 5025000.0, 1000001.0, 1.005, 0.125]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(geom.area_text(F.col("v")).alias("t")).collect()]
    want = lambda v: f"{math.floor(v * 100 + 0.5) / 100}"
    assert got == [f"{want(v / 1e6)} mm2" if v > 1e6 else f"{want(v)} um2" for v in values] and got[0] == "5.01 mm2"
    length = spark.createDataFrame([(5015.0,)], "v double").select(geom.measure_text(F.col("v")).alias("t")).first().t
    assert length == "5.01 mm"
