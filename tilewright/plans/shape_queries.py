"""Queries on annotations, polygons, polylines and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, geom
from ..operators import overlay, raster, simplify, vector
from . import fixtures as fx
from . import simplify_sql
from .fixtures import CORNERS, GRID, RGB, SERIES, SIDE, VERTICES

B = "bigint"


def q_area(s, d):
    return fx.rings(s, d).select("ring", F.round(geom.area(F.col("coords")), 4).alias("area"))


NEXT = f"SELECT ring, ord, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ({VERTICES}) WINDOW w AS (PARTITION BY ring ORDER BY ord)"


def q_orientation(s, d):
    return fx.rings(s, d).select("ring", geom.is_clockwise(F.col("coords")).alias("cw"), geom.at(geom.clockwise(F.col("coords")), 0)["x"].alias("first_x"))


def q_bbox(s, d):
    b, c = geom.bbox(F.col("coords")), geom.center(F.col("coords"))
    m = geom.centered_bbox(F.col("coords"))
    return fx.rings(s, d).select("ring", b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1"), c["x"].alias("cx"), c["y"].alias("cy"), m["x0"].alias("left"), geom.n_points(F.col("coords")).cast(B).alias("n"))


def q_vertex_edits(s, d):
    c = F.col("coords")
    new = F.struct(F.lit(99).alias("ord"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    x = lambda a: F.aggregate(F.transform(a, lambda p, i: p["x"] * (i + 1)), F.lit(0.0), lambda t, v: t + v)
    return fx.rings(s, d).where(F.size(c) >= 3).select("ring", geom.at(c, 1)["x"].alias("second"), geom.at(c, -1)["x"].alias("last"), x(geom.inserted_at(c, 1, new)).alias("inserted"), x(geom.removed_at(c, -1)).alias("removed"))


EDITS = f"WITH v AS ({VERTICES}), n AS (SELECT ring, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 3) SELECT v.ring, max(CASE WHEN ord = 1 THEN x END) AS second, max(CASE WHEN ord = n - 1 THEN x END) AS last, sum(CASE WHEN ord = 0 THEN x ELSE x * (ord + 2) END) + 2.0 AS inserted, sum(CASE WHEN ord < n - 1 THEN x * (ord + 1) ELSE 0 END) AS removed FROM v JOIN n ON v.ring = n.ring GROUP BY 1"


def _pixels(s, d):
    return fx.grid(s, d).select("slide_id", "x", "y")


PIXELS = f"SELECT slide_id, x, y FROM ({GRID})"
EDGES = f"SELECT slide_id, ann_id, label, x AS ax, y AS ay, coalesce(lead(x) OVER w, first_value(x) OVER w) AS bx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS by_, min(x) OVER p AS x0, max(x) OVER p AS x1, min(y) OVER p AS y0, max(y) OVER p AS y1 FROM ({CORNERS}) WINDOW w AS (PARTITION BY ann_id ORDER BY ord), p AS (PARTITION BY ann_id)"
INSIDE = f"SELECT g.slide_id, g.x, g.y, e.ann_id, e.label FROM ({PIXELS}) g JOIN ({EDGES}) e ON g.slide_id = e.slide_id AND g.x > e.x0 AND g.x < e.x1 AND g.y > e.y0 AND g.y < e.y1 GROUP BY 1, 2, 3, 4, 5 HAVING sum(CASE WHEN ay <= g.y AND by_ > g.y AND (bx - ax) * (g.y - ay) - (g.x - ax) * (by_ - ay) > 0 THEN 1 WHEN ay > g.y AND by_ <= g.y AND (bx - ax) * (g.y - ay) - (g.x - ax) * (by_ - ay) < 0 THEN -1 ELSE 0 END) <> 0"


def q_pip(s, d):
    return vector.points_in_polygons(_pixels(s, d), fx.polygons(s, d), cell=32).select("slide_id", "x", "y", "ann_id")


def q_pip_evenodd(s, d):
    return vector.points_in_polygons(_pixels(s, d), fx.polygons(s, d), rule="evenodd", cell=32).groupBy("ann_id").agg(F.count(F.lit(1)).alias("n"))


EVENODD = f"SELECT ann_id, count(*) AS n FROM (SELECT g.slide_id, g.x, g.y, e.ann_id FROM ({PIXELS}) g JOIN ({EDGES}) e ON g.slide_id = e.slide_id AND g.x > e.x0 AND g.x < e.x1 AND g.y > e.y0 AND g.y < e.y1 WHERE (ay <= g.y) <> (by_ <= g.y) AND g.x < ax + (g.y - ay) / CAST(by_ - ay AS DOUBLE) * (bx - ax) GROUP BY 1, 2, 3, 4 HAVING count(*) % 2 = 1) GROUP BY 1"


def q_mask(s, d):
    return vector.rasterize(_pixels(s, d), fx.polygons(s, d))


def q_mask_order(s, d):
    order = fx.table(s, d, "nation").where("n_nationkey % 3 <> 1").select((F.col("n_nationkey") + 1).cast(B).alias("label"), (F.col("n_nationkey") * 7 % 25).alias("pos"))
    return vector.rasterize(_pixels(s, d), fx.polygons(s, d), order)


def q_edges(s, d):
    e = vector.edges(fx.polygons(s, d), "label")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.sqrt(geom.dist2(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))), 4).alias("length"))


def _tree(s, d):
    r = fx.table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"), F.lit("root").alias("parent_name"))
    n = fx.table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_name"))
    top = r.limit(1).select(F.lit("root").alias("name"), F.lit(None).cast("string").alias("parent_name"))
    return r.unionByName(n).unionByName(top)


def _members(s, d):
    return fx.polygons(s, d).drop("slide_id").withColumn("group_name", F.concat(F.lit("n"), F.col("nation").cast("string")))


TREE = "SELECT 'r' || r_regionkey AS name, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'root', NULL"
CLOSURE = f"WITH RECURSIVE t AS ({TREE}), c(name, ancestor) AS (SELECT name, name FROM t UNION ALL SELECT c.name, t.parent FROM c JOIN t ON t.name = c.ancestor WHERE t.parent IS NOT NULL)"
MEMBERS = f"SELECT 'n' || nation AS name, ann_id, 0.5 * ((2 * hx) + (2 * hx + 2)) * 2 * hy AS area, 4 AS n, cx - hx AS x0, cy - hy AS y0, cx + hx + 2 AS x1, cy + hy AS y1 FROM ({fx.BOXES})"


def q_group_rollup(s, d):
    g = vector.group_rollup(_members(s, d), _tree(s, d))
    return g.select("name", F.round("area", 4).alias("area"), F.col("n_points").cast(B).alias("n_points"), "x0", "y0", "x1", "y1", "center_x", "center_y")


ROLLUP = CLOSURE + f" SELECT c.ancestor AS name, CAST(round(sum(area), 4) AS DOUBLE) AS area, CAST(sum(n) AS BIGINT) AS n_points, CAST(min(x0) AS DOUBLE) AS x0, CAST(min(y0) AS DOUBLE) AS y0, CAST(max(x1) AS DOUBLE) AS x1, CAST(max(y1) AS DOUBLE) AS y1, (min(x0) + max(x1)) / 2.0 AS center_x, (min(y0) + max(y1)) / 2.0 AS center_y FROM ({MEMBERS}) m JOIN c ON c.name = m.name GROUP BY 1"


def _slide_trees(s, d):
    slides = fx.grid(s, d).select("slide_id").distinct()
    tree = _tree(s, d)
    # on slide 'R' the nations of region 0 hang below the root directly
    moved = F.when((F.col("slide_id") == "R") & (F.col("parent_name") == "r0"), "root").otherwise(F.col("parent_name"))
    return slides.join(tree).withColumn("parent_name", moved)


def _slide_members(s, d):
    return fx.polygons(s, d).withColumn("group_name", F.concat(F.lit("n"), F.col("nation").cast("string")))


SLIDE_TREE = f"SELECT slide_id, name, CASE WHEN slide_id = 'R' AND parent = 'r0' THEN 'root' ELSE parent END AS parent FROM ({TREE}), (SELECT DISTINCT slide_id FROM ({GRID}))"
SLIDE_CLOSURE = f"WITH RECURSIVE t AS ({SLIDE_TREE}), c(slide_id, name, ancestor) AS (SELECT slide_id, name, name FROM t UNION ALL SELECT c.slide_id, c.name, t.parent FROM c JOIN t ON t.slide_id = c.slide_id AND t.name = c.ancestor WHERE t.parent IS NOT NULL)"
SLIDE_MEMBERS = f"SELECT slide_id, 'n' || nation AS name, ann_id, 0.5 * ((2 * hx) + (2 * hx + 2)) * 2 * hy AS area, cx - hx AS x0 FROM ({fx.BOXES})"


def q_group_rollup_slides(s, d):
    g = vector.group_rollup(_slide_members(s, d), _slide_trees(s, d))
    return g.select("slide_id", "name", F.round("area", 4).alias("area"), F.col("n_points").cast(B).alias("n_points"), "x0")


def q_cascade_delete_slides(s, d):
    names = s.range(1).select(F.lit("N").alias("slide_id"), F.lit("r1").alias("name")).unionByName(s.range(1).select(F.lit("R").alias("slide_id"), F.lit("r0").alias("name")))
    return vector.drop_groups(_slide_members(s, d), _slide_trees(s, d), names)[0].select("slide_id", "ann_id")


def _named(s, d):
    c = fx.table(s, d, "customer")
    a = c.select((F.col("c_custkey") % 40).cast("string").alias("slide_id"), F.col("c_custkey").alias("ann_id"), F.concat(F.lit("g"), (F.col("c_custkey") % 7).cast("string")).alias("name"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("g"), (F.col("c_custkey") % 11).cast("string"))).alias("group_name"))
    groups = c.where("c_custkey % 40 < 25").select((F.col("c_custkey") % 40).cast("string").alias("slide_id"), F.concat(F.lit("g"), (F.col("c_custkey") % 11).cast("string")).alias("name")).distinct()
    labels = fx.table(s, d, "region").select(F.concat(F.lit("g"), F.col("r_regionkey").cast("string")).alias("name"), (F.col("r_regionkey") * 10 + 1).cast(B).alias("label"))
    return a, labels, groups


def q_named_labels(s, d):
    return vector.named_labels(*_named(s, d)).select("slide_id", "ann_id", F.col("label").cast(B).alias("label"))


NAMED = "WITH a AS (SELECT c_custkey % 40 AS k, c_custkey AS ann_id, 'g' || (c_custkey % 7) AS name, CASE WHEN c_custkey % 5 > 0 THEN 'g' || (c_custkey % 11) END AS group_name FROM customer) SELECT CAST(k AS VARCHAR) AS slide_id, ann_id, CAST(coalesce(r_regionkey * 10 + 1, 0) AS BIGINT) AS label FROM a LEFT JOIN region ON 'g' || r_regionkey = CASE WHEN k < 25 THEN group_name ELSE name END WHERE k >= 25 OR group_name IS NOT NULL"


def q_without(s, d):
    listed = _listed(s, d)
    kept = vector.without(vector.without(listed, vector.by_name(listed, "BUILDING")), vector.by_index(listed, -1))
    return kept.groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"), F.sum("ord").alias("ords"))


WITHOUT = "WITH a AS (SELECT c_nationkey, min(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1) SELECT CAST(c.c_nationkey AS BIGINT) AS slide_id, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ords FROM customer c JOIN a ON a.c_nationkey = c.c_nationkey WHERE c_custkey <> hi AND c_custkey IS DISTINCT FROM lo GROUP BY 1"


def q_cascade_delete(s, d):
    names = fx.table(s, d, "region").where("r_regionkey in (1, 3)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("name"))
    return vector.drop_groups(_members(s, d), _tree(s, d), names)[0].select("ann_id", "group_name")


def q_move_members(s, d):
    moves = fx.table(s, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("ann_id"), F.lit("moved").alias("new_group"))
    return vector.move_members(_members(s, d), moves).groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))


def q_replace_all(s, d):
    old = fx.table(s, d, "customer").select(F.col("c_nationkey").cast(B).alias("slide_id"), F.col("c_custkey").alias("ann_id"))
    new = fx.table(s, d, "supplier").where("s_nationkey < 10").select(F.col("s_nationkey").cast(B).alias("slide_id"), (F.col("s_suppkey") + 1000000).alias("ann_id"))
    return vector.replace_all(old, new)


def _listed(s, d):
    c = fx.table(s, d, "customer")
    return c.select(F.col("c_nationkey").cast(B).alias("slide_id"), F.col("c_custkey").alias("ord"), F.col("c_mktsegment").alias("name"))


def q_lookup(s, d):
    a = vector.by_name(_listed(s, d), "BUILDING").select("slide_id", F.lit("name").alias("how"), "ord")
    b = vector.by_index(_listed(s, d), 2).select("slide_id", F.lit("index").alias("how"), "ord")
    c = vector.by_index(_listed(s, d), -1).select("slide_id", F.lit("end").alias("how"), "ord")
    return a.unionByName(b).unionByName(c)


LOOKUP = "SELECT CAST(c_nationkey AS BIGINT) AS slide_id, 'name' AS how, min(c_custkey) AS ord FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'end', max(c_custkey) FROM customer GROUP BY 1 UNION ALL SELECT CAST(c_nationkey AS BIGINT), 'index', k FROM (SELECT c_nationkey, c_custkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 3"


def q_accepted_files(s, d):
    anns = fx.table(s, d, "customer").select((F.col("c_custkey") % 200).cast("string").alias("slide_id"), F.col("c_custkey").alias("ann_id"), F.when(F.col("c_custkey") % 5 == 0, "None").otherwise(F.concat(F.lit("g"), (F.col("c_custkey") % 211).cast("string"))).alias("group_name"))
    groups = fx.table(s, d, "customer").where("c_custkey % 17 <> 3").select((F.col("c_custkey") % 200).cast("string").alias("slide_id"), F.concat(F.lit("g"), (F.col("c_custkey") % 211).cast("string")).alias("name")).distinct()
    return vector.accepted_files(anns, groups)


ACCEPTED = "WITH a AS (SELECT CAST(c_custkey % 200 AS VARCHAR) AS slide_id, c_custkey AS ann_id, CASE WHEN c_custkey % 5 = 0 THEN 'None' ELSE 'g' || (c_custkey % 211) END AS group_name FROM customer), g AS (SELECT DISTINCT CAST(c_custkey % 200 AS VARCHAR) AS slide_id, 'g' || (c_custkey % 211) AS name FROM customer WHERE c_custkey % 17 <> 3) SELECT * FROM a WHERE slide_id NOT IN (SELECT a.slide_id FROM a LEFT JOIN g ON g.slide_id = a.slide_id AND g.name = a.group_name WHERE g.name IS NULL AND a.group_name <> 'None')"


def q_nearest_segment(s, d):
    n = fx.side(s, d)
    pts = fx.table(s, d, "part").select(F.col("p_partkey").alias("point_id"), (F.col("p_partkey") * 31 % n).cast("double").alias("x"), (F.col("p_partkey") * 17 % n).cast("double").alias("y"))
    out = vector.nearest_shape(pts, fx.polygons(s, d), 3.0)
    return out.select("point_id", F.col("kind").cast(B).alias("kind"), F.round("d2", 5).alias("d2"))


NEAREST = f"WITH p AS (SELECT p_partkey AS point_id, CAST(p_partkey * 31 % {SIDE} AS DOUBLE) AS x, CAST(p_partkey * 17 % {SIDE} AS DOUBLE) AS y FROM part), e AS ({EDGES}), q AS (SELECT point_id, (x - ax) * (x - ax) + (y - ay) * (y - ay) AS v2, CASE WHEN bx = ax AND by_ = ay THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE))) END AS t, x, y, ax, ay, bx, by_ FROM p, e), z AS (SELECT point_id, v2, (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2 AS e2 FROM q) SELECT point_id, CAST(CASE WHEN min(v2) <= 9 THEN 0 ELSE 1 END AS BIGINT) AS kind, round(CASE WHEN min(v2) <= 9 THEN min(v2) ELSE min(e2) END, 5) AS d2 FROM z GROUP BY 1 HAVING min(v2) <= 9 OR min(e2) <= 9"


def q_stitch(s, d):
    r = fx.rings(s, d).select(F.expr("ring div 50").cast("string").alias("file"), F.lit("g").alias("group_name"), F.col("ring").cast("int").alias("ord"), F.lit("").alias("name"), "coords")
    out = vector.stitch_regions(r, 60.0)
    return out.select("file", F.col("ord").cast(B).alias("ord"), F.size("coords").cast(B).alias("n"), F.round(geom.area(F.col("coords")), 3).alias("area"))


_FAR = lambda a, b: f"(({a}.x - {b}.x) ** 2 + ({a}.y - {b}.y) ** 2 > 3600)"
_ENDS = [_FAR("pts[-1]", "r.p[1]"), _FAR("pts[-1]", "r.p[-1]"), _FAR("pts[1]", "r.p[-1]"), _FAR("pts[1]", "r.p[1]")]
_CODE = f"CASE WHEN NOT {_FAR('r.p[1]', 'r.p[-1]')} THEN 0 " + " ".join(f"WHEN NOT {far} THEN {i + 1}" for i, far in enumerate(_ENDS)) + " ELSE 0 END"
_PTS = "STRUCT(x DOUBLE, y DOUBLE)[]"
# one action a step: take the first region that is left, join the first that fits, or put out the region in hand
STITCH = f"""WITH RECURSIVE g AS (SELECT ring, list({{'x': x, 'y': y}} ORDER BY ord) AS pts FROM ({VERTICES}) GROUP BY 1),
s(file, todo, ord, pts, out_ord, out_pts) AS (SELECT CAST(ring // 50 AS VARCHAR), list({{'o': ring, 'p': pts}} ORDER BY ring), CAST(NULL AS BIGINT), CAST(NULL AS {_PTS}), CAST(NULL AS BIGINT), CAST(NULL AS {_PTS}) FROM g GROUP BY 1
UNION ALL SELECT file, CASE WHEN ord IS NULL THEN todo[2:] WHEN k > 0 THEN list_concat(todo[:k - 1], todo[k + 1:]) ELSE todo END, CASE WHEN ord IS NULL THEN todo[1].o WHEN k > 0 THEN ord END,
CASE WHEN ord IS NULL THEN todo[1].p WHEN k > 0 THEN CASE codes[k] WHEN 1 THEN list_concat(pts, todo[k].p) WHEN 2 THEN list_concat(pts, list_reverse(todo[k].p)) WHEN 3 THEN list_concat(todo[k].p, pts) ELSE list_concat(list_reverse(todo[k].p), pts) END END,
CASE WHEN ord IS NOT NULL AND coalesce(k, 0) = 0 THEN ord END, CASE WHEN ord IS NOT NULL AND coalesce(k, 0) = 0 THEN pts END
FROM (SELECT *, list_position(list_transform(codes, lambda c: c > 0), true) AS k FROM (SELECT *, CASE WHEN ord IS NOT NULL AND {_FAR("pts[1]", "pts[-1]")} THEN list_transform(todo, lambda r: {_CODE}) END AS codes FROM s)) WHERE ord IS NOT NULL OR len(todo) > 0)
SELECT file, out_ord AS ord, len(out_pts) AS n, round(abs(0.5 * list_sum(list_transform(range(1, len(out_pts) + 1), lambda i: (out_pts[i].x + out_pts[i % len(out_pts) + 1].x) * (out_pts[i].y - out_pts[i % len(out_pts) + 1].y)))), 3) AS area FROM s WHERE out_ord IS NOT NULL"""


def q_spline(s, d):
    pts = vector.flatten_spline(fx.polygons(s, d), steps=4)
    return pts.select("ann_id", F.col("segment").cast(B).alias("segment"), F.round("t", 3).alias("t"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def q_spline_open(s, d):
    pts = vector.flatten_spline(fx.rings(s, d).where(F.size("coords") >= 2), "ring", 3, closed=False)
    return pts.select("ring", F.col("segment").cast(B).alias("segment"), F.round("t", 3).alias("t"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _spline_sql(segments: str, key: str, steps: int, digits: int) -> str:
    """Points of the cubics of segments (key, segment, p0x .. p3y)."""
    leg = lambda a, b: f"sqrt(sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2))"
    one = lambda k: f"(d1 * d1 * p2{k} - d2 * d2 * p0{k} + (2 * d1 * d1 + 3 * d1 * d2 + d2 * d2) * p1{k}) / (3 * d1 * (d1 + d2))"
    two = lambda k: f"(d3 * d3 * p1{k} - d2 * d2 * p3{k} + (2 * d3 * d3 + 3 * d3 * d2 + d2 * d2) * p2{k}) / (3 * d3 * (d3 + d2))"
    at = lambda k: f"round((1 - t) ** 3 * p1{k} + 3 * (1 - t) ** 2 * t * b1{k} + 3 * (1 - t) * t * t * b2{k} + t ** 3 * p2{k}, {digits}) AS {k}"
    return f"""WITH g AS ({segments}), l AS (SELECT *, {leg("p0", "p1")} AS e1, {leg("p1", "p2")} AS e2, {leg("p2", "p3")} AS e3 FROM g),
m AS (SELECT *, CASE WHEN e2 < 1e-4 THEN 1.0 ELSE e2 END AS d2 FROM l), h AS (SELECT *, CASE WHEN e1 < 1e-4 THEN d2 ELSE e1 END AS d1, CASE WHEN e3 < 1e-4 THEN d2 ELSE e3 END AS d3 FROM m),
c AS (SELECT *, {one("x")} AS b1x, {one("y")} AS b1y, {two("x")} AS b2x, {two("y")} AS b2y FROM h), k AS (SELECT *, i / {steps}.0::DOUBLE AS t FROM c, range({steps}) r(i))
SELECT {key}, CAST(segment AS BIGINT) AS segment, round(t, 3) AS t, {at("x")}, {at("y")} FROM k"""


_C = f"(SELECT ann_id, ord, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM ({CORNERS}))"
CLOSED = f"SELECT a.ann_id, a.ord AS segment, " + ", ".join(f"{p}.x AS p{i}x, {p}.y AS p{i}y" for i, p in enumerate("zabc")) + f" FROM {_C} a JOIN {_C} z ON z.ann_id = a.ann_id AND z.ord = (a.ord + 3) % 4 JOIN {_C} b ON b.ann_id = a.ann_id AND b.ord = (a.ord + 1) % 4 JOIN {_C} c ON c.ann_id = a.ann_id AND c.ord = (a.ord + 2) % 4"
_V = f"SELECT ring, ord, {', '.join(f'{f}({k}{n}) OVER w AS {p}{k}_' for k in 'xy' for p, f, n in (('z', 'lag', ''), ('b', 'lead', ''), ('c', 'lead', ', 2')))}, x, y FROM ({VERTICES}) WINDOW w AS (PARTITION BY ring ORDER BY ord)"
OPENED = "SELECT ring, ord AS segment, " + ", ".join(f"coalesce(z{k}_, 2 * {k} - b{k}_) AS p0{k}, {k} AS p1{k}, b{k}_ AS p2{k}, coalesce(c{k}_, 2 * b{k}_ - {k}) AS p3{k}" for k in "xy") + f" FROM ({_V}) WHERE bx_ IS NOT NULL"


def q_simplify_nth(s, d):
    return simplify.nth_point(fx.series(s, d), 5).select("key", F.col("ord").cast(B).alias("ord"))


def _kept(df):
    return df.select("key", F.col("ord").cast(B).alias("ord"))


def q_radial(s, d):
    return _kept(simplify.radial_distance(fx.series(s, d), 100000.0))


def q_perpendicular(s, d):
    return _kept(simplify.perpendicular_distance(fx.series(s, d), 5.0, 2))


def q_reumann(s, d):
    return _kept(simplify.reumann_witkam(fx.series(s, d), 20.0))


def q_opheim(s, d):
    return _kept(simplify.opheim(fx.series(s, d), 30.0, 1000000.0))


def q_lang(s, d):
    return _kept(simplify.lang(fx.series(s, d), 20.0, 8))


def q_dp(s, d):
    return _kept(simplify.douglas_peucker(fx.series(s, d), 20.0))


def q_dp_n(s, d):
    return _kept(simplify.douglas_peucker_n(fx.series(s, d), 6))


def q_simplify(s, d):
    few = simplify.simplify(fx.series(s, d), 6).withColumn("how", F.lit("count"))
    return few.unionByName(simplify.simplify(fx.series(s, d), 0, 20.0).withColumn("how", F.lit("tolerance"))).select("how", "key", F.col("ord").cast(B).alias("ord"))


def q_err(s, d):
    original = fx.series(s, d)
    out = simplify.error_statistics(original, simplify.nth_point(original, 4))
    return out.select("key", *(F.round(c, 4).alias(c) for c in ("max_error", "sum_error", "mean_error", "std_error")))


ERR = f"""WITH v AS ({SERIES}), l AS (SELECT key, max(ord) AS last FROM v GROUP BY 1), k AS (SELECT v.*, lead(ord) OVER w AS o2, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v JOIN l ON l.key = v.key WHERE ord % 4 = 0 OR ord = last WINDOW w AS (PARTITION BY v.key ORDER BY ord)),
j AS (SELECT v.key, v.ord, v.x, v.y, k.x AS ax, k.y AS ay, k.bx, k.by_ FROM v JOIN k ON k.key = v.key AND v.ord >= k.ord AND v.ord < coalesce(k.o2, 1000000000)),
t AS (SELECT *, CASE WHEN bx IS NULL OR (bx = ax AND by_ = ay) THEN 0.0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) END AS t FROM j),
e AS (SELECT key, CASE WHEN bx IS NULL THEN 0.0 ELSE sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2) END AS e FROM t)
SELECT key, round(max(e), 4) AS max_error, round(sum(e), 4) AS sum_error, round(avg(e), 4) AS mean_error, round(stddev_pop(e), 4) AS std_error FROM e GROUP BY 1"""


def q_hsv(s, d):
    h = color.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    out = fx.rgb(s, d).withColumn("c", h)
    back = color.hsv_to_rgb(F.col("c.h"), F.col("c.s"), F.col("c.v"))
    return out.select("l_orderkey", "l_linenumber", F.round("c.h", 6).alias("h"), F.round("c.s", 6).alias("s"), F.round("c.v", 6).alias("v"), F.round(back["r"], 5).alias("r"), F.round(back["g"], 5).alias("g"), F.round(back["b"], 5).alias("b"))


HSV = f"SELECT l_orderkey, l_linenumber, round(CASE WHEN mx - mn < 0.00001 THEN 0.0 ELSE (h + CASE WHEN h < 0 THEN 360 ELSE 0 END) END, 6) AS h, round(CASE WHEN mx - mn < 0.00001 THEN 0.0 ELSE (mx - mn) / mx END, 6) AS s, round(mx, 6) AS v, round(r, 5) AS r, round(g, 5) AS g, round(b, 5) AS b FROM (SELECT *, 60.0::DOUBLE * CASE WHEN r >= mx THEN (g - b) / (mx - mn) WHEN g >= mx THEN 2 + (b - r) / (mx - mn) ELSE 4 + (r - g) / (mx - mn) END AS h FROM (SELECT *, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM ({RGB})))"


def q_deconv(s, d):
    c = [F.col(k) for k in "rgb"]
    return fx.rgb(s, d).select("l_orderkey", "l_linenumber", F.round(color.color_deconvolution(*c, stain=0), 6).alias("h"), F.round(color.color_deconvolution(*c, stain=1), 6).alias("e"))


_Q = color.stain_matrix()
_OD = ", ".join(f"-ln({k} / 255.0::DOUBLE) AS d{k}" for k in "rgb")
_GATE = "(dr + dg + db) / 3 > 0.25 AND dr > 0.2 AND dg > 0.2 AND db > 0.2"
DECONV = f"SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN r <> 0 AND g <> 0 AND b <> 0 AND {_GATE} THEN round(greatest(0, dr * {_Q[3 * k]!r}::DOUBLE + dg * {_Q[3 * k + 1]!r}::DOUBLE + db * {_Q[3 * k + 2]!r}::DOUBLE), 6) ELSE 0.0 END AS {n}" for k, n in enumerate("he")) + f" FROM (SELECT l_orderkey, l_linenumber, r, g, b, {', '.join(f'CASE WHEN {k} > 0 THEN -ln({k} / 255.0::DOUBLE) END AS d{k}' for k in 'rgb')} FROM ({RGB}))"


def q_lut(s, d):
    li = fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 6 - 20).cast("double").alias("value"))
    out = overlay.colorize(li, overlay.lut(s, "Traffic Light (0 - 255)"))
    return out.groupBy("value", *(F.col(c).cast(B).alias(c) for c in ("red", "green", "blue", "alpha"))).agg(F.count(F.lit(1)).alias("n"))


_H = "CASE WHEN v < 10 THEN 120 * t WHEN v < 127 THEN 120 - 60 * t ELSE 60 - 60 * t END"
_S = "CASE WHEN v < 10 THEN t ELSE 1.0 END"
_RGB = ", ".join(f"CAST(CASE WHEN v < 0 OR v >= 255 THEN {end} ELSE floor(255 * (s - s * s * greatest(0, least(fmod({n} + h / 60, 6), 4 - fmod({n} + h / 60, 6), 1))) + 1e-9) END AS BIGINT) AS {c}" for c, n, end in (("red", 5, "CASE WHEN v < 0 THEN 0 ELSE 255 END"), ("green", 3, "0"), ("blue", 1, "0")))
LUT = f"SELECT v AS value, {_RGB}, CAST(CASE WHEN v < 0 THEN 0 WHEN v < 10 THEN floor(255 * t + 1e-9) ELSE 255 END AS BIGINT) AS alpha, n FROM (SELECT v, n, t, {_H} AS h, {_S} AS s FROM (SELECT v, n, CASE WHEN v < 10 THEN v / 10 WHEN v < 127 THEN (v - 10) / 117 ELSE (v - 127) / 128 END AS t FROM (SELECT CAST(l_quantity * 6 - 20 AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1)))"
_PARTS = ", ".join(f"CAST(list_extract([{', '.join(str(row[1][k]) for row in overlay.LUTS['Label'][1])}], l_linenumber + 1) AS BIGINT) AS {n}" for k, n in enumerate(("red", "green", "blue", "alpha")))
LABEL_LUT = f"SELECT l_linenumber AS value, {_PARTS}, count(*) AS n FROM lineitem GROUP BY ALL"


def q_lut_label(s, d):
    li = fx.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("value"))
    out = overlay.colorize(li, overlay.lut(s, "Label"))
    return out.groupBy("value", *(F.col(c).cast(B).alias(c) for c in ("red", "green", "blue", "alpha"))).agg(F.count(F.lit(1)).alias("n"))


def q_lut_relative(s, d):
    g = fx.grid(s, d)
    out = overlay.colorize(g, overlay.lut(s, "Background"), minmax=raster.min_max(g))
    return out.groupBy("slide_id", "value", F.col("red").cast(B).alias("red")).agg(F.count(F.lit(1)).alias("n"))


def _level_tables(s, d):
    n = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("slide_id"), (F.lit(1024) * F.expr("shiftleft(1, 3 + n_nationkey % 3)")).cast(B).alias("w"))
    levels = n.select("slide_id", "w", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("level"))
    slides = levels.select("slide_id", "level", F.expr("w div shiftleft(1, level)").alias("width"), F.expr("shiftleft(1, level)").cast("double").alias("downsample"))
    scale = F.expr("shiftleft(1, slide_id % 4)")
    results = levels.where("level <= 2").select("slide_id", F.lit("r").alias("result_id"), "level", F.expr("w div shiftleft(1, slide_id % 4) div shiftleft(1, level)").alias("width"))
    requests = levels.select("slide_id", F.lit("r").alias("result_id"), "level", scale.cast("double").alias("scale"))
    return slides, results, requests


def q_foreground(s, d):
    out = overlay.foreground_levels(*_level_tables(s, d))
    return out.select(F.col("slide_id").cast(B).alias("slide_id"), F.col("level").cast(B).alias("level"), F.col("fg_level").cast(B).alias("fg_level"), F.round("residual", 6).alias("residual"))


FOREGROUND = "SELECT CAST(n_nationkey AS BIGINT) AS slide_id, CAST(l AS BIGINT) AS level, CAST(f AS BIGINT) AS fg_level, round((w // (1 << (n_nationkey % 4)) // (1 << f)) / CAST(w // (1 << l) AS DOUBLE), 6) AS residual FROM (SELECT n_nationkey, 1024 * (1 << (3 + n_nationkey % 3)) AS w, CAST(r.l AS INT) AS l, CAST(greatest(0, least(2, r.l - n_nationkey % 4)) AS INT) AS f FROM nation, range(6) r(l))"


def q_points(s, d):
    p = fx.boxes(s, d).select("ann_id", *(F.col(c).cast("double").alias(c) for c in ("cx", "cy", "hx", "hy")))
    c = F.col
    return p.select("ann_id", geom.dot(c("cx"), c("cy"), c("hx"), c("hy")).alias("dot"), F.round(geom.interpolate(c("cx"), c("hx"), F.lit(0.25)), 4).alias("between"), geom.is_left(F.lit(0.0), F.lit(0.0), c("cx"), c("cy"), c("hx"), c("hy")).cast(B).alias("side"), geom.area_text(c("cx") * c("cy") * 1000).alias("area"), geom.level_to_base(c("cx"), F.lit(4.0)).alias("base"), F.round(geom.ray_dist2(F.lit(0.0), F.lit(0.0), c("hx"), c("hy"), c("cx"), c("cy")), 4).alias("ray"), F.round(geom.line_dist2(F.lit(0.0), F.lit(0.0), c("hx"), c("hy"), c("cx"), c("cy")), 4).alias("line"))


_AREA = "cx * cy * 1000"
POINTS = f"SELECT ann_id, CAST(cx * hx + cy * hy AS DOUBLE) AS dot, round(cx + 0.25 * (hx - cx), 4) AS between, CAST(cx * hy - hx * cy AS BIGINT) AS side, CASE WHEN {_AREA} > 1000000 THEN CAST(round({_AREA} / 1000000.0::DOUBLE, 2) AS VARCHAR) || ' mm2' ELSE CAST(CAST({_AREA} AS DOUBLE) AS VARCHAR) || ' um2' END AS area, CAST(cx * 4 AS DOUBLE) AS base, round(CASE WHEN cx * hx + cy * hy <= 0 THEN cx * cx + cy * cy ELSE (cx * hy - cy * hx) ** 2 / (hx * hx + hy * hy) END, 4) AS ray, round((cx * hy - cy * hx) ** 2 / CAST(hx * hx + hy * hy AS DOUBLE), 4) AS line FROM ({fx.BOXES})"


def q_colors(s, d):
    o = fx.table(s, d, "orders").select("o_orderkey", color.int_to_hex(F.col("o_orderkey") * 977 % 16777216).alias("hex"), (F.col("o_orderkey") % 256).alias("alpha"), (F.col("o_custkey") % 256).alias("v"))
    rgb = color.hex_channels(F.col("hex"))
    return o.select("o_orderkey", "hex", rgb["r"].cast(B).alias("r"), rgb["g"].cast(B).alias("g"), rgb["b"].cast(B).alias("b"), color.flatten_alpha(F.col("v"), F.col("alpha"), F.lit(255)).cast(B).alias("flat"))


COLORS = "SELECT o_orderkey, '#' || lpad(lower(to_hex(c)), 6, '0') AS hex, c // 65536 AS r, c // 256 % 256 AS g, c % 256 AS b, CAST(CASE WHEN a = 255 THEN v WHEN a = 0 THEN 255 ELSE least(255, v * 255 // a) END AS BIGINT) AS flat FROM (SELECT o_orderkey, o_orderkey * 977 % 16777216 AS c, o_orderkey % 256 AS a, o_custkey % 256 AS v FROM orders)"


def q_measure(s, d):
    c = F.col("coords")
    length = geom.path_length(c, F.lit(0.5), F.lit(0.25))
    return fx.rings(s, d).select("ring", F.round(length, 4).alias("length"), (length > 1000).alias("mm"), F.round(geom.nm_to_pixel(c[0]["x"], F.lit(100.0), F.lit(0.25), F.lit(2048.0)), 4).alias("px"), geom.base_to_level(c[0]["x"], F.lit(4.0)).cast(B).alias("at_level"), geom.to_tile(c[0]["x"], F.lit(512)).cast(B).alias("tile"), F.round(geom.spacing_to_resolution(c[0]["x"] + 1), 6).alias("resolution"))


MEASURE = f"SELECT ring, round(l, 4) AS length, l > 1000 AS mm, round((fx - 100) / 250.0 + 1024, 4) AS px, CAST(floor(fx / 4.0 + 0.5) AS BIGINT) AS at_level, CAST(floor(fx / 512) AS BIGINT) AS tile, round(10000.0 / (fx + 1), 6) AS resolution FROM (SELECT ring, sqrt(((arg_min(x, ord) - arg_max(x, ord)) * 0.5) ** 2 + ((arg_min(y, ord) - arg_max(y, ord)) * 0.25) ** 2) AS l, arg_min(x, ord) AS fx FROM ({VERTICES}) GROUP BY 1)"

QUERIES = {
    "q_area": (q_area, f"SELECT ring, round(abs(0.5 * sum((x + nx) * (y - ny))), 4) AS area FROM ({NEXT}) GROUP BY 1"),
    "q_orientation": (q_orientation, f"SELECT ring, sum((nx - x) * (ny + y)) < 0 AS cw, CASE WHEN sum((nx - x) * (ny + y)) < 0 THEN arg_min(x, ord) ELSE arg_max(x, ord) END AS first_x FROM ({NEXT}) GROUP BY 1"),
    "q_bbox": (q_bbox, f"SELECT ring, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, min(x) - (min(x) + max(x)) / 2 AS left, count(*) AS n FROM ({VERTICES}) GROUP BY 1"),
    "q_vertex_edits": (q_vertex_edits, EDITS),
    "q_pip": (q_pip, f"SELECT slide_id, x, y, ann_id FROM ({INSIDE})"),
    "q_pip_evenodd": (q_pip_evenodd, EVENODD),
    "q_mask": (q_mask, f"SELECT slide_id, x, y, max(label) AS value FROM ({INSIDE}) GROUP BY 1, 2, 3"),
    "q_mask_order": (q_mask_order, f"SELECT slide_id, x, y, arg_max(label, n_nationkey * 7 % 25 * 1000000 + ann_id) AS value FROM ({INSIDE}) JOIN nation ON n_nationkey + 1 = label WHERE n_nationkey % 3 <> 1 GROUP BY 1, 2, 3"),
    "q_edges": (q_edges, f"SELECT label, count(*) AS n, round(sum(sqrt(CAST((ax - bx) ** 2 + (ay - by_) ** 2 AS DOUBLE))), 4) AS length FROM ({EDGES}) GROUP BY 1"),
    "q_group_rollup": (q_group_rollup, ROLLUP),
    "q_group_rollup_slides": (q_group_rollup_slides, SLIDE_CLOSURE + f" SELECT c.slide_id, c.ancestor AS name, CAST(round(sum(area), 4) AS DOUBLE) AS area, count(*) * 4 AS n_points, CAST(min(x0) AS DOUBLE) AS x0 FROM ({SLIDE_MEMBERS}) m JOIN c ON c.slide_id = m.slide_id AND c.name = m.name GROUP BY 1, 2"),
    "q_cascade_delete_slides": (q_cascade_delete_slides, SLIDE_CLOSURE + f" SELECT slide_id, ann_id FROM ({SLIDE_MEMBERS}) m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.slide_id = m.slide_id AND c.name = m.name AND (c.slide_id, c.ancestor) IN (('N', 'r1'), ('R', 'r0')))"),
    "q_named_labels": (q_named_labels, NAMED),
    "q_without": (q_without, WITHOUT),
    "q_cascade_delete": (q_cascade_delete, "SELECT s_suppkey AS ann_id, 'n' || s_nationkey AS group_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey NOT IN (1, 3)"),
    "q_move_members": (q_move_members, "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE 'n' || s_nationkey END AS group_name, count(*) AS n FROM supplier GROUP BY 1"),
    "q_replace_all": (q_replace_all, "SELECT CAST(c_nationkey AS BIGINT) AS slide_id, c_custkey AS ann_id FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 10) UNION ALL SELECT CAST(s_nationkey AS BIGINT), s_suppkey + 1000000 FROM supplier WHERE s_nationkey < 10"),
    "q_lookup": (q_lookup, LOOKUP),
    "q_accepted_files": (q_accepted_files, ACCEPTED),
    "q_nearest_segment": (q_nearest_segment, NEAREST),
    "q_stitch": (q_stitch, STITCH),
    "q_spline": (q_spline, _spline_sql(CLOSED, "ann_id", 4, 6)),
    "q_spline_open": (q_spline_open, _spline_sql(OPENED, "ring", 3, 4)),
    "q_simplify_nth": (q_simplify_nth, f"WITH v AS ({SERIES}), l AS (SELECT key, max(ord) AS last FROM v GROUP BY 1) SELECT v.key, CAST(ord AS BIGINT) AS ord FROM v JOIN l ON l.key = v.key WHERE ord % 5 = 0 OR ord = last"),
    "q_radial": (q_radial, simplify_sql.radial(100000.0)),
    "q_perpendicular": (q_perpendicular, simplify_sql.perpendicular(5.0, 2)),
    "q_reumann": (q_reumann, simplify_sql.reumann(20.0)),
    "q_opheim": (q_opheim, simplify_sql.opheim(30.0, 1000000.0)),
    "q_lang": (q_lang, simplify_sql.lang(20.0, 8)),
    "q_dp": (q_dp, simplify_sql.douglas_peucker(20.0)),
    "q_dp_n": (q_dp_n, simplify_sql.douglas_peucker_n(6)),
    "q_simplify": (q_simplify, f"SELECT 'count' AS how, key, ord FROM ({simplify_sql.douglas_peucker_n(6)}) UNION ALL SELECT 'tolerance', key, ord FROM ({simplify_sql.douglas_peucker(20.0)})"),
    "q_err": (q_err, ERR),
    "q_hsv": (q_hsv, HSV),
    "q_deconv": (q_deconv, DECONV),
    "q_lut": (q_lut, LUT),
    "q_lut_label": (q_lut_label, LABEL_LUT),
    "q_lut_relative": (q_lut_relative, f"WITH g AS ({GRID}), m AS (SELECT slide_id, min(value) AS lo, max(value) AS hi FROM g GROUP BY 1) SELECT g.slide_id, value, CAST(floor((value - lo) / CAST(hi - lo AS DOUBLE) * 255 + 1e-9) AS BIGINT) AS red, count(*) AS n FROM g JOIN m ON m.slide_id = g.slide_id GROUP BY 1, 2, 3"),
    "q_foreground": (q_foreground, FOREGROUND),
    "q_points": (q_points, POINTS),
    "q_colors": (q_colors, COLORS),
    "q_measure": (q_measure, MEASURE),
}
