"""Queries on grids and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import morph, overlay, packed, pyramid, raster, tilewise
from . import fixtures as fx
from .fixtures import GRID, LABELLED, LAYERS, MOSAIC, SIDE

B = "bigint"


def _whole(df, *cols):
    return df.select(*(F.col(c).cast(B).alias(c) if c not in ("slide_id",) else F.col(c) for c in cols))


def _unsigned_zero(c):
    return F.when(c == 0, 0.0).otherwise(c)


def _size(tiles):
    """Width and height in pixels that the tiles span, from one aggregated row."""
    size = tiles.agg(F.max((F.col("tile_x") + 1) * F.col("tile_w")), F.max((F.col("tile_y") + 1) * F.col("tile_h"))).first()
    return size[0] or 0, size[1] or 0


def q_threshold(s, d):
    return raster.threshold(fx.grid(s, d), 2, 4).select("slide_id", "x", "y", F.col("value").cast(B).alias("value"))


def q_label_remove(s, d):
    return raster.remove_labels(fx.labelled(s, d), [1, 3, 7]).groupBy("slide_id", F.col("value").cast(B).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def q_label_remove_by_table(s, d):
    gone = fx.table(s, d, "supplier").select((F.col("s_suppkey") % 3 + 1).cast("int").alias("value"))
    return raster.remove_labels_by(fx.labelled(s, d), gone).groupBy("slide_id", F.col("value").cast(B).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def q_channel(s, d):
    px = raster.to_pixels(fx.tiles(s, d).withColumn("n_channels", F.lit(2)).withColumn("tile_w", F.lit(4)))
    return raster.channel(px, 1, 2).groupBy("slide_id", "x").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def q_convert(s, d):
    li = fx.table(s, d, "lineitem")
    v = F.col("l_extendedprice") - 20000
    return li.select("l_orderkey", "l_linenumber", raster.convert(v, "uint8").alias("u8"), raster.convert(v, "uint16").alias("u16"), raster.convert(v, "uint32").alias("u32"))


def q_label_stats(s, d):
    return raster.label_statistics(fx.labelled(s, d)).select("slide_id", F.col("label").cast(B).alias("label"), F.round("cog_x", 6).alias("cog_x"), F.round("cog_y", 6).alias("cog_y"), "area")


def q_components(s, d):
    return _whole(morph.connected_components(fx.grid(s, d), 1.5), "slide_id", "x", "y", "label")


def q_component_stats(s, d):
    found = morph.connected_components(fx.grid(s, d), 1.5).withColumnRenamed("label", "value")
    return raster.label_statistics(found).select("slide_id", F.col("label").cast(B).alias("label"), F.round("cog_x", 6).alias("cog_x"), F.round("cog_y", 6).alias("cog_y"), "area")


REACH = f"""WITH RECURSIVE g AS (SELECT slide_id, x, y FROM ({GRID}) WHERE value > 1.5),
e AS (SELECT a.slide_id, a.y * 1000000 + a.x AS u, b.y * 1000000 + b.x AS v FROM g a JOIN g b ON a.slide_id = b.slide_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
r(slide_id, u, c) AS (SELECT slide_id, y * 1000000 + x, y * 1000000 + x FROM g UNION SELECT e.slide_id, e.v, r.c FROM r JOIN e ON e.slide_id = r.slide_id AND e.u = r.u WHERE r.c < e.v),
m AS (SELECT slide_id, u, min(c) AS c FROM r GROUP BY 1, 2),
n AS (SELECT slide_id, u % 1000000 AS x, u // 1000000 AS y, dense_rank() OVER (PARTITION BY slide_id ORDER BY c) AS label FROM m)"""


def q_components_8(s, d):
    found = morph.connected_components(fx.grid(s, d), 2.5, neighbours=8)
    return found.groupBy("slide_id", F.col("label").cast(B).alias("label")).agg(F.count(F.lit(1)).alias("area"))


def q_distance(s, d):
    src = fx.grid(s, d).where("value >= 4")
    n = fx.side(s, d)
    return morph.distance_transform(src, (n, n)).select("slide_id", "x", "y", F.col("d").cast(B).alias("d"))


def q_distance_within(s, d):
    src = fx.grid(s, d).where("value >= 4")
    n = fx.side(s, d)
    return morph.within(morph.distance_transform(src, (n, n)), 3).groupBy("slide_id").agg(F.count(F.lit(1)).alias("n"))


DISTANCE = f"""WITH s AS (SELECT slide_id, x, y FROM ({GRID}) WHERE value >= 4), g AS (SELECT t.slide_id, a.i AS x, b.i AS y FROM (SELECT DISTINCT slide_id FROM s) t, (SELECT unnest(range({SIDE})) AS i) a, (SELECT unnest(range({SIDE})) AS i) b)
SELECT g.slide_id, g.x, g.y, CAST(least(min(abs(g.x - s.x) + abs(g.y - s.y)), {SIDE} + {SIDE} // 2 + 1) AS BIGINT) AS d FROM g JOIN s ON g.slide_id = s.slide_id GROUP BY 1, 2, 3"""


def q_runs(s, d):
    return _whole(raster.to_runs(fx.grid(s, d).where("value > 1").select("slide_id", "x", "y")), "slide_id", "y", "x0", "x1")


RUNS = f"""WITH g AS (SELECT slide_id, x, y FROM ({GRID}) WHERE value > 1), a AS (SELECT slide_id, y, x AS x0 FROM g WHERE NOT EXISTS (SELECT 1 FROM g p WHERE p.slide_id = g.slide_id AND p.y = g.y AND p.x = g.x - 1))
SELECT a.slide_id, a.y, a.x0, (SELECT min(b.x) FROM g b WHERE b.slide_id = a.slide_id AND b.y = a.y AND b.x >= a.x0 AND NOT EXISTS (SELECT 1 FROM g n WHERE n.slide_id = b.slide_id AND n.y = b.y AND n.x = b.x + 1)) AS x1 FROM a"""


def q_minmax(s, d):
    return raster.min_max(raster.to_pixels(fx.tiles(s, d)), "slide_id")


def q_patch_minmax(s, d):
    return raster.patch_min_max(fx.tiles(s, d)).drop("level", "slide_id")


def q_downscale(s, d):
    px = raster.to_pixels(fx.tiles(s, d)).select("slide_id", "x", "y", "value")
    return raster.downscale(px, 4).select("slide_id", F.col("x").cast(B).alias("x"), F.col("y").cast(B).alias("y"), F.round("value", 6).alias("value"))


def q_downscale_nearest(s, d):
    px = raster.to_pixels(fx.tiles(s, d)).select("slide_id", "x", "y", "value")
    return raster.downscale(px, 4, "nearest").select("slide_id", F.col("x").cast(B).alias("x"), F.col("y").cast(B).alias("y"), F.round("value", 6).alias("value"))


def q_pyramid(s, d):
    px = raster.to_pixels(fx.tiles(s, d)).select("slide_id", "x", "y", F.floor(F.col("value") * 1000).alias("value"))
    return raster.build_pyramid(px, pyramid.sizes_of(fx.tiles(s, d)), 2, 3, integer=True).select("slide_id", F.col("level").cast(B).alias("level"), F.col("x").cast(B).alias("x"), F.col("y").cast(B).alias("y"), F.col("value").cast(B).alias("value"))


HIGH = "(SELECT (max(vec_id) // 25 + 1) * 8 FROM embeddings)"


def _down(src, n):
    return f"SELECT slide_id, {n} AS level, x // 2 AS x, y // 2 AS y, CAST(trunc(avg(value)) AS BIGINT) AS value FROM ({src}) WHERE x // 2 < {200 // 2**n} AND y // 2 < {HIGH} // {2**n} GROUP BY 1, 3, 4"


L0 = f"SELECT slide_id, 0 AS level, x, y, CAST(floor(value * 1000) AS BIGINT) AS value FROM ({MOSAIC})"
L1, L2, L3 = _down("SELECT * FROM l0", 1), _down("SELECT * FROM l1", 2), _down("SELECT * FROM l2", 3)
PYRAMID = f"WITH l0 AS ({L0}), l1 AS ({L1}), l2 AS ({L2}), l3 AS ({L3}) " + " UNION ALL ".join(f"SELECT slide_id, CAST(level AS BIGINT) AS level, x, y, value FROM l{i}" for i in range(4))


def q_region(s, d):
    return raster.read_region(fx.tiles(s, d), 37, 21, 60, 50).select("slide_id", "x", "y", F.round("value", 6).alias("value"))


REGION = f"SELECT 'm' AS slide_id, g.x, g.y, round(coalesce(m.value, 0), 6) AS value FROM (SELECT a.i AS x, b.i AS y FROM range(37, 97) a(i), range(21, 71) b(i)) g LEFT JOIN ({MOSAIC}) m ON m.x = g.x AND m.y = g.y"


def _requests(s, d):
    sup = fx.table(s, d, "supplier")
    return sup.select(F.col("s_suppkey").alias("request"), F.lit("m").alias("slide_id"), (F.col("s_suppkey") * 7 % 180).alias("x0"), (F.col("s_suppkey") * 11 % 150).alias("y0"), (5 + F.col("s_nationkey") % 7).cast(B).alias("w"), (4 + F.col("s_nationkey") % 5).cast(B).alias("h"))


REQUESTS = "SELECT s_suppkey AS request, s_suppkey * 7 % 180 AS x0, s_suppkey * 11 % 150 AS y0, 5 + s_nationkey % 7 AS w, 4 + s_nationkey % 5 AS h FROM supplier"


def q_patches(s, d):
    got = raster.extract_patches(fx.tiles(s, d), _requests(s, d))
    return got.groupBy("request").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.max("value"), 6).alias("top"))


def _asked(s, d):
    r = _requests(s, d)
    return r.select("request", F.concat(F.lit("s"), (F.col("request") % 2).cast("string")).alias("slide_id"), (F.col("request") % 3 % 2).cast("int").alias("level"), (F.col("x0") % 97).alias("x0"), "y0", "w", "h")


ASKED = f"SELECT request, 's' || (request % 2) AS slide_id, request % 3 % 2 AS level, x0 % 97 AS x0, y0, w, h FROM ({REQUESTS})"


def q_patches_layers(s, d):
    got = raster.extract_patches(fx.layers(s, d), _asked(s, d))
    return got.groupBy("request", F.col("c").cast(B).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def q_patch_arrays(s, d):
    got = raster.patch_arrays(fx.layers(s, d), _asked(s, d), fill=255.0)
    return got.select("request", F.size("samples").cast(B).alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda t, v: t + v), 5).alias("total"), F.round(F.aggregate(F.transform("samples", lambda v, i: v * i), F.lit(0.0), lambda t, v: t + v), 4).alias("placed"))


PATCH_ARRAYS = f"WITH l AS ({LAYERS}), r AS ({ASKED}), k AS (SELECT DISTINCT slide_id, level FROM l), e AS (SELECT r.request, r.w, r.x0, r.y0, r.slide_id, r.level, r.x0 + t.i % r.w AS x, r.y0 + t.i // r.w AS y, c.i AS c FROM r JOIN k USING (slide_id, level), range(200) t(i), range(2) c(i) WHERE t.i < r.w * r.h) SELECT request, count(*) AS n, round(sum(coalesce(value, 255)), 5) AS total, round(sum(coalesce(value, 255) * (((e.y - e.y0) * e.w + e.x - e.x0) * 2 + e.c)), 4) AS placed FROM e LEFT JOIN l ON l.slide_id = e.slide_id AND l.level = e.level AND l.x = e.x AND l.y = e.y AND l.c = e.c GROUP BY 1"


def q_patches_spacing(s, d):
    t = fx.layers(s, d)
    slides = t.select("slide_id").distinct().withColumn("spacing_x", F.lit(0.25)).withColumn("spacing_y", F.lit(0.5))
    levels = t.select("slide_id", "level").distinct().withColumn("downsample", F.pow(F.lit(2.0), F.col("level")))
    got = raster.patches_with_spacing(t, _asked(s, d), levels, slides)
    return got.groupBy("request", F.col("c").cast(B).alias("c"), "spacing_x", "spacing_y", F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value")).agg(F.count(F.lit(1)).alias("n"))


IN_ASKED = f"FROM ({ASKED}) r JOIN ({LAYERS}) l ON l.slide_id = r.slide_id AND l.level = r.level AND l.x >= x0 AND l.x < x0 + w AND l.y >= y0 AND l.y < y0 + h"
SPACED = f"WITH m AS (SELECT slide_id, c, min(value) AS lo, max(value) AS hi FROM ({LAYERS}) WHERE level = 0 GROUP BY 1, 2) SELECT request, l.c, 0.25::DOUBLE * pow(2, r.level) AS spacing_x, 0.5::DOUBLE * pow(2, r.level) AS spacing_y, round(lo, 6) AS min_value, round(hi, 6) AS max_value, count(*) AS n {IN_ASKED} JOIN m ON m.slide_id = l.slide_id AND m.c = l.c GROUP BY ALL"


def q_retile_layers(s, d):
    t = packed.retiled(fx.layers(s, d), 16)
    odd = F.filter("samples", lambda v, i: i % 2 == 1)
    return t.select("slide_id", F.col("level").cast(B).alias("level"), "tile_x", "tile_y", F.col("n_channels").cast(B).alias("n_channels"), F.size("samples").cast(B).alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5).alias("total"), F.round(F.aggregate(odd, F.lit(0.0), lambda a, v: a + v), 5).alias("second"))


def q_store_levels(s, d):
    out = raster.levels_of(fx.layers(s, d)).join(raster.channel_extremes(fx.layers(s, d)), "slide_id")
    return out.select("slide_id", F.col("level").cast(B).alias("level"), F.col("width").cast(B).alias("width"), F.col("height").cast(B).alias("height"), F.round("downsample", 6).alias("downsample"), F.col("c").cast(B).alias("c"), F.round("min_value", 6).alias("min_value"), F.round("max_value", 6).alias("max_value"))


STORE = f"WITH l AS ({LAYERS}), z AS (SELECT slide_id, level, (max(x) // 4 + 1) * 4 AS width, (max(y) // 8 + 1) * 8 AS height FROM l GROUP BY 1, 2), m AS (SELECT slide_id, c, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM l WHERE level = 0 GROUP BY 1, 2) SELECT z.slide_id, CAST(z.level AS BIGINT) AS level, z.width, z.height, round(b.width / CAST(z.width AS DOUBLE), 6) AS downsample, c, min_value, max_value FROM z JOIN z b ON b.slide_id = z.slide_id AND b.level = 0 JOIN m ON m.slide_id = z.slide_id"


def q_samples(s, d):
    t = fx.tiles(s, d).withColumn("samples", F.transform("samples", lambda v: v.cast("double")))
    two = t.withColumn("tile_w", F.lit(4)).withColumn("n_channels", F.lit(2))
    at = lambda c: raster.sample_at(F.col("samples"), F.lit(2), F.lit(3), F.lit(c), F.col("tile_w"), F.col("n_channels"))
    changed = raster.with_sample(F.col("samples"), F.lit(5), F.lit(7.0))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, v: x + v), 5)
    blank = raster.filled(two, 2.5).select("tile_x", "tile_y", total(F.col("samples")).alias("filled"))
    return two.select("tile_x", "tile_y", F.round((at(0) + at(1)) / 2, 6).alias("mean"), total(changed).alias("changed"), F.round(raster.physical_area(F.abs(at(0)), F.lit(0.5), F.lit(0.25)), 6).alias("um2")).join(blank, ["tile_x", "tile_y"])


def q_coverage(s, d):
    t = fx.tiles(s, d).where("tile_x % 5 <> 3")
    levels = fx.tiles(s, d).select("slide_id", "level").distinct().withColumn("width", F.lit(205)).withColumn("height", F.lit(161))
    return raster.coverage(t, levels, 8, 8).select("slide_id", F.col("level").cast(B).alias("level"), "expected", "present")


def q_retile(s, d):
    t = packed.retiled(fx.tiles(s, d), 16)
    return t.select("tile_x", "tile_y", F.size("samples").cast(B).alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


def q_scale_samples(s, d):
    return raster.scale_samples(fx.tiles(s, d), "*", 2.0).select("tile_x", "tile_y", F.round(F.element_at("samples", 3).cast("double"), 6).alias("third"))


def q_box_join(s, d):
    b = fx.boxes(s, d).select("ann_id", F.struct((F.col("cx") - F.col("hx")).alias("x0"), (F.col("cy") - F.col("hy")).alias("y0"), (2 * F.col("hx")).alias("w"), (2 * F.col("hy")).alias("h")).alias("box"))
    # pairs are formed in 32 x 32 cells that both boxes touch
    keys = raster.tile_keys(b.select("ann_id", "box", "box.*"), 32, 32).select("ann_id", "box", "tile_x", "tile_y")
    a = keys.select(F.col("ann_id").alias("a"), F.col("box").alias("p"), "tile_x", "tile_y")
    c = keys.select(F.col("ann_id").alias("b"), F.col("box").alias("q"), "tile_x", "tile_y")
    pairs = a.join(c, ["tile_x", "tile_y"]).where("a < b").where(raster.box_intersects("p", "q")).select("a", "b", raster.box_intersection("p", "q").alias("i")).distinct()
    return pairs.select("a", "b", F.col("i.x0").alias("x0"), F.col("i.y0").alias("y0"), F.col("i.w").alias("w"), F.col("i.h").alias("h"))


BOX = f"SELECT ann_id, cx - hx AS x0, cy - hy AS y0, 2 * hx AS w, 2 * hy AS h FROM ({fx.BOXES})"


def _dense(s, d):
    """All pixels, their width and height; tiles that are missing in the rows of tiles are 0."""
    t = fx.tiles(s, d)
    width, height = _size(t)
    across, down = width // 8, height // 8
    cells = s.range(across * down).select((F.col("id") % max(across, 1)).alias("tile_x"), F.expr(f"id div {max(across, 1)}").alias("tile_y"))
    blank = cells.join(t.select("tile_x", "tile_y"), ["tile_x", "tile_y"], "left_anti")
    blank = blank.select(F.lit("m").alias("slide_id"), F.lit(0).alias("level"), "tile_x", "tile_y", F.lit(8).alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(1).alias("n_channels"), F.array_repeat(F.lit(0.0).cast("float"), 64).alias("samples"))
    px = raster.to_pixels(t.unionByName(blank)).select("slide_id", "x", "y", F.round("value", 6).alias("value"))
    return px, width, height


def q_sobel(s, d):
    px, width, height = _dense(s, d)
    return morph.sobel(px.withColumn("value", F.floor(F.col("value") * 1000).cast("double")), (width, height)).select("slide_id", "x", "y", _unsigned_zero(F.round("gx", 5)).alias("gx"), _unsigned_zero(F.round("gy", 5)).alias("gy"))


CELLS = f"SELECT a.i AS x, b.i AS y, floor(round(coalesce(m.value, 0), 6) * 1000) AS v FROM (SELECT unnest(range(200)) AS i) a, (SELECT unnest(range({HIGH})) AS i) b LEFT JOIN ({MOSAIC}) m ON m.x = a.i AND m.y = b.i"
CLAMP = f"WITH m AS MATERIALIZED ({CELLS}), o AS (SELECT m.x, m.y, dx.i AS dx, dy.i AS dy, n.v FROM m, range(-1, 2) dx(i), range(-1, 2) dy(i), m n WHERE n.x = greatest(0, least(199, m.x + dx.i)) AND n.y = greatest(0, least({HIGH} - 1, m.y + dy.i)))"
SOBEL = CLAMP + " SELECT 'm' AS slide_id, x, y, CASE WHEN gx = 0 THEN 0.0::DOUBLE ELSE gx END AS gx, CASE WHEN gy = 0 THEN 0.0::DOUBLE ELSE gy END AS gy FROM (SELECT x, y, round(sum(v * dx * (2 - abs(dy))), 5) AS gx, round(sum(v * dy * (2 - abs(dx))), 5) AS gy FROM o GROUP BY x, y)"


def q_gradients(s, d):
    px, width, height = _dense(s, d)
    g = morph.gradients(px.withColumn("value", F.floor(F.col("value") * 1000).cast("double")), (width, height))
    return g.select("slide_id", "x", "y", F.round("mag", 5).alias("mag"), _unsigned_zero(F.round("ux", 5)).alias("ux"), _unsigned_zero(F.round("uy", 5)).alias("uy"))


GRADIENTS = f"SELECT slide_id, x, y, round(sqrt(gx * gx + gy * gy), 5) AS mag, CASE WHEN gx = 0 THEN 0.0::DOUBLE ELSE round(gx / sqrt(gx * gx + gy * gy), 5) END AS ux, CASE WHEN gy = 0 THEN 0.0::DOUBLE ELSE round(gy / sqrt(gx * gx + gy * gy), 5) END AS uy FROM ({SOBEL})"


def q_blur(s, d):
    px, width, height = _dense(s, d)
    b = morph.blur(px.withColumn("value", F.floor(F.col("value") * 1000).cast("double")), 3.0, (width, height))
    return b.select("slide_id", "x", "y", _unsigned_zero(F.round("value", 5)).alias("value"))


BLUR = CLAMP + " SELECT 'm' AS slide_id, x, y, CASE WHEN round(s, 5) = 0 THEN 0.0::DOUBLE ELSE round(s, 5) END AS value FROM (SELECT x, y, sum(v * exp(-(dx * dx + dy * dy) / 1.125)) / pow(1 + 2 * exp(-1 / 1.125), 2) AS s FROM o GROUP BY x, y)"


def q_vote(s, d):
    g = fx.grid(s, d).select("slide_id", "x", "y", (F.col("x") % 3 - 1).cast("double").alias("ux"), (F.col("y") % 3 - 1).cast("double").alias("uy"))
    return _whole(morph.votes(g, 2.0, (fx.side(s, d), fx.side(s, d))), "slide_id", "x", "y", "n")


VOTE = f"SELECT slide_id, greatest(0, least({SIDE} - 1, x + 2 * (x % 3 - 1))) AS x, greatest(0, least({SIDE} - 1, y + 2 * (y % 3 - 1))) AS y, count(*) AS n FROM ({GRID}) GROUP BY 1, 2, 3"


def q_symmetry(s, d):
    px, width, height = _dense(s, d)
    out = morph.radial_symmetry(px, [2.0, 3.0], 2.0, 0.05, (width, height))
    return out.select("slide_id", "x", "y", F.round("value", 6).alias("value"))


_RADII = "(VALUES (2.0::DOUBLE), (3.0::DOUBLE)) q(r)"


def _symmetry_sql(beta: float) -> str:
    """CTEs up to y (x, y, value): the mean over radii of the blurred maps of clipped and squared votes."""
    around = lambda t: f"{t} m, range(-1, 2) dx(i), range(-1, 2) dy(i), {t} n WHERE n.x = greatest(0, least(199, m.x + dx.i)) AND n.y = greatest(0, least({HIGH} - 1, m.y + dy.i))"
    return f"""m AS MATERIALIZED (SELECT a.i AS x, b.i AS y, round(coalesce(z.value, 0), 6) AS v FROM (SELECT unnest(range(200)) AS i) a, (SELECT unnest(range({HIGH})) AS i) b LEFT JOIN ({MOSAIC}) z ON z.x = a.i AND z.y = b.i),
s AS (SELECT m.x, m.y, sum(n.v * dx.i * (2 - abs(dy.i))) AS gx, sum(n.v * dy.i * (2 - abs(dx.i))) AS gy FROM {around("m")} GROUP BY 1, 2),
g AS MATERIALIZED (SELECT *, sqrt(gx * gx + gy * gy) AS mag FROM s),
t AS (SELECT r, CAST(greatest(0, least(199, x + floor(0.5 + r * gx / mag))) AS BIGINT) AS x, CAST(greatest(0, least({HIGH} - 1, y + floor(0.5 + r * gy / mag))) AS BIGINT) AS y, count(*) AS n FROM g, {_RADII} WHERE mag > 0 AND mag >= {beta} * (SELECT max(mag) FROM g) GROUP BY 1, 2, 3),
f AS MATERIALIZED (SELECT m.x, m.y, sum(pow(least(coalesce(n, 0), 9.9::DOUBLE) / 9.9, 2)) AS v FROM m CROSS JOIN {_RADII} LEFT JOIN t ON t.r = q.r AND t.x = m.x AND t.y = m.y GROUP BY 1, 2),
y AS MATERIALIZED (SELECT m.x, m.y, sum(n.v * exp(-(dx.i * dx.i + dy.i * dy.i) / 1.125)) / pow(1 + 2 * exp(-1 / 1.125), 2) / 2 AS value FROM {around("f")} GROUP BY 1, 2)"""


def q_hmax(s, d):
    return _whole(morph.h_maxima(_dense(s, d)[0], 0.2), "slide_id", "x", "y")


# a pixel is no maximum if a path of pixels above its value less h leads from it to a higher one; a few steps settle most
def _maxima_sql(h: float) -> str:
    """CTEs from p (x, y, v) to h (x, y)."""
    return f"""i AS MATERIALIZED (SELECT *, x * 1000000 + y AS id FROM p),
e AS MATERIALIZED (SELECT i.id AS u, q.id AS w, q.v FROM i, range(-1, 2) dx(i), range(-1, 2) dy(i), i q WHERE q.x = i.x + dx.i AND q.y = i.y + dy.i AND q.id <> i.id),
near(s, v0, u, v, n) AS (SELECT id, v, id, v, 0 FROM i UNION SELECT near.s, near.v0, e.w, e.v, n + 1 FROM near JOIN e ON e.u = near.u AND e.v > v0 - {h} + 1e-12 WHERE near.v <= v0 + 1e-12 AND n < 3),
c AS MATERIALIZED (SELECT s, v0 FROM near GROUP BY 1, 2 HAVING max(v) <= v0 + 1e-12),
far(s, v0, u, v) AS (SELECT s, v0, s, v0 FROM c UNION SELECT far.s, far.v0, e.w, e.v FROM far JOIN e ON e.u = far.u AND e.v > v0 - {h} + 1e-12 WHERE far.v <= v0 + 1e-12),
h AS MATERIALIZED (SELECT s // 1000000 AS x, s % 1000000 AS y FROM far GROUP BY s, v0 HAVING max(v) <= v0 + 1e-12)"""


HMAX = f"WITH RECURSIVE p AS MATERIALIZED (SELECT a.i AS x, b.i AS y, round(coalesce(m.value, 0), 6) AS v FROM (SELECT unnest(range(200)) AS i) a, (SELECT unnest(range({HIGH})) AS i) b LEFT JOIN ({MOSAIC}) m ON m.x = a.i AND m.y = b.i), {_maxima_sql(0.2)} SELECT 'm' AS slide_id, x, y FROM h"


def q_boundary(s, d):
    n = fx.side(s, d)
    return _whole(morph.outer_boundary(fx.grid(s, d).where("value > 2").withColumn("value", F.lit(1)), (n, n)), "slide_id", "x", "y", "label")


BOUNDARY = REACH.replace("value > 1.5", "value > 2").replace("abs(a.x - b.x) + abs(a.y - b.y) = 1", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)") + f""",
f AS (SELECT t.slide_id, a.i AS x, b.i AS y FROM (SELECT DISTINCT slide_id FROM g) t, (SELECT unnest(range(-1, {SIDE} + 1)) AS i) a, (SELECT unnest(range(-1, {SIDE} + 1)) AS i) b),
w AS (SELECT f.* FROM f ANTI JOIN g USING (slide_id, x, y)),
o(slide_id, x, y) AS (SELECT DISTINCT slide_id, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) FROM g UNION SELECT w.slide_id, w.x, w.y FROM o, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy), w WHERE w.slide_id = o.slide_id AND w.x = o.x + v.dx AND w.y = o.y + v.dy)
SELECT DISTINCT n.slide_id, n.x, n.y, n.label FROM n JOIN o ON o.slide_id = n.slide_id AND abs(o.x - n.x) + abs(o.y - n.y) = 1"""


def q_nuclei(s, d):
    px, width, height = _dense(s, d)
    out = morph.detect_nuclei(px, (width, height), radii=(2.0, 3.0, 1.0))
    return out.select("slide_id", "label", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def q_tile_map(s, d):
    out = tilewise.tile_map(fx.tiles(s, d), lambda a: a[::-1] * 2)
    return out.select("tile_x", "tile_y", F.round(F.element_at("samples", 1), 6).alias("first"))


def q_tile_rows(s, d):
    def spots(image, x0, y0):
        import numpy as np
        import pandas as pd

        y, x, _ = np.nonzero(image > 0.3)
        return pd.DataFrame({"x": x + x0, "y": y + y0})

    return tilewise.tile_flat_map(fx.tiles(s, d), spots, "x bigint, y bigint")


def q_halo(s, d):
    wide = tilewise.with_halo(fx.tiles(s, d), 2)
    return wide.select("tile_x", "tile_y", F.size("samples").cast(B).alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 5).alias("total"))


HALO = f"WITH m AS ({MOSAIC}), t AS (SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y FROM embeddings) SELECT tile_x, tile_y, CAST(144 AS BIGINT) AS n, round(sum(value), 5) AS total FROM t JOIN m ON m.x BETWEEN tile_x * 8 - 2 AND tile_x * 8 + 9 AND m.y BETWEEN tile_y * 8 - 2 AND tile_y * 8 + 9 GROUP BY 1, 2"


def q_overlay_values(s, d):
    coarse = raster.downscale(fx.grid(s, d), 8).select("slide_id", "x", "y", F.round("value", 6).alias("value"))
    return overlay.on_overlay(fx.grid(s, d), coarse, 8).select("slide_id", "x", "y", "value", "overlay")


QUERIES = {
    "q_threshold": (q_threshold, f"SELECT slide_id, x, y, CAST(value >= 2 AND value < 4 AS BIGINT) AS value FROM ({GRID})"),
    "q_label_remove": (q_label_remove, f"SELECT slide_id, CAST(CASE WHEN value IN (1, 3, 7) THEN 0 ELSE value END AS BIGINT) AS value, count(*) AS n FROM ({LABELLED}) GROUP BY 1, 2"),
    "q_label_remove_by_table": (q_label_remove_by_table, f"SELECT slide_id, CAST(CASE WHEN value IN (SELECT s_suppkey % 3 + 1 FROM supplier) THEN 0 ELSE value END AS BIGINT) AS value, count(*) AS n FROM ({LABELLED}) GROUP BY 1, 2"),
    "q_channel": (q_channel, "SELECT 'm' AS slide_id, vec_id % 25 * 4 + (i // 2) % 4 AS x, count(*) AS n, round(sum(CAST(embedding[i + 1] AS DOUBLE)), 6) AS total FROM embeddings, range(64) t(i) WHERE i % 2 = 1 GROUP BY 2"),
    "q_convert": (q_convert, "SELECT l_orderkey, l_linenumber, CAST((t % 256 + 256) % 256 AS BIGINT) AS u8, CAST((t % 65536 + 65536) % 65536 AS BIGINT) AS u16, CAST((t % 4294967296 + 4294967296) % 4294967296 AS BIGINT) AS u32 FROM (SELECT *, CAST(trunc(l_extendedprice - 20000) AS BIGINT) AS t FROM lineitem)"),
    "q_label_stats": (q_label_stats, f"SELECT slide_id, CAST(value AS BIGINT) AS label, round(avg(x), 6) AS cog_x, round(avg(y), 6) AS cog_y, count(*) AS area FROM ({LABELLED}) WHERE value > 0 GROUP BY 1, 2"),
    "q_components": (q_components, REACH + " SELECT * FROM n"),
    "q_component_stats": (q_component_stats, REACH + " SELECT slide_id, label, round(avg(x), 6) AS cog_x, round(avg(y), 6) AS cog_y, count(*) AS area FROM n GROUP BY 1, 2"),
    "q_components_8": (q_components_8, REACH.replace("value > 1.5", "value > 2.5").replace("abs(a.x - b.x) + abs(a.y - b.y) = 1", "abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND (a.x <> b.x OR a.y <> b.y)") + " SELECT slide_id, label, count(*) AS area FROM n GROUP BY 1, 2"),
    "q_distance": (q_distance, DISTANCE),
    "q_distance_within": (q_distance_within, f"SELECT slide_id, count(*) AS n FROM ({DISTANCE}) WHERE d <= 3 GROUP BY 1"),
    "q_runs": (q_runs, RUNS),
    "q_minmax": (q_minmax, f"SELECT slide_id, min(value) AS min_value, max(value) AS max_value FROM ({MOSAIC}) GROUP BY 1"),
    "q_patch_minmax": (q_patch_minmax, "SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, CAST(list_min(embedding) AS DOUBLE) AS min_value, CAST(list_max(embedding) AS DOUBLE) AS max_value FROM embeddings"),
    "q_downscale": (q_downscale, f"SELECT slide_id, x // 4 AS x, y // 4 AS y, round(avg(value), 6) AS value FROM ({MOSAIC}) GROUP BY 1, 2, 3"),
    "q_downscale_nearest": (q_downscale_nearest, f"SELECT slide_id, x // 4 AS x, y // 4 AS y, round(value, 6) AS value FROM ({MOSAIC}) WHERE x % 4 = 0 AND y % 4 = 0"),
    "q_pyramid": (q_pyramid, PYRAMID),
    "q_region": (q_region, REGION),
    "q_patches": (q_patches, f"SELECT request, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS top FROM ({REQUESTS}) r JOIN ({MOSAIC}) m ON m.x >= x0 AND m.x < x0 + w AND m.y >= y0 AND m.y < y0 + h GROUP BY 1"),
    "q_patches_layers": (q_patches_layers, f"SELECT request, l.c, count(*) AS n, round(sum(value), 6) AS total {IN_ASKED} GROUP BY 1, 2"),
    "q_patch_arrays": (q_patch_arrays, PATCH_ARRAYS),
    "q_patches_spacing": (q_patches_spacing, SPACED),
    "q_retile_layers": (q_retile_layers, f"SELECT slide_id, CAST(level AS BIGINT) AS level, x // 16 AS tile_x, y // 16 AS tile_y, CAST(2 AS BIGINT) AS n_channels, CAST(512 AS BIGINT) AS n, round(sum(value), 5) AS total, round(sum(CASE WHEN c = 1 THEN value ELSE 0 END), 5) AS second FROM ({LAYERS}) GROUP BY 1, 2, 3, 4"),
    "q_store_levels": (q_store_levels, STORE),
    "q_samples": (q_samples, "SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, round((CAST(embedding[29] AS DOUBLE) + CAST(embedding[30] AS DOUBLE)) / 2, 6) AS mean, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) - CAST(embedding[6] AS DOUBLE) + 7, 5) AS changed, round(abs(CAST(embedding[29] AS DOUBLE)) * 0.125, 6) AS um2, 160.0::DOUBLE AS filled FROM embeddings"),
    "q_gradients": (q_gradients, GRADIENTS),
    "q_blur": (q_blur, BLUR),
    "q_coverage": (q_coverage, "SELECT 'm' AS slide_id, CAST(0 AS BIGINT) AS level, CAST(26 * 21 AS BIGINT) AS expected, count(*) AS present FROM embeddings WHERE vec_id % 25 % 5 <> 3"),
    "q_retile": (q_retile, f"SELECT x // 16 AS tile_x, y // 16 AS tile_y, CAST(256 AS BIGINT) AS n, round(sum(value), 6) AS total FROM ({MOSAIC}) GROUP BY 1, 2"),
    "q_scale_samples": (q_scale_samples, "SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, round(CAST(embedding[3] AS DOUBLE) * 2, 6) AS third FROM embeddings"),
    "q_box_join": (q_box_join, f"WITH b AS ({BOX}) SELECT a.ann_id AS a, b.ann_id AS b, greatest(a.x0, b.x0) AS x0, greatest(a.y0, b.y0) AS y0, least(a.x0 + a.w, b.x0 + b.w) - greatest(a.x0, b.x0) AS w, least(a.y0 + a.h, b.y0 + b.h) - greatest(a.y0, b.y0) AS h FROM b a JOIN b ON a.ann_id < b.ann_id AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h"),
    "q_sobel": (q_sobel, SOBEL),
    "q_vote": (q_vote, VOTE),
    "q_symmetry": (q_symmetry, f"WITH {_symmetry_sql(0.05)} SELECT 'm' AS slide_id, x, y, round(value, 6) AS value FROM y"),
    "q_hmax": (q_hmax, HMAX),
    "q_boundary": (q_boundary, BOUNDARY),
    "q_nuclei": (q_nuclei, None),
    "q_tile_map": (q_tile_map, "SELECT vec_id % 25 AS tile_x, vec_id // 25 AS tile_y, round(CAST(embedding[57] AS DOUBLE) * 2, 6) AS first FROM embeddings"),
    "q_tile_rows": (q_tile_rows, f"SELECT slide_id, x, y FROM ({MOSAIC}) WHERE value > 0.3"),
    "q_halo": (q_halo, HALO),
    "q_overlay_values": (q_overlay_values, f"WITH g AS ({GRID}), c AS (SELECT slide_id, x // 8 AS x, y // 8 AS y, round(avg(value), 6) AS value FROM g GROUP BY 1, 2, 3) SELECT g.slide_id, g.x, g.y, g.value, c.value AS overlay FROM g LEFT JOIN c ON c.slide_id = g.slide_id AND c.x = g.x // 8 AND c.y = g.y // 8"),
}
