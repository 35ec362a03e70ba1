"""Queries on slides of several channels, levels and sizes: pyramids, the tile store, masks, regions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import morph, overlay, pyramid, raster, scanline, store, tilewise, vector
from . import fixtures as fx
from .fixtures import LAYERS, MOSAICS, SIDE
from .grid_queries import BOUNDARY
from .iterate import scratch
from .shape_queries import EDGES

B = "bigint"
LEVELS = 3


def _big(df, *names):
    return df.select(*(F.col(c).cast(B).alias(c) if c != "slide_id" else F.col(c) for c in names))


def q_downscale_layers(s, d):
    px = raster.to_pixels(fx.layers(s, d)).select("slide_id", "level", "c", "x", "y", "value")
    return raster.downscale(px, 4).select("slide_id", *(F.col(c).cast(B).alias(c) for c in ("level", "c", "x", "y")), F.round("value", 6).alias("value"))


def q_region_layers(s, d):
    out = raster.read_region(fx.mosaics(s, d).drop("vec_id"), 5, 9, 30, 40, fill=-1.0, channel_=None)
    return _big(out, "slide_id", "x", "y", "c", "value")


REGION_LAYERS = f"SELECT k.slide_id, a.i AS x, b.i AS y, c.i AS c, CAST(coalesce(value, -1) AS BIGINT) AS value FROM (SELECT DISTINCT slide_id FROM ({MOSAICS})) k CROSS JOIN range(5, 35) a(i) CROSS JOIN range(9, 49) b(i) CROSS JOIN range(2) c(i) LEFT JOIN ({MOSAICS}) m ON m.slide_id = k.slide_id AND m.x = a.i AND m.y = b.i AND m.c = c.i"


def _pyramid_sql(base: str, nearest: bool = False) -> str:
    """CTEs: l0 .. l3 (slide_id, x, y, c, value), where absent pixels are 0; w (sizes); p: all pixels of tiles that have a base tile below, inside their level."""
    step = "max(CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN value END)" if nearest else "trunc(sum(value) / 4)"
    levels = ", ".join(f"l{n} AS MATERIALIZED (SELECT slide_id, x // 2 AS x, y // 2 AS y, c, coalesce({step}, 0) AS value FROM l{n - 1} GROUP BY ALL)" for n in range(1, LEVELS + 1))
    pixels = " UNION ALL ".join(f"SELECT t.slide_id, {n} AS level, t.tx * 4 + k.i // 2 % 4 AS x, t.ty * 8 + k.i // 8 AS y, k.i % 2 AS c, coalesce(value, 0) AS value FROM (SELECT DISTINCT slide_id, x // {4 * 2**n} AS tx, y // {8 * 2**n} AS ty FROM l0) t CROSS JOIN range(64) k(i) JOIN w ON w.slide_id = t.slide_id AND t.tx * 4 + k.i // 2 % 4 < w.w // {2**n} AND t.ty * 8 + k.i // 8 < w.h // {2**n} LEFT JOIN l{n} l ON l.slide_id = t.slide_id AND l.x = t.tx * 4 + k.i // 2 % 4 AND l.y = t.ty * 8 + k.i // 8 AND l.c = k.i % 2" for n in range(LEVELS + 1))
    return f"l0 AS MATERIALIZED ({base}), w AS (SELECT slide_id, (max(x) // 4 + 1) * 4 AS w, (max(y) // 8 + 1) * 8 AS h FROM l0 GROUP BY 1), {levels}, p AS ({pixels})"


def _pixels_inside(tiles, levels):
    """Pixels inside their level, so that what lies in the padding of tiles plays no part."""
    px = raster.to_pixels(tiles).join(levels.select("slide_id", "level", "width", "height"), ["slide_id", "level"])
    return _big(px.where("x < width and y < height"), "slide_id", "level", "x", "y", "c", "value")


def _pyramid(s, d, interpolation):
    base = fx.mosaics(s, d).drop("vec_id")
    tiles = pyramid.build_tile_pyramid(base, factor=2, max_levels=LEVELS, interpolation=interpolation, integer=True, stride=2)
    return _pixels_inside(tiles, pyramid.level_table(pyramid.sizes_of(base), 2, LEVELS))


def q_tile_pyramid(s, d):
    return _pyramid(s, d, "linear")


def q_tile_pyramid_nearest(s, d):
    return _pyramid(s, d, "nearest")


_BASE = f"SELECT slide_id, x, y, c, value FROM ({MOSAICS})"
_WHOLE = "SELECT slide_id, CAST(level AS BIGINT) AS level, x, y, c, CAST(value AS BIGINT) AS value FROM p"


def _filled_store(s, d):
    """A store after four writes: some tiles, the others, every seventh once more with other samples, and the last batch again."""
    path = f"{scratch(s)}/store-{uuid.uuid4().hex}"
    store.create(s, path, max_levels=LEVELS, integer=True)
    t = fx.mosaics(s, d)
    again = t.where("vec_id % 7 = 0").withColumn("samples", F.transform("samples", lambda v: 5000 - v))
    store.upsert(t.where("vec_id % 3 <> 1").drop("vec_id"), path, batch="first")
    store.upsert(t.where("vec_id % 3 = 1").drop("vec_id"), path, batch="second")
    for _ in range(2):
        store.upsert(again.drop("vec_id"), path, batch="third")
    return path


_STORED = f"SELECT slide_id, x, y, c, CASE WHEN vec_id % 7 = 0 THEN 5000 - value ELSE value END AS value FROM ({MOSAICS})"


def q_store_tiles(s, d):
    path = _filled_store(s, d)
    return _pixels_inside(store.read_tiles(s, path), store.read_levels(s, path))


def q_store_about(s, d):
    path = _filled_store(s, d)
    out = store.read_levels(s, path).join(store.read_slides(s, path), "slide_id")
    return out.select("slide_id", *(F.col(c).cast(B).alias(c) for c in ("level", "width", "height", "c", "min_value", "max_value")), F.round("downsample", 6).alias("downsample"))


STORE_ABOUT = f"WITH l AS ({_STORED}), w AS (SELECT slide_id, (max(x) // 4 + 1) * 4 AS w, (max(y) // 8 + 1) * 8 AS h FROM l GROUP BY 1), m AS (SELECT slide_id, c, CAST(min(value) AS BIGINT) AS min_value, CAST(max(value) AS BIGINT) AS max_value FROM l GROUP BY 1, 2) SELECT w.slide_id, n.i AS level, w // (1 << n.i) AS width, h // (1 << n.i) AS height, c, min_value, max_value, round(w / CAST(w // (1 << n.i) AS DOUBLE), 6) AS downsample FROM w JOIN m USING (slide_id), range({LEVELS + 1}) n(i)"


def q_copy_image(s, d):
    """Every slide in a new store with tiles of 16 x 16 samples, its spacing overridden."""
    path = f"{scratch(s)}/copy-{uuid.uuid4().hex}"
    base = fx.mosaics(s, d).drop("vec_id")
    store.copy_image(base, path, 16, spacing=(0.25, 0.5), max_levels=1, interpolation="nearest")
    about = store.read_slides(s, path)
    px = _pixels_inside(store.read_tiles(s, path), store.read_levels(s, path)).where("value <> 0")
    out = px.groupBy("slide_id", "level", "c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * (F.col("x") + 1) * (F.col("y") + 1)).alias("total"))
    return out.join(about.select("slide_id", F.col("c").cast(B).alias("c"), F.col("min_value").cast(B).alias("min_value"), F.col("max_value").cast(B).alias("max_value"), "spacing_x", "spacing_y"), ["slide_id", "c"])


COPY_IMAGE = f"WITH l AS ({_BASE}), w AS (SELECT slide_id, (max(x) // 4 + 1) * 4 AS w, (max(y) // 8 + 1) * 8 AS h FROM l GROUP BY 1), t AS (SELECT DISTINCT slide_id, x // 16 AS tx, y // 16 AS ty FROM l), m AS (SELECT t.slide_id, k.i AS c, least(min(coalesce(value, 0)), 0) AS lo, greatest(max(coalesce(value, 0)), 0) AS hi, count(value) AS n, count(DISTINCT (tx, ty)) * 256 AS want FROM t CROSS JOIN range(2) k(i) LEFT JOIN l ON l.slide_id = t.slide_id AND l.x // 16 = tx AND l.y // 16 = ty AND l.c = k.i GROUP BY 1, 2), p AS (SELECT slide_id, 0 AS level, c, x, y, value FROM l UNION ALL SELECT l.slide_id, 1, c, x // 2, y // 2, value FROM l JOIN w USING (slide_id) WHERE x % 2 = 0 AND y % 2 = 0 AND x // 2 < w // 2 AND y // 2 < h // 2) SELECT p.slide_id, CAST(level AS BIGINT) AS level, p.c, count(*) AS n, CAST(sum(value * (x + 1) * (y + 1)) AS BIGINT) AS total, CAST(any_value(CASE WHEN m.n < m.want THEN lo ELSE (SELECT min(value) FROM l WHERE l.slide_id = p.slide_id AND l.c = p.c) END) AS BIGINT) AS min_value, CAST(any_value(CASE WHEN m.n < m.want THEN hi ELSE (SELECT max(value) FROM l WHERE l.slide_id = p.slide_id AND l.c = p.c) END) AS BIGINT) AS max_value, 0.25::DOUBLE AS spacing_x, 0.5::DOUBLE AS spacing_y FROM p JOIN m ON m.slide_id = p.slide_id AND m.c = p.c WHERE value <> 0 GROUP BY 1, 2, 3"


def _frame(s, d):
    n = fx.side(s, d)
    return fx.polygons(s, d).select("slide_id").distinct().withColumn("width", F.lit(n)).withColumn("height", F.lit(n))


def q_mask_tiles(s, d):
    tiles = scanline.mask_tiles(fx.polygons(s, d), 32, sizes=_frame(s, d))
    return _big(raster.to_pixels(tiles).where("value > 0"), "slide_id", "x", "y", "value")


# every pixel of each polygon's box, and whether its winding number is not 0
_BOXED = f"SELECT b.slide_id, b.ann_id, b.label, x.i AS x, y.i AS y FROM (SELECT DISTINCT slide_id, ann_id, label, x0, x1, y0, y1 FROM ({EDGES})) b, LATERAL (SELECT unnest(range(b.x0 + 1, b.x1)) AS i) x, LATERAL (SELECT unnest(range(b.y0 + 1, b.y1)) AS i) y"
PAINTED = f"SELECT g.slide_id, g.x, g.y, g.ann_id, g.label FROM ({_BOXED}) g JOIN ({EDGES}) e ON g.slide_id = e.slide_id AND g.ann_id = e.ann_id GROUP BY ALL HAVING sum(CASE WHEN ay <= g.y AND by_ > g.y AND (bx - ax) * (g.y - ay) - (g.x - ax) * (by_ - ay) > 0 THEN 1 WHEN ay > g.y AND by_ <= g.y AND (bx - ax) * (g.y - ay) - (g.x - ax) * (by_ - ay) < 0 THEN -1 ELSE 0 END) <> 0"


def q_mask_runs(s, d):
    order = fx.table(s, d, "nation").where("n_nationkey % 3 <> 1").select((F.col("n_nationkey") + 1).cast(B).alias("label"), (F.col("n_nationkey") * 7 % 25).alias("pos"))
    return _big(scanline.mask_runs(fx.polygons(s, d), order, band=16), "slide_id", "y", "x0", "x1", "value")


MASK_RUNS = f"WITH p AS (SELECT slide_id, x, y, arg_max(label, n_nationkey * 7 % 25 * 1000000 + ann_id) AS value FROM ({PAINTED}) JOIN nation ON n_nationkey + 1 = label WHERE n_nationkey % 3 <> 1 GROUP BY 1, 2, 3), i AS (SELECT *, x - row_number() OVER (PARTITION BY slide_id, y, value ORDER BY x) AS island FROM p) SELECT slide_id, y, min(x) AS x0, max(x) AS x1, CAST(value AS BIGINT) AS value FROM i GROUP BY slide_id, y, value, island"


def q_border_cells(s, d):
    """How many cells settle each polygon: with 4-pixel cells, those on the border and those that are inside as a whole."""
    cells = vector.border_cells(fx.polygons(s, d), True, 4, ("slide_id",))
    return cells.groupBy("slide_id", "ann_id").agg((F.max("_cy") - F.min("_cy") + 1).cast(B).alias("cell_rows"), F.countDistinct("_cy").alias("n_rows"))


BORDER = f"SELECT slide_id, ann_id, CAST(floor(max(y) / 4.0) - floor(min(y) / 4.0) + 1 AS BIGINT) AS cell_rows, CAST(floor(max(y) / 4.0) - floor(min(y) / 4.0) + 1 AS BIGINT) AS n_rows FROM ({fx.CORNERS}) GROUP BY 1, 2"


def _slide_points(s, d):
    p, n = fx.table(s, d, "part"), fx.side(s, d)
    slide = F.element_at(F.array(*(F.lit(x) for x in "ANR")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(slide.alias("slide_id"), F.col("p_partkey").alias("point_id"), (F.col("p_partkey") * 31 % n).cast("double").alias("x"), (F.col("p_partkey") * 17 % n).cast("double").alias("y"))


def q_nearest_slides(s, d):
    out = vector.nearest_shape(_slide_points(s, d), fx.polygons(s, d), 3.0)
    return out.select("slide_id", "point_id", F.col("kind").cast(B).alias("kind"), F.round("d2", 5).alias("d2"))


NEAREST_SLIDES = f"WITH p AS (SELECT substr('ANR', CAST(p_partkey % 3 + 1 AS INT), 1) AS slide_id, p_partkey AS point_id, CAST(p_partkey * 31 % {SIDE} AS DOUBLE) AS x, CAST(p_partkey * 17 % {SIDE} AS DOUBLE) AS y FROM part), e AS ({EDGES}), q AS (SELECT p.slide_id, point_id, (x - ax) * (x - ax) + (y - ay) * (y - ay) AS v2, CASE WHEN bx = ax AND by_ = ay THEN 0 ELSE greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE))) END AS t, x, y, ax, ay, bx, by_ FROM p JOIN e ON e.slide_id = p.slide_id), z AS (SELECT slide_id, point_id, v2, (x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2 AS e2 FROM q) SELECT slide_id, point_id, CAST(CASE WHEN min(v2) <= 9 THEN 0 ELSE 1 END AS BIGINT) AS kind, round(CASE WHEN min(v2) <= 9 THEN min(v2) ELSE min(e2) END, 5) AS d2 FROM z GROUP BY 1, 2 HAVING min(v2) <= 9 OR min(e2) <= 9"


def q_move_slides(s, d):
    """Equal ann_ids on every slide; only those of the named slide move."""
    anns = fx.table(s, d, "supplier").select(F.explode(F.array(F.lit("A"), F.lit("N"))).alias("slide_id"), F.col("s_suppkey").alias("ann_id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("group_name"))
    moves = fx.table(s, d, "supplier").where("s_suppkey % 4 = 0").select(F.lit("N").alias("slide_id"), F.col("s_suppkey").alias("ann_id"), F.lit("moved").alias("new_group"))
    return vector.move_members(anns, moves)


def _odd_values(s, d):
    """Slide A has one value only, and some values are null."""
    v = F.when(F.col("x") % 7 == 0, F.lit(None)).when(F.col("slide_id") == "A", 1).otherwise(F.col("value"))
    return fx.grid(s, d).withColumn("value", v.cast("double"))


def q_lut_odd(s, d):
    g = _odd_values(s, d)
    out = overlay.colorize(g, overlay.lut(s, "Background"), minmax=raster.min_max(g))
    return out.groupBy("slide_id", "value", F.col("red").cast(B).alias("red"), F.col("alpha").cast(B).alias("alpha")).agg(F.count(F.lit(1)).alias("n"))


LUT_ODD = f"WITH g AS (SELECT slide_id, CAST(CASE WHEN x % 7 = 0 THEN NULL WHEN slide_id = 'A' THEN 1 ELSE value END AS DOUBLE) AS value FROM ({fx.GRID})), m AS (SELECT slide_id, min(value) AS lo, max(value) AS hi FROM g GROUP BY 1) SELECT g.slide_id, value, CAST(CASE WHEN value IS NULL THEN NULL WHEN hi = lo THEN 255 ELSE floor((value - lo) / (hi - lo) * 255 + 1e-9) END AS BIGINT) AS red, CAST(CASE WHEN value IS NOT NULL THEN 255 END AS BIGINT) AS alpha, count(*) AS n FROM g JOIN m ON m.slide_id = g.slide_id GROUP BY 1, 2, 3, 4"


def q_best_level_repeated(s, d):
    """Equal requests keep their rows."""
    levels = fx.layers(s, d).select("slide_id", "level").distinct().withColumn("downsample", F.pow(F.lit(2.0), F.col("level")))
    asked = fx.table(s, d, "supplier").select(F.concat(F.lit("s"), (F.col("s_suppkey") % 2).cast("string")).alias("slide_id"), (F.col("s_suppkey") % 5 * 0.4).alias("downsample"))
    return overlay.best_level(levels, asked).groupBy("slide_id", F.round("downsample", 3).alias("downsample"), F.col("level").cast(B).alias("level")).agg(F.count(F.lit(1)).alias("n"))


BEST_REPEATED = f"WITH a AS (SELECT 's' || (s_suppkey % 2) AS slide_id, s_suppkey % 5 * 0.4::DOUBLE AS downsample FROM supplier), k AS (SELECT DISTINCT slide_id, level FROM ({LAYERS})) SELECT a.slide_id, round(downsample, 3) AS downsample, CAST(CASE WHEN downsample >= 1.5 AND (SELECT count(*) FROM k WHERE k.slide_id = a.slide_id) > 1 THEN 1 ELSE 0 END AS BIGINT) AS level, count(*) AS n FROM a WHERE a.slide_id IN (SELECT slide_id FROM k) GROUP BY 1, 2, 3"


def _uneven(s, d):
    """Sizes of the grid's slides: whole, half as wide, a third as high."""
    n = fx.side(s, d)
    return s.createDataFrame([("A", n, n), ("N", n // 2, n), ("R", n, n // 3)], "slide_id string, width bigint, height bigint")


_UNEVEN = f"SELECT 'A' AS slide_id, {SIDE} AS w, {SIDE} AS h UNION ALL SELECT 'N', {SIDE} // 2, {SIDE} UNION ALL SELECT 'R', {SIDE}, {SIDE} // 3"


def q_distance_sizes(s, d):
    return morph.distance_transform(fx.grid(s, d).where("value >= 4"), _uneven(s, d)).select("slide_id", "x", "y", "d")


DISTANCE_SIZES = f"WITH z AS MATERIALIZED ({_UNEVEN}), s AS MATERIALIZED (SELECT g.slide_id, x, y, w, h FROM ({fx.GRID}) g JOIN z USING (slide_id) WHERE value >= 4 AND x < w AND y < h), p AS (SELECT z.slide_id, z.w, z.h, a.i AS x, b.i AS y FROM z JOIN range({SIDE}) a(i) ON a.i < z.w JOIN range({SIDE}) b(i) ON b.i < z.h) SELECT p.slide_id, p.x, p.y, CAST(least(min(abs(p.x - s.x) + abs(p.y - s.y)), any_value(p.w + p.h // 2 + 1)) AS BIGINT) AS d FROM p JOIN s ON s.slide_id = p.slide_id GROUP BY 1, 2, 3"


def q_holes(s, d):
    """Of each slide: how many blobs there are, and how many background pixels lie in holes."""
    n = fx.side(s, d)
    tree = morph.containment(fx.grid(s, d).where("value > 2").withColumn("value", F.lit(1)), (n, n))
    hole = (F.col("kind") == "hole") & F.col("parent").isNotNull()
    return tree.groupBy("slide_id").agg(F.count(F.when(F.col("kind") == "blob", 1)).alias("n_blobs"), F.sum(F.when(hole, F.col("area")).otherwise(0)).alias("hole_area"))


HOLES = BOUNDARY.rsplit("SELECT DISTINCT n.slide_id", 1)[0] + "SELECT a.slide_id, n_blobs, CAST(free - outside AS BIGINT) AS hole_area FROM (SELECT slide_id, max(label) AS n_blobs FROM n GROUP BY 1) a JOIN (SELECT slide_id, count(*) AS free FROM w GROUP BY 1) b USING (slide_id) JOIN (SELECT slide_id, count(*) AS outside FROM o GROUP BY 1) c USING (slide_id)"


def q_tile_function(s, d):
    """A user's function on tiles, called from SQL."""

    def spots(image, x0, y0):
        import numpy as np

        y, x, c = np.nonzero(image > 300)
        return [(int(a + x0), int(b + y0), int(k)) for a, b, k in zip(x, y, c, strict=True)]

    tilewise.register_tile_function(s, "tile_spots", spots, "x bigint, y bigint, c bigint", tilewise.channels(2))
    fx.mosaics(s, d).createOrReplaceTempView("tilewright_mosaics")
    return s.sql("SELECT slide_id, x, y, c FROM tile_spots(TABLE(tilewright_mosaics) PARTITION BY (slide_id, tile_y))")


def q_arithmetic(s, d):
    """All four operators on packed samples."""
    out = None
    for op, k in (("+", 3.0), ("-", 3.0), ("*", 3.0), ("/", 4.0)):
        one = raster.scale_samples(fx.mosaics(s, d), op, k).select("vec_id", F.lit(op).alias("op"), F.element_at("samples", 7).alias("seventh"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


ARITHMETIC = " UNION ALL ".join(f"SELECT vec_id, '{op}' AS op, floor(CAST(embedding[7] AS DOUBLE) * 1000) {op} {k} AS seventh, list_sum(list_transform(embedding, lambda v: floor(CAST(v AS DOUBLE) * 1000) {op} {k})) AS total FROM embeddings" for op, k in (("+", "3.0::DOUBLE"), ("-", "3.0::DOUBLE"), ("*", "3.0::DOUBLE"), ("/", "4.0::DOUBLE")))


QUERIES = {
    "q_downscale_layers": (q_downscale_layers, f"SELECT slide_id, CAST(level AS BIGINT) AS level, c, x // 4 AS x, y // 4 AS y, round(avg(value), 6) AS value FROM ({LAYERS}) GROUP BY ALL"),
    "q_region_layers": (q_region_layers, REGION_LAYERS),
    "q_tile_pyramid": (q_tile_pyramid, f"WITH {_pyramid_sql(_BASE)} {_WHOLE}"),
    "q_tile_pyramid_nearest": (q_tile_pyramid_nearest, f"WITH {_pyramid_sql(_BASE, nearest=True)} {_WHOLE}"),
    "q_store_tiles": (q_store_tiles, f"WITH {_pyramid_sql(_STORED)} {_WHOLE}"),
    "q_store_about": (q_store_about, STORE_ABOUT),
    "q_copy_image": (q_copy_image, COPY_IMAGE),
    "q_mask_tiles": (q_mask_tiles, f"SELECT slide_id, x, y, CAST(max(label) AS BIGINT) AS value FROM ({PAINTED}) WHERE x >= 0 AND y >= 0 AND x < {SIDE} AND y < {SIDE} GROUP BY 1, 2, 3"),
    "q_mask_runs": (q_mask_runs, MASK_RUNS),
    "q_border_cells": (q_border_cells, BORDER),
    "q_nearest_slides": (q_nearest_slides, NEAREST_SLIDES),
    "q_move_slides": (q_move_slides, "SELECT s.i AS slide_id, s_suppkey AS ann_id, CASE WHEN s.i = 'N' AND s_suppkey % 4 = 0 THEN 'moved' ELSE 'n' || s_nationkey END AS group_name FROM supplier, (VALUES ('A'), ('N')) s(i)"),
    "q_lut_odd": (q_lut_odd, LUT_ODD),
    "q_best_level_repeated": (q_best_level_repeated, BEST_REPEATED),
    "q_arithmetic": (q_arithmetic, ARITHMETIC),
    "q_distance_sizes": (q_distance_sizes, DISTANCE_SIZES),
    "q_holes": (q_holes, HOLES),
    "q_tile_function": (q_tile_function, f"SELECT slide_id, x, y, c FROM ({MOSAICS}) WHERE value > 300"),
}
