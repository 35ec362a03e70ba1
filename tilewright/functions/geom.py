"""Geometry expressions on points and rings; ``coords`` is ARRAY<STRUCT<ord, x, y>>, closed implicitly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def _projected2(ax, ay, bx, by, px, py, low: bool, high: bool) -> Column:
    vx, vy = bx - ax, by - ay
    cv, cw = dot(vx, vy, vx, vy), dot(px - ax, py - ay, vx, vy)
    t = F.when(cv == 0, 0.0).otherwise(cw / cv)
    if low:
        t = F.when(cw <= 0, 0.0).otherwise(t)
    if high:
        t = F.when((cw > 0) & (cv <= cw), 1.0).otherwise(t)
    return dist2(px, py, ax + t * vx, ay + t * vy)


def line_dist2(ax, ay, bx, by, px, py) -> Column:
    """Squared distance of p to the line through a and b (to a where they are equal)."""
    return _projected2(ax, ay, bx, by, px, py, False, False)


def segment_dist2(ax, ay, bx, by, px, py) -> Column:
    return _projected2(ax, ay, bx, by, px, py, True, True)


def ray_dist2(ax, ay, bx, by, px, py) -> Column:
    return _projected2(ax, ay, bx, by, px, py, True, False)


def is_left(ax, ay, bx, by, px, py) -> Column:
    """Over 0 where p is left of a -> b, by the cross product truncated to an integer."""
    return ((bx - ax) * (py - ay) - (px - ax) * (by - ay)).cast("int")


def _ring_sum(coords: Column, term) -> Column:
    """The sum of term(point, next point) around the ring."""
    following = F.concat(F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 1, 1))
    return F.aggregate(F.zip_with(coords, following, term), F.lit(0.0), lambda a, v: a + v)


def area(coords: Column) -> Column:
    return F.abs(0.5 * _ring_sum(coords, lambda p, q: (p["x"] + q["x"]) * (p["y"] - q["y"])))


def is_clockwise(coords: Column) -> Column:
    return _ring_sum(coords, lambda p, q: (q["x"] - p["x"]) * (q["y"] + p["y"])) < 0


def clockwise(coords: Column) -> Column:
    """The ring, reversed if it is not clockwise."""
    return F.when(~is_clockwise(coords), F.reverse(coords)).otherwise(coords)


def bbox(coords: Column) -> Column:
    xs, ys = F.transform(coords, lambda p: p["x"]), F.transform(coords, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def center(coords: Column) -> Column:
    b = bbox(coords)
    return F.struct(((b["x0"] + b["x1"]) / 2).alias("x"), ((b["y0"] + b["y1"]) / 2).alias("y"))


def centered_bbox(coords: Column) -> Column:
    b, c = bbox(coords), center(coords)
    return F.struct((b["x0"] - c["x"]).alias("x0"), (b["y0"] - c["y"]).alias("y0"), (b["x1"] - c["x"]).alias("x1"), (b["y1"] - c["y"]).alias("y1"))


def n_points(coords: Column) -> Column:
    return F.size(coords)


def at(coords: Column, index: int) -> Column:
    """The point at an index; a negative one counts from the end; null beyond."""
    return F.try_element_at(coords, F.lit(index + 1 if index >= 0 else index))


def inserted_at(coords: Column, index: int, point: Column) -> Column:
    """The ring with a point before ``index`` (a negative one counts from the end)."""
    i = F.lit(index) if index >= 0 else F.size(coords) + index
    return F.concat(F.slice(coords, F.lit(1), i), F.array(point), F.slice(coords, i + 1, F.greatest(F.size(coords) - i, F.lit(0))))


def removed_at(coords: Column, index: int) -> Column:
    i = F.lit(index) if index >= 0 else F.size(coords) + index
    return F.filter(coords, lambda p, k: k != i)


def _two_places(v: Column) -> Column:
    """Rounded to two places by the value itself: 5.015 lies below the tie that its shortest decimal shows, which ``F.round`` goes by."""
    return F.round(v * 100) / 100


def measure_text(length_um: Column) -> Column:
    """Length as text, in mm from 1000 um on."""
    return F.when(length_um > 1000, F.concat(_two_places(length_um / 1000).cast("string"), F.lit(" mm"))).otherwise(F.concat(_two_places(length_um).cast("string"), F.lit(" um")))


def area_text(area_um2: Column) -> Column:
    """Area as text, in mm2 from 1e6 um2 on."""
    return F.when(area_um2 > 1e6, F.concat(_two_places(area_um2 / 1e6).cast("string"), F.lit(" mm2"))).otherwise(F.concat(_two_places(area_um2).cast("string"), F.lit(" um2")))


def path_length(coords: Column, spacing_x: Column, spacing_y: Column) -> Column:
    """Distance of the first to the last vertex in um."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    dx, dy = (a["x"] - b["x"]) * spacing_x, (a["y"] - b["y"]) * spacing_y
    return F.sqrt(dx * dx + dy * dy)


def level_to_base(v: Column, downsample: Column) -> Column:
    return v * downsample


def base_to_level(v: Column, downsample: Column) -> Column:
    return F.floor(v / downsample + 0.5)


def to_tile(v: Column, size: Column) -> Column:
    return F.floor(v / size)


def nm_to_pixel(v: Column, offset: Column, mpp: Column, extent: Column) -> Column:
    """Nanometres from the slide's centre to pixels."""
    return (v - offset) / (mpp * 1000.0) + extent / 2.0


def spacing_to_resolution(v: Column) -> Column:
    """um a pixel to pixels a cm, and back."""
    return F.lit(10000.0) / v


def bezier_controls(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    """Control points of the cubic from p1 to p2 of a centripetal Catmull-Rom spline."""
    d = [F.sqrt(F.sqrt(dist2(a["x"], a["y"], b["x"], b["y"]))) for a, b in ((p0, p1), (p1, p2), (p2, p3))]
    d2 = F.when(d[1] < 1e-4, 1.0).otherwise(d[1])
    d1 = F.when(d[0] < 1e-4, d2).otherwise(d[0])
    d3 = F.when(d[2] < 1e-4, d2).otherwise(d[2])

    def c1(k: str) -> Column:
        return (d1 * d1 * p2[k] - d2 * d2 * p0[k] + (2 * d1 * d1 + 3 * d1 * d2 + d2 * d2) * p1[k]) / (3 * d1 * (d1 + d2))

    def c2(k: str) -> Column:
        return (d3 * d3 * p1[k] - d2 * d2 * p3[k] + (2 * d3 * d3 + 3 * d3 * d2 + d2 * d2) * p2[k]) / (3 * d3 * (d3 + d2))

    return F.struct(c1("x").alias("x1"), c1("y").alias("y1"), c2("x").alias("x2"), c2("y").alias("y2"))
