"""Annotations, groups and polygons: point-in-polygon joins, rasterising, roll-ups, stitching, nearest shapes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.iterate import discard, written


def edges(polygons: DataFrame, *keep: str) -> DataFrame:
    """One row for each edge of the closed rings: ann_id, .., i, ax, ay, bx, by."""
    c = F.col("coords")
    pairs = F.zip_with(c, F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 1, 1)), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    return polygons.select("ann_id", *keep, F.posexplode(pairs).alias("i", "e")).select("ann_id", *keep, "i", "e.*")


def _shared(a: DataFrame, b: DataFrame) -> tuple[str, ...]:
    """Tables that both know their slide only meet inside it."""
    return ("slide_id",) if "slide_id" in a.columns and "slide_id" in b.columns else ()


#: Side of the smallest cells, how many cells make a cell of the next level, and the highest level.
CELL, WIDER, TOP = 64, 8, 6


def _by_row(e: DataFrame, cell: int) -> DataFrame:
    """Edges once for every row of cells that they cross."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    return e.where("ay <> by").withColumn("_cy", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))


def border_cells(polygons: DataFrame, exact: bool = False, cell: int = CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """(ann_id, .., _cx, _cy): cells in which the side of an edge can change; along an edge, not over its whole box.

    Side tests that are truncated to integers need a whole unit, so cells that far left of an edge belong to it as well.
    """
    e = edges(polygons, *keep)
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = e.withColumn("_cy", F.explode(F.sequence(F.floor(low / cell), F.floor(high / cell))))
    flat = F.col("ay") == F.col("by")
    at = lambda y: F.when(flat, F.col("ax")).otherwise(F.col("ax") + (y - F.col("ay")) / F.when(flat, 1.0).otherwise(F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax")))
    p, q = at(F.greatest(low, F.col("_cy") * cell)), at(F.least(high, (F.col("_cy") + 1) * cell))
    slack = F.lit(0.0) if exact else F.when(flat, 0.0).otherwise(1 / F.when(flat, 1.0).otherwise(high - low))
    # a little wider than the crossing, against rounding
    left = F.when(flat, F.least("ax", "bx")).otherwise(F.least(p, q)) - slack - 1e-6
    right = F.when(flat, F.greatest("ax", "bx")).otherwise(F.greatest(p, q)) + 1e-6
    return rows.withColumn("_cx", F.explode(F.sequence(F.floor(left / cell), F.floor(right / cell)))).select("ann_id", *keep, "_cx", "_cy").distinct()


def wide_cells(runs: DataFrame, keep: list[str]) -> DataFrame:
    """Runs of cells (_from .. _to of a row) as few cells of several levels: (.., _lvl, _cx); a cell of level k is WIDER ** k cells wide."""
    size = lambda k: F.pow(F.lit(float(WIDER)), k)
    low = lambda k: F.ceil(F.col("_from") / size(k)).cast("bigint")
    high = lambda k: (F.floor((F.col("_to") + 1) / size(k)) - 1).cast("bigint")
    at = runs.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(TOP))))
    k = F.col("_lvl")
    at = at.select(*keep, "_lvl", low(k).alias("a"), high(k).alias("b"), low(k + 1).alias("c"), high(k + 1).alias("d")).where("a <= b")
    covered = (F.col("c") <= F.col("d")) & (F.col("_lvl") < TOP)
    span = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(F.array().cast("array<bigint>"))
    cells = F.when(covered, F.concat(span(F.col("a"), F.col("c") * WIDER - 1), span((F.col("d") + 1) * WIDER, F.col("b")))).otherwise(span(F.col("a"), F.col("b")))
    return at.select(*keep, "_lvl", F.explode(cells).alias("_cx"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, rule: str = "winding", exact: bool = False, cell: int = CELL, shared: tuple[str, ...] | None = None) -> DataFrame:
    """(.., x, y, ann_id): points inside polygons of the same slide, if both tables have slide_id (or the ``shared`` columns).

    Cells that an edge touches (their number grows with the border) are tested point by point, against the edges of the
    polygon in that row of cells, and turns add up by (point, polygon) with partial sums.  What lies between them in a row of
    cells is inside or outside as a whole: its first centre is tested once, and inside runs become cells of up to seven
    sizes, which points join by one key for each size that occurs.  No vertices travel with the cells.  The box is strict and
    side tests are truncated to integers unless ``exact``.  Equal points count once.
    """
    shared = _shared(points, polygons) if shared is None else shared
    names = points.columns
    by_row = _by_row(edges(polygons, *shared), cell)
    px, py = F.col("x"), F.col("y")
    boxed = polygons.withColumn("_b", geom.bbox(F.col("coords")))
    inside = (px > F.col("_b.x0")) & (px < F.col("_b.x1")) & (py > F.col("_b.y0")) & (py < F.col("_b.y1"))
    if exact:
        inside = (px >= F.col("_b.x0")) & (px <= F.col("_b.x1")) & (py >= F.col("_b.y0")) & (py <= F.col("_b.y1"))
    cross = (F.col("bx") - F.col("ax")) * (py - F.col("ay")) - (px - F.col("ax")) * (F.col("by") - F.col("ay"))
    side = cross if exact else cross.cast("int")
    up, down = (F.col("ay") <= py) & (F.col("by") > py), (F.col("ay") > py) & (F.col("by") <= py)
    if rule == "winding":
        turn = F.when(up & (side > 0), 1).when(down & (side < 0), -1).otherwise(0)
        hit = F.col("_t") != 0
    else:
        at = F.col("ax") + (py - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
        turn = F.when((up | down) & (px < at), 1).otherwise(0)
        hit = F.col("_t") % 2 == 1

    def tested(pairs: DataFrame, keys: list[str]) -> DataFrame:
        return pairs.join(by_row, [*shared, "ann_id", "_cy"]).groupBy(*keys).agg(F.sum(turn).alias("_t")).where(hit).drop("_t")

    own = [*shared, "ann_id"]
    border = written(border_cells(boxed, exact, cell, (*shared, "_b")), "border")
    row = Window.partitionBy(*own, "_cy").orderBy("_cx")
    gaps = border.select(*own, "_cy", (F.lag("_cx").over(row) + 1).alias("_from"), (F.col("_cx") - 1).alias("_to")).where("_from <= _to")
    centres = gaps.withColumn("x", (F.col("_from") + 0.5) * cell).withColumn("y", (F.col("_cy") + 0.5) * cell)
    runs = tested(centres, [*own, "_cy", "_from", "_to"])
    whole = written(wide_cells(runs, [*own, "_cy"]), "cells")
    sizes = sorted(r._lvl for r in whole.select("_lvl").distinct().collect())  # at most TOP + 1 numbers
    keyed = points.distinct().withColumn("_cx", F.floor(px / cell)).withColumn("_cy", F.floor(py / cell))
    near = keyed.join(border, [*shared, "_cx", "_cy"]).where(inside).select(*names, "ann_id", "_cy")
    out = tested(near, [*names, "ann_id"])
    if not sizes:
        return out
    wide = keyed.withColumn("_lvl", F.explode(F.array(*(F.lit(k) for k in sizes)))).withColumn("_cx", F.floor(F.col("_cx") / F.pow(F.lit(float(WIDER)), F.col("_lvl"))).cast("bigint"))
    return out.unionByName(wide.join(whole, [*shared, "_lvl", "_cx", "_cy"]).select(*names, "ann_id"))


def named_labels(annotations: DataFrame, name_to_label: DataFrame | None, groups: DataFrame | None = None) -> DataFrame:
    """Annotations with a label by name: unknown names 0, and 1 for all without a map (name, label).

    On slides that have groups the name is the group's, and annotations without a group are left out; on others it is
    the annotation's own.  Without a table of groups every slide counts as having some.
    """
    if name_to_label is None:
        return annotations.withColumn("label", F.lit(1))
    if groups is None:
        known = annotations.withColumn("_grouped", F.lit(True))
    else:
        known = annotations.join(groups.select("slide_id").distinct().withColumn("_grouped", F.lit(True)), "slide_id", "left")
    none = F.coalesce(F.col("group_name"), F.lit("None")) == "None"
    known = known.where(F.col("_grouped").isNull() | ~none).withColumn("_name", F.when(F.col("_grouped"), F.col("group_name")).otherwise(F.col("name")) if "name" in annotations.columns else F.col("group_name"))
    labels = name_to_label.select(F.col("name").alias("_name"), F.col("label").alias("_label"))
    return known.join(labels, "_name", "left").select(*annotations.columns, F.coalesce("_label", F.lit(0)).alias("label"))


def rasterize(points: DataFrame, polygons: DataFrame, order: DataFrame | None = None, exact: bool = False) -> DataFrame:
    """([slide_id,] x, y, value): the greatest label that covers each point, or, with an ``order`` (label, pos), the one painted last.

    In paint order polygons that are not listed are dropped and equal positions are painted by ann_id.
    """
    shared = _shared(points, polygons)
    inside = points_in_polygons(points, polygons, exact=exact).join(polygons.select(*shared, "ann_id", "label"), [*shared, "ann_id"])
    if order is None:
        return inside.groupBy(*shared, "x", "y").agg(F.max("label").alias("value"))
    return inside.join(order, "label").groupBy(*shared, "x", "y").agg(F.max_by("label", F.struct("pos", "ann_id")).alias("value"))


def closure(groups: DataFrame) -> DataFrame:
    """([slide_id,] ancestor, name) for every group and all groups above it, itself included; names count inside a slide.

    The reach doubles each round and ends when nothing is new, so a cycle of parents ends too: its groups are all
    above each other.
    """
    keys = ["slide_id"] if "slide_id" in groups.columns else []
    own = groups.select(*keys, "name", F.col("name").alias("ancestor")).distinct()
    up = groups.where("parent_name is not null").select(*keys, "name", F.col("parent_name").alias("ancestor"))
    reach = written(up.join(own.select(*keys, "ancestor"), [*keys, "ancestor"], "left_semi").unionByName(own).distinct(), "closure")
    size = reach.count()
    while True:
        further = reach.select(*keys, F.col("name").alias("ancestor"), F.col("ancestor").alias("_top"))
        more = written(reach.join(further, [*keys, "ancestor"]).select(*keys, "name", F.col("_top").alias("ancestor")).distinct(), "closure")
        before, size = size, more.count()
        discard(reach)
        reach = more
        if size == before:
            return reach.select(*keys, "ancestor", "name")


def group_rollup(annotations: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group (of a slide), over members and nested groups: area, n_points, box and centre."""
    keys = list(_shared(annotations, groups))
    own = annotations.select(*keys, "group_name", geom.area(F.col("coords")).alias("area"), geom.n_points(F.col("coords")).alias("n"), geom.bbox(F.col("coords")).alias("b"))
    part = own.groupBy(*keys, "group_name").agg(F.sum("area").alias("area"), F.sum("n").alias("n"), F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    up = closure(groups).join(part.withColumnRenamed("group_name", "name"), [*keys, "name"]).groupBy(*keys, F.col("ancestor").alias("name"))
    out = up.agg(F.sum("area").alias("area"), F.sum("n").alias("n_points"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.withColumn("center_x", (F.col("x0") + F.col("x1")) / 2).withColumn("center_y", (F.col("y0") + F.col("y1")) / 2)


def accepted_files(annotations: DataFrame, groups: DataFrame) -> DataFrame:
    """Annotations of files all of whose group references exist ("None" is no reference)."""
    known = groups.select("slide_id", F.col("name").alias("group_name"), F.lit(True).alias("_known"))
    joined = annotations.join(known, ["slide_id", "group_name"], "left")
    bad = joined.where(F.col("_known").isNull() & F.col("group_name").isNotNull() & (F.col("group_name") != "None")).select("slide_id").distinct()
    return joined.drop("_known").join(bad, "slide_id", "left_anti").select(*annotations.columns)


def drop_groups(annotations: DataFrame, groups: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the named groups (of a slide), the groups below them and all their members."""
    keys = list(_shared(annotations, groups))
    gone = closure(groups).join(names.select(*(k for k in keys if k in names.columns), F.col("name").alias("ancestor")).distinct(), [*(k for k in keys if k in names.columns), "ancestor"]).select(*keys, "name").distinct()
    return annotations.join(gone.withColumnRenamed("name", "group_name"), [*keys, "group_name"], "left_anti").select(*annotations.columns), groups.join(gone, [*keys, "name"], "left_anti").select(*groups.columns)


def move_members(annotations: DataFrame, moves: DataFrame) -> DataFrame:
    """New groups for annotations listed in moves ([slide_id,] ann_id, new_group); if both tables know their slide, inside it."""
    keys = [*_shared(annotations, moves), "ann_id"]
    out = annotations.join(moves.select(*keys, "new_group"), keys, "left")
    return out.withColumn("group_name", F.coalesce("new_group", "group_name")).drop("new_group").select(*annotations.columns)


def replace_all(old: DataFrame, new: DataFrame, key: str = "slide_id") -> DataFrame:
    """All rows of the slides in ``new`` are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def by_name(annotations: DataFrame, name: str) -> DataFrame:
    """The first annotation of a name in each slide's list."""
    w = Window.partitionBy("slide_id").orderBy("ord")
    return annotations.where(F.col("name") == name).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def by_index(annotations: DataFrame, index: int) -> DataFrame:
    """The annotation at a place of each slide's list; a negative one counts from the end.  Works on groups with ``ord`` as well."""
    w = Window.partitionBy("slide_id").orderBy(F.asc("ord") if index >= 0 else F.desc("ord"))
    return annotations.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == (index + 1 if index >= 0 else -index)).drop("_r")


def without(annotations: DataFrame, found: DataFrame) -> DataFrame:
    """The list without the rows that :func:`by_name` or :func:`by_index` found."""
    return annotations.join(found.select("slide_id", "ord"), ["slide_id", "ord"], "left_anti").select(*annotations.columns)


def nearest_shape(points: DataFrame, polygons: DataFrame, tolerance: float) -> DataFrame:
    """Per point ([slide_id,] point_id, x, y): the nearest vertex, else the nearest edge, within the tolerance.

    If both tables know their slide, a point only meets the shapes of its own.  Edges join points by cells of twice the tolerance, each edge's box widened by the tolerance.
    """
    cell = max(2 * tolerance, 1.0)
    shared = _shared(points, polygons)
    e = edges(polygons, *shared)
    low = lambda a, b: F.floor((F.least(a, b) - tolerance) / cell)
    high = lambda a, b: F.floor((F.greatest(a, b) + tolerance) / cell)
    cells = e.withColumn("cx", F.explode(F.sequence(low("ax", "bx"), high("ax", "bx")))).withColumn("cy", F.explode(F.sequence(low("ay", "by"), high("ay", "by"))))
    near = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(cells, [*shared, "cx", "cy"])
    c = F.col
    near = near.withColumn("v2", geom.dist2(c("x"), c("y"), c("ax"), c("ay"))).withColumn("e2", geom.segment_dist2(c("ax"), c("ay"), c("bx"), c("by"), c("x"), c("y")))
    limit = tolerance * tolerance
    best = near.where((c("v2") <= limit) | (c("e2") <= limit))
    key = F.when(c("v2") <= limit, F.struct(F.lit(0).alias("kind"), c("v2").alias("d2"), c("ann_id"), c("i"))).otherwise(F.struct(F.lit(1).alias("kind"), c("e2").alias("d2"), c("ann_id"), c("i")))
    return best.groupBy(*shared, "point_id").agg(F.min(key).alias("b")).select(*shared, "point_id", "b.kind", "b.ann_id", "b.i", "b.d2")


def _chains(ends: np.ndarray, limit: float) -> Iterator[list[tuple[int, int, bool]]]:
    """Open regions that are joined, by their ends [x0 y0 x1 y1, region] in list order: of each chain (region, place, reversed), in the order of joining."""
    left = np.arange(ends.shape[1])
    while len(left):
        (hx, hy, tx, ty), chain = ends[:, 0], [(int(left[0]), 0, False)]
        left, ends, low, high = left[1:], ends[:, 1:], 0, 0
        while len(left) and (hx - tx) * (hx - tx) + (hy - ty) * (hy - ty) > limit:
            x0, y0, x1, y1 = ends
            far = [(x - px) * (x - px) + (y - py) * (y - py) > limit for px, py, x, y in ((tx, ty, x0, y0), (tx, ty, x1, y1), (hx, hy, x1, y1), (hx, hy, x0, y0))]
            near = ~(far[0] & far[1] & far[2] & far[3])
            k = int(near.argmax())
            if not near[k]:
                break
            how = next(i for i in range(4) if not far[i][k])
            end = (x1[k], y1[k]) if how in (0, 3) else (x0[k], y0[k])
            if how < 2:
                high, (tx, ty) = high + 1, end
            else:
                low, (hx, hy) = low - 1, end
            chain.append((int(left[k]), high if how < 2 else low, how % 2 == 1))
            left, ends = np.delete(left, k), np.delete(ends, k, axis=1)
        if len(chain) > 1:
            yield chain


def stitch_regions(regions: DataFrame, closing_distance: float = 30.0) -> DataFrame:
    """Open regions (file, group_name, ord, name, coords) joined end to end; closed ones stay: (file, group_name, ord, name, coords).

    A region is open if its ends are further apart than the closing distance.  In list order an open region takes
    the next one whose nearer end is within the distance of one of its ends, reversed where needed, and looks again.
    The order decides the result, so the ends of the open regions of one file and group meet in a task, and nothing else of them; what is
    joined to what goes back to the regions by their numbers, and Spark puts the points together.
    """
    limit = closing_distance * closing_distance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            ids, ends = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
            held.clear()
            if len(ids) > 1 and (found := [(m[0], chain[0][0], turn, *m[1:]) for chain in _chains(ends, limit) for turn, m in enumerate(chain)]):
                region, first, turn, place, back = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids[list(region)]), pa.array(ids[list(first)]), pa.array(turn, pa.int32()), pa.array(place, pa.int32()), pa.array(back)], ["_id", "_out", "_turn", "_place", "_back"])

        for batch in batches:
            ids, ends = np.asarray(batch.column(1)), np.stack([np.asarray(c) for c in batch.columns[2:]])
            cuts = [*np.flatnonzero(np.asarray(batch.column(0)) == 1).tolist(), len(ids)]
            if cuts[0]:
                held.append((ids[: cuts[0]], ends[:, : cuts[0]]))
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if held:
                    yield from out()
                held.append((ids[low:high], ends[:, low:high]))
        if held:
            yield from out()

    c = F.col
    axis = lambda k: F.transform("coords", lambda p: p[k].cast("double"))
    # written, so that numbers stay the same when a task runs again
    of = written(regions.select(F.monotonically_increasing_id().alias("_id"), "file", "group_name", c("ord").cast("int").alias("ord"), "name", axis("x").alias("_x"), axis("y").alias("_y")), "regions")
    at = lambda k, i: F.try_element_at(k, F.lit(i))
    ends = of.select("_id", "file", "group_name", "ord", "name", at("_x", 1).alias("x0"), at("_y", 1).alias("y0"), at("_x", -1).alias("x1"), at("_y", -1).alias("y1"), F.xxhash64("_x", "_y").alias("_h"))
    apart = geom.dist2(c("x0"), c("y0"), c("x1"), c("y1"))
    order = Window.partitionBy("file", "group_name").orderBy("ord", "name", "x0", "y0", "_h", "_id")
    # rows come in the window's order, each file and group from number 1
    numbered = ends.where((apart > limit) & ~F.isnan(apart)).select(F.row_number().over(order).alias("_r"), "_id", "x0", "y0", "x1", "y1")
    joins = written(numbered.mapInArrow(run, "_id bigint, _out bigint, _turn int, _place int, _back boolean"), "joins")
    # its size in files says little of its size in memory
    parts = of.join(joins.hint("merge"), "_id", "left")
    turned = lambda k: F.when(c("_back"), F.reverse(k)).otherwise(c(k)).alias(k)
    named = F.when(c("name") != "", c("_turn"))
    whole = parts.groupBy(F.coalesce("_out", "_id").alias("_id")).agg(
        F.min_by(F.struct("file", "group_name", "ord"), F.coalesce("_turn", F.lit(0))).alias("_of"),
        F.coalesce(F.min_by("name", named), F.max_by("name", F.coalesce("_turn", F.lit(0)))).alias("name"),
        F.array_sort(F.collect_list(F.struct(F.coalesce("_place", F.lit(0)).alias("_place"), turned("_x"), turned("_y")))).alias("_p"),
    )
    points = F.transform(F.arrays_zip(F.flatten("_p._x").alias("x"), F.flatten("_p._y").alias("y")), lambda p, i: F.struct(i.cast("int").alias("ord"), p["x"].alias("x"), p["y"].alias("y")))
    return whole.select("_of.*", "name", points.alias("coords"))


def flatten_spline(coords: DataFrame, key: str = "ann_id", steps: int = 10, closed: bool = True) -> DataFrame:
    """Points along centripetal splines: (key, segment, t, x, y); four neighbouring vertices make each segment.

    A closed spline wraps around; an open one goes on beyond its ends as its first and last segments do.
    """
    c = F.col("coords")
    n = F.size(c)
    wrapped = lambda k: F.element_at(c, (F.pmod(F.col("i") + k, n) + 1).cast("int"))
    if closed:
        rows = coords.where(n >= 3).select(key, "coords", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
        seg = rows.select(key, "i", *(wrapped(k).alias(f"p{k + 1}") for k in (-1, 0, 1, 2)))
    else:
        rows = coords.where(n >= 2).select(key, "coords", F.explode(F.sequence(F.lit(0), n - 2)).alias("i"))
        p1, p2 = wrapped(0), wrapped(1)
        beyond = lambda a, b: F.struct((2 * a["x"] - b["x"]).alias("x"), (2 * a["y"] - b["y"]).alias("y"))
        plain = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
        p0 = F.when(F.col("i") == 0, beyond(p1, p2)).otherwise(plain(wrapped(-1)))
        p3 = F.when(F.col("i") == n - 2, beyond(p2, p1)).otherwise(plain(wrapped(2)))
        seg = rows.select(key, "i", p0.alias("p0"), plain(p1).alias("p1"), plain(p2).alias("p2"), p3.alias("p3"))
    seg = seg.withColumn("b", geom.bezier_controls(F.col("p0"), F.col("p1"), F.col("p2"), F.col("p3"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("t", F.col("k") / steps)
    t, u = F.col("t"), 1 - F.col("t")
    cubic = lambda k: u * u * u * F.col(f"p1.{k}") + 3 * u * u * t * F.col(f"b.{k}1") + 3 * u * t * t * F.col(f"b.{k}2") + t * t * t * F.col(f"p2.{k}")
    return seg.select(key, F.col("i").alias("segment"), "t", cubic("x").alias("x"), cubic("y").alias("y"))


def points_to_annotation(points: DataFrame, name: str = "Detected nuclei") -> DataFrame:
    """One PointSet annotation for each slide's detections."""
    return points.groupBy("slide_id").agg(F.sort_array(F.collect_list(F.struct("x", "y"))).alias("coords")).select("slide_id", F.lit(name).alias("name"), F.lit("PointSet").alias("type"), "coords")

