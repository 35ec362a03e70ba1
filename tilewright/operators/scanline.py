"""Masks of whole slides from polygons by scanlines: runs instead of points, tiles instead of pixel rows.

Edges are cut by bands of BAND rows and meet in the (slide, band) of their rows.  A task takes one band, walks its rows with a table of the
edges that are active there, and turns the crossings of each polygon into runs (y, x0, x1) by the winding rule;
overlapping runs are settled by clipping, so each pixel is in one run at most.  Work grows with edges and runs, not with area.
Runs become tiles by filling slices; only tiles that a run touches exist.

The rules are those of point-in-polygon masks: a pixel is inside if it lies strictly inside the polygon's box and its winding
number is not 0, where side tests are truncated to whole numbers unless ``exact``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..plans.keyed import per_slide
from .packed import assembled
from .vector import edges

#: Rows of a slide that one task scans.
BAND = 256


def _reach(side: np.ndarray, guess: np.ndarray, ax, ay, bx, by, y: int, exact: bool) -> np.ndarray:
    """For crossings of row y: the first column at which the edge no longer counts, from a guess that is nearly right.

    ``side`` is 1 for edges that go up, which count where the point lies left of them, and -1 for those that go down.
    """
    def counts(x: np.ndarray) -> np.ndarray:
        cross = (bx - ax) * (y - ay) - (x - ax) * (by - ay)
        cross = cross if exact else np.trunc(cross)
        return np.where(side > 0, cross > 0, cross < 0)

    at = guess.copy()
    # an edge counts left of a column and not from there on; a few steps mend the rounding of the guess
    while True:
        back = ~counts(at - 1)
        ahead = counts(at) & ~back
        if not back.any() and not ahead.any():
            return at
        at = np.where(back, at - 1, np.where(ahead, at + 1, at))


def row_runs(e: pd.DataFrame, y: int, exact: bool) -> Iterator[tuple[int, int, int]]:
    """(polygon, x0, x1) of the runs of row y; e: the edges that are active there."""
    ax, ay, bx, by = (e[c].to_numpy() for c in ("ax", "ay", "bx", "by"))
    side = np.where(by > ay, 1, -1)
    meet = ax + (y - ay) / (by - ay) * (bx - ax)
    slack = 0.0 if exact else 1.0 / np.abs(by - ay)  # a truncated test needs a whole unit
    stop = _reach(side, np.ceil(meet - slack).astype(np.int64), ax, ay, bx, by, y, exact)
    owner = e["p"].to_numpy()
    order = np.lexsort((stop, owner))
    owner, stop, side = owner[order], stop[order], side[order]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(owner)], strict=True):
        # left of all crossings every edge counts; passing one takes it away
        turn, last = int(side[a:b].sum()), None
        for i in range(a, b):
            if turn and last is not None and stop[i] > last:
                yield int(owner[i]), last, int(stop[i]) - 1
            turn -= int(side[i])
            last = int(stop[i])


def clipped(runs: list[tuple[int, int, float, tuple]]) -> list[tuple[int, int, float]]:
    """Runs (x0, x1, label, rank) of a row as disjoint runs (x0, x1, label), of which the greatest rank wins."""
    cuts = sorted({x for r in runs for x in (r[0], r[1] + 1)})
    runs = sorted(runs, key=lambda r: r[0])
    out: list[list] = []
    live: list[tuple] = []
    at = 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        while at < len(runs) and runs[at][0] <= a:
            x0, x1, label, rank = runs[at]
            heapq.heappush(live, (tuple(-v for v in rank), x1, label))
            at += 1
        while live and live[0][1] < a:
            heapq.heappop(live)
        if not live:
            continue
        label = live[0][2]
        if out and out[-1][1] == a - 1 and out[-1][2] == label:
            out[-1][1] = b - 1
        else:
            out.append([a, b - 1, label])
    return [tuple(r) for r in out]


def mask_runs(polygons: DataFrame, order: DataFrame | None = None, exact: bool = False, band: int = BAND, sizes: DataFrame | None = None) -> DataFrame:
    """(slide_id, y, x0, x1, value): disjoint runs of the greatest label, or with an ``order`` (label, pos) of the one painted last.

    polygons: slide_id, ann_id, label, coords.  In paint order labels that are not listed are dropped and equal positions
    are painted by ann_id.  sizes (slide_id, width, height) cuts runs at the image's borders.
    """
    slide = polygons.schema["slide_id"].dataType.simpleString()
    known = polygons.select("slide_id", "ann_id", F.col("label").cast("double").alias("label"), "coords")
    known = known.withColumn("pos", F.col("label")) if order is None else known.join(order.select(F.col("label").cast("double").alias("label"), F.col("pos").cast("double").alias("pos")), "label")
    known = known.withColumn("b", geom.bbox(F.col("coords"))).where("label is not null")
    e = edges(known, "slide_id", "label", "pos", "b").where("ay <> by")
    # rows strictly inside the polygon's box that the edge crosses: its lower end counts, its upper one does not
    first, last = F.ceil(F.least("ay", "by")), F.ceil(F.greatest("ay", "by")) - 1
    if not exact:
        first, last = F.greatest(first, F.floor(F.col("b.y0")) + 1), F.least(last, F.ceil(F.col("b.y1")) - 1)
    e = e.withColumn("y0", first.cast("bigint")).withColumn("y1", last.cast("bigint")).where("y0 <= y1")
    if sizes is not None:
        e = per_slide(e, sizes.select("slide_id", F.col("width").alias("w"), F.col("height").alias("h")))
        e = e.withColumn("y0", F.greatest("y0", F.lit(0))).withColumn("y1", F.least("y1", F.col("h") - 1)).where("y0 <= y1")
    width = F.col("w") if sizes is not None else F.lit(None).cast("bigint")
    e = e.withColumn("band", F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band))))
    e = e.select("slide_id", "band", "ann_id", "label", "pos", F.col("b.x0").alias("bx0"), F.col("b.x1").alias("bx1"), width.cast("double").alias("w"), "ax", "ay", "bx", "by", "y0", "y1")

    def scan(key: tuple, e: pd.DataFrame) -> pd.DataFrame:
        e = e.reset_index(drop=True)
        e["p"] = e.groupby("ann_id").ngroup()
        facts = e.drop_duplicates("p").set_index("p")
        low, high = np.floor(facts["bx0"]).astype(np.int64) + 1, np.ceil(facts["bx1"]).astype(np.int64) - 1
        if exact:
            low, high = np.ceil(facts["bx0"]).astype(np.int64), np.floor(facts["bx1"]).astype(np.int64)
        if e["w"].notna().any():
            low, high = low.clip(lower=0), np.minimum(high, facts["w"].astype(np.int64) - 1)
        low, high = low.to_dict(), high.to_dict()
        label, pos = facts["label"].to_dict(), facts["pos"].to_dict()
        begin = np.maximum(e["y0"].to_numpy(), key[1] * band)
        end = np.minimum(e["y1"].to_numpy(), (key[1] + 1) * band - 1)
        order = np.argsort(begin, kind="stable")
        out, active, at = [], np.zeros(0, np.int64), 0
        for y in range(int(begin.min()), int(end.max()) + 1):
            more = at + int(np.searchsorted(begin[order[at:]], y, "right"))
            active = np.concatenate((active[end[active] >= y], order[at:more]))
            at = more
            if not len(active):
                continue
            runs = []
            for p, x0, x1 in row_runs(e.iloc[active], y, exact):
                x0, x1 = max(x0, low[p]), min(x1, high[p])
                if x0 <= x1:
                    runs.append((x0, x1, label[p], (pos[p], p)))
            out += [(key[0], y, *r) for r in clipped(runs)]
        return pd.DataFrame(out, columns=["slide_id", "y", "x0", "x1", "value"])

    return e.groupBy("slide_id", "band").applyInPandas(scan, f"slide_id {slide}, y bigint, x0 bigint, x1 bigint, value double")


def runs_to_tiles(runs: DataFrame, size: int = 512, fill: float = 0.0) -> DataFrame:
    """Monochrome size x size tiles of level 0 from disjoint runs (slide_id, y, x0, x1, value)."""
    cut = runs.withColumn("tile_x", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size))))
    left = F.greatest(F.col("x0"), F.col("tile_x") * size)
    many = (F.least(F.col("x1"), (F.col("tile_x") + 1) * size - 1) - left + 1).cast("int")
    pieces = cut.select("slide_id", F.lit(0).alias("level"), F.col("tile_x").cast("bigint").alias("tile_x"), F.floor(F.col("y") / size).cast("bigint").alias("tile_y"), F.lit(size).alias("tile_w"), F.lit(size).alias("tile_h"), F.lit(1).alias("n_channels"), F.pmod(F.col("y"), F.lit(size)).cast("int").alias("top"), (left - F.col("tile_x") * size).cast("int").alias("left"), F.lit(1).alias("rows"), many.alias("columns"), F.array_repeat(F.col("value").cast("double"), many).alias("samples"))
    return assembled(pieces, fill)


def mask_tiles(polygons: DataFrame, size: int = 512, order: DataFrame | None = None, exact: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """The mask of every slide as tiles; tiles without a polygon are left out."""
    return runs_to_tiles(mask_runs(polygons, order, exact, sizes=sizes), size)
