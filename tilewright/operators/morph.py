"""Neighbourhood and fixpoint operators: components, distance transform, gradients, symmetry transform, nuclei."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import discard, iterate, written
from ..plans.keyed import per_slide
from .raster import to_runs


#: Columns of a cell in which runs of neighbouring bands meet; rows of a band that one task merges.
CELL, BAND = 64, 256
#: Lines that one task of a reconstruction raises together.
ROWS = 64


def _merged(y: np.ndarray, x0: np.ndarray, x1: np.ndarray, reach: int) -> np.ndarray:
    """For runs in the order of (y, x0): the first run of each one's component."""
    n = len(y)
    wide = int(x1.max() - x0.min()) + 3 + 2 * reach
    begin, end = y * wide + x0 - x0.min(), y * wide + x1 - x0.min()
    low = np.searchsorted(end, begin + wide - reach)
    high = np.maximum(np.searchsorted(begin, end + wide + reach, "right"), low)
    a = np.repeat(np.arange(n), high - low)
    b = np.arange(len(a)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    up = np.arange(n)
    while True:
        p, q = up[a], up[b]
        differ = p != q
        if not differ.any():
            return up
        least = np.minimum(p, q)[differ]
        np.minimum.at(up, p[differ], least)
        np.minimum.at(up, q[differ], least)
        while not np.array_equal(up, up[up]):
            up = up[up]


def connected_components(pixels: DataFrame, threshold: float = 0.5, neighbours: int = 4) -> DataFrame:
    """(slide_id, x, y, label): components of the pixels above the threshold, numbered 1.. by their first pixel in raster order.

    Rows become runs.  A task merges the runs of a band of BAND rows; runs of neighbouring bands that touch become
    edges between merged parts, and the least part spreads with pointer jumping, so rounds grow with the
    logarithm of a component's depth in bands and not with its pixels, and only parts at borders take part.
    """
    mask = pixels.where(F.col("value") > threshold).select("slide_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).distinct()
    named = run_components(to_runs(mask), neighbours)
    return named.select("slide_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label")


def run_components(runs: DataFrame, neighbours: int = 4) -> DataFrame:
    """(slide_id, y, x0, x1, label): components of disjoint runs, which do not touch others of their row; labels as above."""
    reach = 0 if neighbours == 4 else 1
    slide = runs.schema["slide_id"].dataType.simpleString()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x0"])
        y, x0, x1 = (rows[c].to_numpy() for c in ("y", "x0", "x1"))
        # one number per run that sorts like (y, x0); columns are below 2 ** 31
        number = y * 4294967296 + x0
        return pd.DataFrame({"slide_id": rows["slide_id"], "y": y, "x0": x0, "x1": x1, "id": number, "part": number[_merged(y, x0, x1, reach)]})

    runs = runs.select("slide_id", "y", "x0", "x1").withColumn("band", F.floor(F.col("y") / BAND))
    runs = written(runs.groupBy("slide_id", "band").applyInPandas(merge, f"slide_id {slide}, y bigint, x0 bigint, x1 bigint, id bigint, part bigint"), "runs")
    a = runs.where(F.pmod(F.col("y"), F.lit(BAND)) == BAND - 1).select("slide_id", F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("part").alias("u"))
    b = runs.where(F.pmod(F.col("y"), F.lit(BAND)) == 0).select("slide_id", (F.col("y") - 1).alias("ya"), F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("part").alias("v"))
    # runs on both sides of a border meet in the cells of CELL columns that both touch
    cells = lambda lo, hi, more: F.explode(F.sequence(F.floor((F.col(lo) - more) / CELL), F.floor((F.col(hi) + more) / CELL)))
    edges = a.withColumn("cell", cells("a0", "a1", reach)).join(b.withColumn("cell", cells("b0", "b1", 0)), ["slide_id", "ya", "cell"])
    edges = edges.where((F.col("a0") <= F.col("b1") + reach) & (F.col("b0") <= F.col("a1") + reach)).select("slide_id", "u", "v").distinct()
    edges = written(edges, "borders")
    edges = written(edges.unionByName(edges.select("slide_id", F.col("v").alias("u"), F.col("u").alias("v"))), "edges")

    def step(state: DataFrame) -> DataFrame:
        near = edges.join(state.select("slide_id", F.col("u").alias("v"), "c"), ["slide_id", "v"]).groupBy("slide_id", "u").agg(F.min("c").alias("m"))
        low = state.join(near, ["slide_id", "u"], "left").select("slide_id", "u", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("m"))
        up = state.select("slide_id", F.col("u").alias("m"), F.col("c").alias("mc"))
        new = low.join(up, ["slide_id", "m"], "left").select("slide_id", "u", F.least("m", F.coalesce("mc", "m")).alias("c"), "old")
        return new.select("slide_id", "u", "c", (F.col("c") != F.col("old")).alias("changed"))

    labels = iterate(edges.select("slide_id", "u", F.col("u").alias("c")).distinct(), step)
    labels = labels.select("slide_id", F.col("u").alias("part"), "c")
    # labels in raster order: numbers inside bands, after the counts of the bands above
    parts = runs.where("id = part").select("slide_id", "part").join(labels, ["slide_id", "part"], "left").select("slide_id", "part", F.coalesce("c", "part").alias("c"))
    parts = written(parts, "parts")
    roots = parts.where("part = c").select("slide_id", "c", F.floor(F.col("c") / (4294967296 * BAND)).alias("band"))
    counts = roots.groupBy("slide_id", "band").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("slide_id").orderBy("band")) - F.col("n")).drop("n")
    roots = roots.withColumn("r", F.row_number().over(Window.partitionBy("slide_id", "band").orderBy("c"))).join(counts, ["slide_id", "band"])
    roots = roots.select("slide_id", "c", (F.col("before") + F.col("r")).alias("label"))
    named = runs.join(parts.join(roots, ["slide_id", "c"]), ["slide_id", "part"])
    return named.select("slide_id", "y", "x0", "x1", "label")


#: What stands for no source in sight; columns of a slide whose carries one task combines.
FAR, COLUMNS = 1 << 40, 4096

#: Width and height: one pair for all slides, or a table slide_id, width, height.
Sizes = tuple[int, int] | DataFrame


def sized(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows with their slide's width and height as _w and _h."""
    if isinstance(sizes, tuple):
        return rows.withColumn("_w", F.lit(sizes[0]).cast("bigint")).withColumn("_h", F.lit(sizes[1]).cast("bigint"))
    return per_slide(rows, sizes.select("slide_id", F.col("width").cast("bigint").alias("_w"), F.col("height").cast("bigint").alias("_h")))


def _spread(d: np.ndarray) -> np.ndarray:
    """City-block distances inside a block: least sums along rows, then along columns, both ways."""
    for axis in (1, 0):
        at = np.arange(d.shape[axis]).reshape((1, -1) if axis else (-1, 1))
        ahead = np.minimum.accumulate(d - at, axis) + at
        back = np.flip(np.minimum.accumulate(np.flip(d + at, axis), axis), axis) - at
        d = np.minimum(ahead, back)
    return np.minimum(d, FAR)


def distance_lines(sources: DataFrame, sizes: Sizes, cap: int | None = None, band: int = ROWS) -> DataFrame:
    """(slide_id, y, d): each line of a slide with sources as an array of exact city-block distances to the nearest one.

    A task works on a band of lines.  A band's summary are the distances of its first and its last line to its own sources; along a
    column a path from another band goes straight down or up from there, so what arrives is a running minimum over bands,
    column by column, in a table that is ``band`` times smaller than the image.  Bands then finish on their own.  Nothing is
    dense before that, and there are no rounds.  ``cap`` is by default width + height // 2 + 1, and stands wherever it is less.
    """
    slide = sources.schema["slide_id"].dataType.simpleString()
    src = sized(sources.select("slide_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")), sizes)
    src = src.where("x >= 0 and y >= 0 and x < _w and y < _h").withColumn("band", F.floor(F.col("y") / band))

    def local(rows: pd.DataFrame, first: int, w: int, h: int) -> np.ndarray:
        d = np.full((min(band, h - first), w), FAR)
        if len(rows):
            d[rows["y"] - first, rows["x"]] = 0
        return _spread(d)

    def summary(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, h = int(rows["_w"].iloc[0]), int(rows["_h"].iloc[0])
        d = local(rows, int(key[1]) * band, w, h)
        return pd.DataFrame([(*key, w, h, i // COLUMNS, d[0, i : i + COLUMNS], d[-1, i : i + COLUMNS]) for i in range(0, w, COLUMNS)], columns=["slide_id", "band", "_w", "_h", "block", "top", "bottom"])

    def carries(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        w, h = int(rows["_w"].iloc[0]), int(rows["_h"].iloc[0])
        bands = -(-h // band)
        top = np.full((bands, len(rows["top"].iloc[0])), FAR)
        bottom = top.copy()
        top[rows["band"]], bottom[rows["band"]] = np.stack(rows["top"]), np.stack(rows["bottom"])
        begin = np.arange(bands)[:, None] * band
        end = np.minimum(begin + band, h)
        # at the line before a band's first, and at the one after its last
        above = np.full_like(top, FAR)
        above[1:] = np.minimum.accumulate(bottom - end, 0)[:-1] + begin[1:]
        below = np.full_like(top, FAR)
        below[:-1] = np.flip(np.minimum.accumulate(np.flip(top + begin, 0), 0), 0)[1:] - end[:-1]
        return pd.DataFrame({"slide_id": key[0], "band": np.arange(bands), "_w": w, "_h": h, "block": key[1], "above": list(np.minimum(above, FAR)), "below": list(np.minimum(below, FAR))})

    def finish(key: tuple, rows: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        if more.empty:
            return pd.DataFrame(columns=["slide_id", "y", "d"])
        w, h, first = int(more["_w"].iloc[0]), int(more["_h"].iloc[0]), int(key[1]) * band
        d = local(rows, first, w, h)
        more = more.sort_values("block")
        down = np.arange(1, len(d) + 1)[:, None]
        d = np.minimum(d, np.concatenate(list(more["above"])) + down)
        d = np.minimum(d, np.concatenate(list(more["below"])) + down[::-1])
        d = np.minimum(d, w + h // 2 + 1 if cap is None else cap)
        return pd.DataFrame({"slide_id": key[0], "y": first + np.arange(len(d)), "d": list(d)})

    of = f"slide_id {slide}, band bigint, _w bigint, _h bigint, block bigint"
    seen = src.groupBy("slide_id", "band").applyInPandas(summary, f"{of}, top array<bigint>, bottom array<bigint>")
    seen = seen.groupBy("slide_id", "block").applyInPandas(carries, f"{of}, above array<bigint>, below array<bigint>")
    return src.groupBy("slide_id", "band").cogroup(seen.groupBy("slide_id", "band")).applyInPandas(finish, f"slide_id {slide}, y bigint, d array<bigint>")


def distance_transform(sources: DataFrame, sizes: Sizes, cap: int | None = None) -> DataFrame:
    """(slide_id, x, y, d): :func:`distance_lines` as pixels."""
    return distance_lines(sources, sizes, cap).select("slide_id", F.posexplode("d").alias("x", "d"), "y").select("slide_id", F.col("x").cast("bigint").alias("x"), "y", "d")


def within(distances: DataFrame, k: int) -> DataFrame:
    """Pixels within distance k of a source."""
    return distances.where(F.col("d") <= k)



def convolve_line(pixels: DataFrame, weights: list[float], axis: str, value: str = "value", out: str = "value") -> DataFrame:
    """A one-dimensional filter on dense pixels from :func:`sized`, with reflected borders (edge pixel repeated)."""
    half = len(weights) // 2
    other, size = ("y", F.col("_w")) if axis == "x" else ("x", F.col("_h"))
    w = Window.partitionBy("slide_id", other).orderBy(axis)
    total = None
    for i, weight in enumerate(weights):
        k = i - half
        if not weight:
            continue
        inside = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w) if k < 0 else F.col(value)
        if k:
            # p pixels from the border, position p + k is beyond it and reflects to the one |k| - 2 p - 1 pixels back from there
            mirror = F.lit(None).cast("double")
            for p in range(abs(k)):
                back = abs(k) - 2 * p - 1
                way = back if k < 0 else -back
                shifted = F.lag(value, -way).over(w) if way < 0 else F.lead(value, way).over(w) if way > 0 else F.col(value)
                mirror = F.when(F.col(axis) == (size - 1 - p if k > 0 else F.lit(p)), shifted).otherwise(mirror)
            inside = F.coalesce(inside, mirror)
        term = inside * weight
        total = term if total is None else total + term
    short = F.when(size <= half, F.raise_error(F.lit("the filter is longer than the image"))).otherwise(total)
    return pixels.withColumn(out, short if half else total)


def sobel(pixels: DataFrame, sizes: Sizes) -> DataFrame:
    """Dense pixels with gx and gy: separable 3 x 3 Sobel gradients with reflected borders."""
    smooth, slope = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
    out = convolve_line(sized(pixels, sizes).withColumn("value", F.col("value").cast("double")), slope, "x", out="dx")
    out = convolve_line(out, smooth, "x", out="sx")
    out = convolve_line(out, smooth, "y", "dx", "gx")
    return convolve_line(out, slope, "y", "sx", "gy").drop("dx", "sx", "_w", "_h")


def gradients(pixels: DataFrame, sizes: Sizes) -> DataFrame:
    """Sobel gradients with their magnitude and unit vector (0 where the magnitude is 0)."""
    out = sobel(pixels, sizes).withColumn("mag", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    unit = lambda c: F.when(F.col("mag") > 0, F.col(c) / F.col("mag")).otherwise(0.0)
    return out.withColumn("ux", unit("gx")).withColumn("uy", unit("gy"))


def gaussian(size: int, sigma: float) -> list[float]:
    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


def blur(pixels: DataFrame, radius: float, sizes: Sizes, value: str = "value") -> DataFrame:
    size = int(radius) + 1 if int(radius) % 2 == 0 else int(radius)
    weights = gaussian(size, size / 4)
    return convolve_line(convolve_line(sized(pixels, sizes), weights, "x", value, value), weights, "y", value, value).drop("_w", "_h")


def votes(grads: DataFrame, radius: float, sizes: Sizes, polarity: str = "light") -> DataFrame:
    """Votes (slide_id, x, y, n) of gated pixels at the distance ``radius`` along (light) or against (dark) the gradient."""
    out, grads = None, sized(grads, sizes)
    for sign, on in ((1, polarity in ("light", "both")), (-1, polarity in ("dark", "both"))):
        if not on:
            continue
        to = lambda c, u, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.col(c) + sign * F.floor(0.5 + radius * F.col(u)))).cast("bigint")  # noqa: B023, E731
        one = grads.select("slide_id", to("x", "ux", "_w").alias("x"), to("y", "uy", "_h").alias("y"), F.lit(sign).cast("bigint").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("slide_id", "x", "y").agg(F.sum("n").alias("n"))


def radial_symmetry(pixels: DataFrame, radii: list[float], alpha: float, beta: float, sizes: Sizes, kappa: float = 9.9, polarity: str = "light", mode: str = "orientation", tile: int | None = None) -> DataFrame:
    """(slide_id, x, y, value): the mean over radii of the blurred symmetry maps.

    Gradients count from a share ``beta`` of the greatest of the slide, or of their tile x tile square.
    """
    g = written(gradients(pixels, sizes).select("slide_id", "x", "y", "mag", "ux", "uy"), "gradients")
    square = [] if tile is None else [F.expr(f"x div {tile}").alias("_tx"), F.expr(f"y div {tile}").alias("_ty")]
    keyed = g.select("*", *square)
    keys = ["slide_id", "_tx", "_ty"][: 1 + len(square)]
    gated = per_slide(keyed, keyed.groupBy(*keys).agg(F.max("mag").alias("top")), on=tuple(keys)).where(F.col("mag") >= beta * F.col("top"))
    maps = None
    for r in radii:
        found = g.select("slide_id", "x", "y", "mag").join(votes(gated, r, sizes, polarity), ["slide_id", "x", "y"], "left")
        n = F.least(F.coalesce(F.col("n"), F.lit(0)).cast("double"), F.lit(kappa))
        if mode == "orientation":
            f = F.signum(n) * F.pow(F.abs(n) / kappa, F.lit(alpha))
        else:
            f = F.col("mag") * F.coalesce(F.col("n"), F.lit(0)) / kappa * F.pow(n / kappa, F.lit(alpha))
        one = blur(found.select("slide_id", "x", "y", f.alias("value")), r, sizes)
        maps = one if maps is None else maps.unionByName(one)
    return maps.groupBy("slide_id", "x", "y").agg((F.sum("value") / len(radii)).alias("value"))


def _risen(low: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The greyscale reconstruction of a block of rows: sweeps down and up until nothing rises."""

    def along(m: np.ndarray, t: np.ndarray) -> np.ndarray:
        # v -> min(t, max(m, v)) from the left, for all columns at once: such steps compose by doubling
        m, t, reach = m.copy(), t.copy(), 1
        while reach < m.shape[0]:
            new = np.minimum(t[reach:], np.maximum(m[reach:], m[:-reach]))
            t[reach:] = np.minimum(t[reach:], np.maximum(m[reach:], t[:-reach]))
            m[reach:] = new
            reach *= 2
        return m

    while True:
        before = low.copy()
        for rows in (range(len(low)), range(len(low) - 1, -1, -1)):
            last = None
            for y in rows:
                if last is not None:
                    wide = np.pad(last, 1, constant_values=-np.inf)
                    low[y] = np.minimum(top[y], np.maximum(low[y], np.maximum(np.maximum(wide[:-2], wide[2:]), last)))
                low[y] = along(along(low[y], top[y])[::-1], top[y][::-1])[::-1]
                last = low[y]
        if np.array_equal(low, before):
            return low


def reconstruct(marker: DataFrame, mask: DataFrame, band: int = ROWS, written_rows: list[int] | None = None) -> DataFrame:
    """Greyscale reconstruction by dilation, 8 neighbours: (slide_id, x, y, value).

    The image becomes one row of values for each line; a task raises a band of ``band`` lines, with the nearest line of each
    neighbouring band, as far as it goes.  Only bands beside a border line that has risen go on to the next round, and only lines
    that have risen are written; the last version of each line is the result.  Rounds grow with the number of bands that
    a plateau crosses.  Pixels that are missing let nothing pass.  ``written_rows`` receives the lines written by each round.
    """
    both = marker.select("slide_id", "x", "y", F.col("value").cast("double").alias("m")).join(mask.select("slide_id", "x", "y", F.col("value").cast("double").alias("top")), ["slide_id", "x", "y"])
    line = F.array_sort(F.collect_list(F.struct(F.col("x").cast("bigint").alias("x"), F.least("m", "top").alias("m"), "top")))
    state = both.groupBy("slide_id", F.col("y").cast("bigint").alias("y")).agg(line.alias("l"))
    parts = [F.col(f"l.{k}").alias(k) for k in ("x", "m", "top")]
    first = written(state.select("slide_id", "y", F.lit(0).alias("round"), *parts), "lines")
    slide = marker.schema["slide_id"].dataType.simpleString()
    schema = f"slide_id {slide}, y bigint, round int, x array<bigint>, m array<double>, top array<double>"
    own = F.floor(F.col("y") / band)

    def raised(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["round"].max()) + 1
        rows = rows.sort_values(["y", "round"]).drop_duplicates("y", keep="last")
        x0, x1 = min(x[0] for x in rows["x"]), max(x[-1] for x in rows["x"])
        y0, y1 = rows["y"].min(), rows["y"].max()
        low = np.full((y1 - y0 + 1, x1 - x0 + 1), -np.inf)
        top = low.copy()
        for y, x, m, t in zip(rows["y"], rows["x"], rows["m"], rows["top"], strict=True):
            low[y - y0, x - x0], top[y - y0, x - x0] = m, t
        low = _risen(low, top)
        mine = rows[rows["y"] // band == key[1]]
        new = [low[y - y0, x - x0] for y, x in zip(mine["y"], mine["x"], strict=True)]
        rose = [bool((n > m).any()) for n, m in zip(new, mine["m"], strict=True)]
        out = pd.DataFrame({"slide_id": mine["slide_id"], "y": mine["y"], "round": number, "x": mine["x"], "m": new, "top": mine["top"]})
        return out[rose]

    # a band without neighbours that rise is left alone; at first all are due
    versions, due = [first], first.select("slide_id", own.alias("band")).distinct()
    while True:
        lines = versions[0]
        for more in versions[1:]:
            lines = lines.unionByName(more)
        to = F.array_distinct(F.array(own, F.floor((F.col("y") - 1) / band), F.floor((F.col("y") + 1) / band)))
        sent = lines.withColumn("band", F.explode(to)).join(due, ["slide_id", "band"], "left_semi")
        rose = written(sent.groupBy("slide_id", "band").applyInPandas(raised, schema), "risen")
        n = rose.count()
        if written_rows is not None:
            written_rows.append(n)
        if not n:
            discard(rose)
            break
        versions.append(rose)
        beyond = F.array(F.floor((F.col("y") - 1) / band), F.floor((F.col("y") + 1) / band))
        touched = rose.select("slide_id", own.alias("own"), F.explode(beyond).alias("band")).where("band <> own").select("slide_id", "band").distinct()
        due = touched.join(first.select("slide_id", own.alias("band")).distinct(), ["slide_id", "band"], "left_semi")
    out = versions[0]
    if len(versions) > 1:
        changed = versions[1]
        for more in versions[2:]:
            changed = changed.unionByName(more)
        last = changed.groupBy("slide_id", "y").agg(F.max_by(F.struct("x", "m"), "round").alias("l")).select("slide_id", "y", "l.x", "l.m")
        out = out.select("slide_id", "y", "x", "m").join(last.select("slide_id", "y"), ["slide_id", "y"], "left_anti").unionByName(last)
    pixel = F.explode(F.arrays_zip("x", "m"))
    return out.select("slide_id", "y", pixel.alias("p")).select("slide_id", "p.x", "y", F.col("p.m").alias("value"))


def h_maxima(pixels: DataFrame, h: float) -> DataFrame:
    """Pixels that stand at least h above the reconstruction from their own value minus h: (slide_id, x, y, value 1)."""
    rec = reconstruct(pixels.withColumn("value", F.col("value") - h), pixels).withColumnRenamed("value", "r")
    return pixels.join(rec, ["slide_id", "x", "y"]).where(F.col("value") - F.col("r") >= h - 1e-12).select("slide_id", "x", "y", F.lit(1).alias("value"))


def background_runs(runs: DataFrame, sizes: Sizes) -> DataFrame:
    """(slide_id, y, x0, x1): what the runs of each line leave free, in a frame one pixel around the image; one run for an empty line."""
    at = sized(runs.select("slide_id", "y", "x0", "x1"), sizes)
    w = Window.partitionBy("slide_id", "y").orderBy("x0")
    end = F.lead("x0").over(w)
    gaps = at.select("slide_id", "y", "_w", (F.col("x1") + 1).alias("x0"), F.coalesce(end - 1, F.col("_w")).alias("x1"))
    begin = at.groupBy("slide_id", "y", "_w").agg((F.min("x0") - 1).alias("x1")).select("slide_id", "y", F.lit(-1).cast("bigint").alias("x0"), "x1")
    lines = at.select("slide_id", "_w", "_h").distinct().select("slide_id", "_w", F.explode(F.sequence(F.lit(-1).cast("bigint"), F.col("_h"))).alias("y"))
    empty = lines.join(at.select("slide_id", "y").distinct(), ["slide_id", "y"], "left_anti").select("slide_id", "y", F.lit(-1).cast("bigint").alias("x0"), F.col("_w").alias("x1"))
    return gaps.select("slide_id", "y", "x0", "x1").unionByName(begin).unionByName(empty).where("x0 <= x1")


def _mask_runs(mask: DataFrame, sizes: Sizes) -> tuple[DataFrame, DataFrame]:
    """Runs of the 8-connected blobs of a mask and of the 4-connected parts of its background, with their labels; 1 is the outside."""
    known = mask.where("value > 0.5").select("slide_id", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y")).distinct()
    blobs = written(run_components(to_runs(known), 8), "blobs")
    return blobs, written(run_components(background_runs(blobs, sizes), 4), "background")


def outer_boundary(mask: DataFrame, sizes: Sizes) -> DataFrame:
    """Boundary pixels of 8-connected blobs, holes ignored: (slide_id, x, y, label).

    Work grows with runs: the background is its complement runs, and a pixel counts if it lies at the end of a run
    beside an outside run, or above or below one.  A task holds the runs of BAND lines.
    """
    blobs, back = _mask_runs(mask, sizes)
    slide = blobs.schema["slide_id"].dataType.simpleString()
    outside = back.where("label = 1")
    band = lambda y: F.floor(y / BAND)
    near = F.explode(F.array_distinct(F.array(*(band(F.col("y") + k) for k in (-1, 0, 1)))))
    mine = blobs.select("slide_id", band(F.col("y")).alias("band"), "y", "x0", "x1", "label")
    theirs = outside.select("slide_id", near.alias("band"), "y", "x0", "x1")

    def touching(rows: pd.DataFrame, free: pd.DataFrame) -> pd.DataFrame:
        names = ["slide_id", "y", "x0", "x1", "label"]
        if rows.empty or free.empty:
            return pd.DataFrame(columns=names)
        free = free.sort_values(["y", "x0"])
        y, x0, x1, label = (rows[c].to_numpy() for c in ("y", "x0", "x1", "label"))
        fy, f0, f1 = (free[c].to_numpy() for c in ("y", "x0", "x1"))
        least = min(int(x0.min()), int(f0.min())) - 1
        wide = max(int(x1.max()), int(f1.max())) + 3 - least
        begin, end = fy * wide + f0 - least, fy * wide + f1 - least
        out = []
        for dy in (-1, 0, 1):
            reach = 0 if dy else 1
            # free runs of the line beside (or of this one, next to the ends) that overlap each run
            low = np.searchsorted(end, (y + dy) * wide + x0 - least - reach)
            high = np.maximum(np.searchsorted(begin, (y + dy) * wide + x1 - least + reach, "right"), low)
            a = np.repeat(np.arange(len(y)), high - low)
            b = np.arange(len(a)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
            if dy:
                out.append((y[a], np.maximum(x0[a], f0[b]), np.minimum(x1[a], f1[b]), label[a]))
            else:
                at = np.where(f1[b] < x0[a], x0[a], x1[a])
                out.append((y[a], at, at, label[a]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame({"slide_id": rows["slide_id"].iloc[0], **dict(zip(names[1:], columns, strict=True))})

    found = mine.groupBy("slide_id", "band").cogroup(theirs.groupBy("slide_id", "band")).applyInPandas(touching, f"slide_id {slide}, y bigint, x0 bigint, x1 bigint, label bigint")
    return found.select("slide_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "label").distinct()


def containment(mask: DataFrame, sizes: Sizes) -> DataFrame:
    """The tree of blobs and holes: (slide_id, kind, label, parent, area); a hole's parent is the blob around it, a blob's the hole it lies in.

    The outside is hole 1 of its slide, whose parent is null.  What lies left of the first pixel of a part, in
    raster order, is around it, so parents come from one equi-join on run ends.
    """
    blobs, back = _mask_runs(mask, sizes)
    pieces = lambda runs, kind: runs.groupBy("slide_id", "label").agg(F.min(F.struct("y", "x0")).alias("f"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).select("slide_id", F.lit(kind).alias("kind"), "label", F.col("f.y").alias("y"), (F.col("f.x0") - 1).alias("x1"), "area")
    ends = lambda runs: runs.select("slide_id", "y", "x1", F.col("label").alias("parent"))
    keys = ["slide_id", "y", "x1"]
    out = pieces(blobs, "blob").join(ends(back), keys, "left").unionByName(pieces(back, "hole").join(ends(blobs), keys, "left"))
    return out.select("slide_id", "kind", "label", "parent", "area")


def detect_nuclei(pixels: DataFrame, sizes: Sizes, spacing: float = 1.0, h: float = 0.01, alpha: float = 2.0, beta: float = 0.01, radii: tuple[float, float, float] = (1.5, 5.0, 1.0), tile: int | None = None) -> DataFrame:
    """Centres (slide_id, label, x, y) of bright round spots of dense pixels; radii (least, most, step) in um.

    With ``tile``, the gate on gradients is relative to the greatest of each tile x tile square and not of the whole slide.
    """
    low, high, step = radii
    scales = [(low + i * step) / spacing for i in range(int((high - low) / step + 1e-9) + 1)]
    symmetry = written(radial_symmetry(pixels, scales, alpha, beta, sizes, tile=tile), "symmetry")
    edge = outer_boundary(h_maxima(symmetry, h), sizes)
    return edge.groupBy("slide_id", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
