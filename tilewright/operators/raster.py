"""Raster operators on tiles and pixels: scans, regions, thresholds, statistics, downscaling and pyramids.

``tiles``: slide_id, level, tile_x, tile_y, tile_w, tile_h, n_channels, samples ARRAY (row-major, channels interleaved).
``pixels``: slide_id, [level,] x, y, [c,] value; background may be left out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.iterate import written
from ..plans.keyed import per_slide

#: The least positive 32-bit float; the default lower bound keeps values above 0.
FLT_MIN, FLT_MAX = 1.1754943508222875e-38, 3.4028234663852886e38


def to_pixels(tiles: DataFrame, *keep: str) -> DataFrame:
    """(slide_id, level, x, y, c, value) of all samples, with further columns of their tiles."""
    i, n, w = F.col("i"), F.col("n_channels"), F.col("tile_w")
    p = F.expr("i div n_channels")
    out = tiles.select("slide_id", "level", "tile_x", "tile_y", "tile_w", "tile_h", "n_channels", *(k for k in keep if k != "n_channels"), F.posexplode("samples").alias("i", "value"))
    return out.select("slide_id", "level", *keep, (F.col("tile_x") * w + p % w).alias("x"), (F.col("tile_y") * F.col("tile_h") + F.floor(p / w)).cast("bigint").alias("y"), (i % n).alias("c"), F.col("value").cast("double").alias("value"))


def to_tiles(pixels: DataFrame, size: int = 512, channels: int = 1, fill: float = 0.0) -> DataFrame:
    """Pixels regrouped into size x size tiles; absent samples become ``fill``.

    Places left of or above the origin are in tiles with negative numbers.  Pixels may carry their slide's ``n_channels``, else all have ``channels``.  A group is one tile, at most
    size * size * channels samples, which are put in place by their flat index.
    """
    c = F.col("c") if "c" in pixels.columns else F.lit(0)
    level = F.col("level") if "level" in pixels.columns else F.lit(0)
    n = F.col("n_channels") if "n_channels" in pixels.columns else F.lit(channels)
    at = (F.pmod(F.col("y"), F.lit(size)) * size + F.pmod(F.col("x"), F.lit(size))) * n + c
    keyed = pixels.select("slide_id", level.cast("int").alias("level"), F.floor(F.col("x") / size).cast("bigint").alias("tile_x"), F.floor(F.col("y") / size).cast("bigint").alias("tile_y"), n.cast("int").alias("n_channels"), at.cast("int").alias("at"), F.col("value").cast("double").alias("value"))
    keys = ["slide_id", "level", "tile_x", "tile_y", "n_channels"]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        samples = np.full(size * size * key[4], fill)
        samples[rows["at"]] = rows["value"]
        return pd.DataFrame([[*key[:4], size, size, key[4], samples]])

    slide = pixels.schema["slide_id"].dataType.simpleString()
    return keyed.groupBy(*keys).applyInPandas(run, f"slide_id {slide}, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>")


def to_runs(pixels: DataFrame, keys: tuple[str, ...] = ("slide_id", "y")) -> DataFrame:
    """Runs of neighbouring pixels of a row: (slide_id, y, x0, x1); pixels must be distinct."""
    w = Window.partitionBy(*keys).orderBy("x")
    return pixels.withColumn("island", F.col("x") - F.row_number().over(w)).groupBy(*keys, "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def channel(pixels: DataFrame, k: int = -1, channels: int | None = None) -> DataFrame:
    """One channel; -1, or one that does not exist, means all."""
    return pixels if k < 0 or (channels is not None and k >= channels) else pixels.where(F.col("c") == k)


def convert(value: Column, to: str) -> Column:
    """Sample conversion: to uint8, uint16 or uint32 a value is truncated and wraps; to float it is widened."""
    bits = {"uint8": 8, "uint16": 16, "uint32": 32}.get(to)
    if bits is None:
        return value.cast("float")
    return F.pmod(F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("bigint"), F.lit(1 << bits))


def threshold(pixels: DataFrame, lower: float = FLT_MIN, upper: float = FLT_MAX) -> DataFrame:
    """value becomes 1 where lower <= value < upper, else 0."""
    return pixels.withColumn("value", ((F.col("value") >= lower) & (F.col("value") < upper)).cast("int"))


def remove_labels(pixels: DataFrame, labels: list[int]) -> DataFrame:
    """The given labels become 0; others, and 0, stay."""
    return pixels.withColumn("value", F.when((F.col("value") > 0) & ~F.col("value").isin(labels), F.col("value")).otherwise(F.lit(0)))


def remove_labels_by(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Like :func:`remove_labels`, with the labels in a table (column ``value``)."""
    gone = labels.select("value").distinct().withColumn("gone", F.lit(True))
    return pixels.join(gone, "value", "left").withColumn("value", F.when((F.col("value") > 0) & F.col("gone").isNull(), F.col("value")).otherwise(F.lit(0))).drop("gone")


def tile_sizes(tiles: DataFrame) -> DataFrame:
    """(slide_id, level, tile_w, tile_h) that occur; reads these columns only."""
    return tiles.select("slide_id", "level", "tile_w", "tile_h").distinct()


def read_region(tiles: DataFrame, x: int, y: int, w: int, h: int, level: int = 0, downsample: float = 1.0, fill: float = 0.0, channel_: int | None = 0) -> DataFrame:
    """A dense w x h region at ``level`` whose origin (x, y) is in level-0 pixels: (slide_id, x, y, [c,] value).

    One channel, or with None all channels of each slide.  Tiles are pruned by their keys and sizes before samples
    are unpacked.  Slides without a tile at the level give no rows.
    """
    x0, y0 = math.floor(x / downsample + 0.5), math.floor(y / downsample + 0.5)
    here = tiles.where(F.col("level") == level)
    hit = here.where((F.col("tile_x") * F.col("tile_w") < x0 + w) & ((F.col("tile_x") + 1) * F.col("tile_w") > x0) & (F.col("tile_y") * F.col("tile_h") < y0 + h) & ((F.col("tile_y") + 1) * F.col("tile_h") > y0))
    found = to_pixels(hit).where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    span = lambda a, n: F.explode(F.sequence(F.lit(a).cast("bigint"), F.lit(a + n - 1).cast("bigint")))
    slides = here.groupBy("slide_id").agg(F.max("n_channels").alias("n"))
    channels = F.array(F.lit(channel_)) if channel_ is not None else F.sequence(F.lit(0), F.col("n") - 1)
    dense = slides.select("slide_id", F.explode(channels.cast("array<int>")).alias("c")).withColumn("x", span(x0, w)).withColumn("y", span(y0, h))
    keys = ["slide_id", "x", "y", "c"]
    out = dense.join(found.select(*keys, "value"), keys, "left").withColumn("value", F.coalesce("value", F.lit(fill)))
    return out.select("slide_id", "x", "y", "value") if channel_ is not None else out.select(*keys, "value")


def tile_keys(boxes: DataFrame, tw: Column | int, th: Column | int) -> DataFrame:
    """One row for each tile that a box (x0, y0, w, h) overlaps; tile sizes are numbers or columns of the boxes."""
    span = lambda start, size, step: F.sequence(F.floor(F.col(start) / step), F.floor((F.col(start) + F.col(size) - 1) / step))
    return boxes.where("w > 0 and h > 0").withColumn("tile_x", F.explode(span("x0", "w", tw))).withColumn("tile_y", F.explode(span("y0", "h", th)))


def extract_patches(tiles: DataFrame, requests: DataFrame) -> DataFrame:
    """Pixels of many boxes (request, slide_id, [level,] x0, y0, w, h) by an equi-join on tile keys: (request, x, y, c, value).

    Boxes are in pixels of their level, by default 0; each meets the tile sizes that its slide has at that level.
    """
    asked = requests if "level" in requests.columns else requests.withColumn("level", F.lit(0))
    keyed = tile_keys(asked.join(tile_sizes(tiles), ["slide_id", "level"]), F.col("tile_w"), F.col("tile_h"))
    hit = keyed.join(tiles, ["slide_id", "level", "tile_x", "tile_y", "tile_w", "tile_h"])
    px = hit.select("request", "x0", "y0", "w", "h", "tile_x", "tile_y", "tile_w", "tile_h", "n_channels", F.posexplode("samples").alias("i", "value"))
    p = F.expr("i div n_channels")
    px = px.select("request", "x0", "y0", "w", "h", (F.col("tile_x") * F.col("tile_w") + p % F.col("tile_w")).alias("x"), (F.col("tile_y") * F.col("tile_h") + F.expr("(i div n_channels) div tile_w")).alias("y"), (F.col("i") % F.col("n_channels")).alias("c"), F.col("value").cast("double").alias("value"))
    return px.where("x >= x0 and x < x0 + w and y >= y0 and y < y0 + h").select("request", "x", "y", "c", "value")


def patch_arrays(tiles: DataFrame, requests: DataFrame, fill: float = 0.0) -> DataFrame:
    """(request, w, h, n_channels, samples): every box of an existing level as a dense (h, w, channel) array, absent pixels filled."""
    asked = requests if "level" in requests.columns else requests.withColumn("level", F.lit(0))
    channels = tiles.groupBy("slide_id", "level").agg(F.max("n_channels").cast("int").alias("n_channels"))
    boxes = asked.join(channels, ["slide_id", "level"]).select("request", F.col("x0").cast("bigint").alias("x0"), F.col("y0").cast("bigint").alias("y0"), F.col("w").cast("int").alias("w"), F.col("h").cast("int").alias("h"), "n_channels")
    rows = boxes.join(extract_patches(tiles, asked), "request", "left")
    at = ((F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")) * F.col("n_channels") + F.col("c")
    rows = rows.select("request", "w", "h", "n_channels", at.alias("at"), "value")

    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        samples = np.full(key[1] * key[2] * key[3], fill)
        found = found[found["at"].notna()]
        samples[found["at"].astype(np.int64)] = found["value"]
        return pd.DataFrame([[*key, samples]])

    kind = requests.schema["request"].dataType.simpleString()
    return rows.groupBy("request", "w", "h", "n_channels").applyInPandas(run, f"request {kind}, w int, h int, n_channels int, samples array<double>")


def patches_with_spacing(tiles: DataFrame, requests: DataFrame, levels: DataFrame, slides: DataFrame) -> DataFrame:
    """:func:`extract_patches` with the spacing at each request's level and the extremes of its slide's channel.

    levels: slide_id, level, downsample; slides: slide_id, spacing_x, spacing_y of level 0.
    """
    at = requests.select("request", "slide_id", "level").join(levels.select("slide_id", "level", "downsample"), ["slide_id", "level"]).join(slides.select("slide_id", "spacing_x", "spacing_y"), "slide_id")
    at = at.select("request", "slide_id", (F.col("spacing_x") * F.col("downsample")).alias("spacing_x"), (F.col("spacing_y") * F.col("downsample")).alias("spacing_y"))
    return extract_patches(tiles, requests).join(at, "request").transform(lambda px: per_slide(px, channel_extremes(tiles), on=("slide_id", "c")))


def label_statistics(pixels: DataFrame, *keys: str) -> DataFrame:
    """Centre of gravity and area of every label above 0."""
    keys = keys or ("slide_id",)
    return pixels.where("value > 0").groupBy(*keys, F.col("value").alias("label")).agg(F.avg("x").alias("cog_x"), F.avg("y").alias("cog_y"), F.count(F.lit(1)).alias("area"))


def min_max(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixels.groupBy(*(keys or ("slide_id",))).agg(F.min("value").alias("min_value"), F.max("value").alias("max_value"))


def channel_extremes(tiles: DataFrame) -> DataFrame:
    """(slide_id, c, min_value, max_value) of each channel, over the base level."""
    base = tiles.where("level = 0")
    per = F.transform(F.sequence(F.lit(0), F.col("n_channels") - 1), lambda c: F.filter("samples", lambda _, i: i % F.col("n_channels") == c))
    one = base.select("slide_id", F.posexplode(per).alias("c", "v")).select("slide_id", "c", F.array_min("v").cast("double").alias("a"), F.array_max("v").cast("double").alias("b"))
    return one.groupBy("slide_id", "c").agg(F.min("a").alias("min_value"), F.max("b").alias("max_value"))


def levels_of(tiles: DataFrame) -> DataFrame:
    """(slide_id, level, width, height, downsample) that the tiles span."""
    size = tiles.groupBy("slide_id", "level").agg(F.max((F.col("tile_x") + 1) * F.col("tile_w")).alias("width"), F.max((F.col("tile_y") + 1) * F.col("tile_h")).alias("height"))
    return size.withColumn("downsample", F.max(F.when(F.col("level") == 0, F.col("width"))).over(Window.partitionBy("slide_id")) / F.col("width"))


def patch_min_max(tiles: DataFrame, channel_: int | None = None) -> DataFrame:
    """Extremes of each tile, of one channel or of all."""
    samples = F.col("samples") if channel_ is None else F.filter("samples", lambda v, i: i % F.col("n_channels") == channel_)
    return tiles.select("slide_id", "level", "tile_x", "tile_y", F.array_min(samples).cast("double").alias("min_value"), F.array_max(samples).cast("double").alias("max_value"))


def downscale(pixels: DataFrame, d: int = 2, interpolation: str = "linear", integer: bool = False) -> DataFrame:
    """Blocks of d x d pixels become their mean (truncated for integer samples) or their top left pixel.

    Blocks are formed inside all further columns, such as slide, level and channel.
    """
    keys = [c for c in pixels.columns if c not in ("x", "y", "value")]
    x, y = (F.floor(F.col(c) / d).cast("bigint").alias(c) for c in ("x", "y"))
    if interpolation == "nearest":
        return pixels.where((F.col("x") % d == 0) & (F.col("y") % d == 0)).select(*keys, x, y, "value")
    mean = F.avg("value")
    mean = F.when(mean >= 0, F.floor(mean)).otherwise(F.ceil(mean)).cast("bigint") if integer else mean
    return pixels.groupBy(*keys, x, y).agg(mean.alias("value"))


def level_count(width: Column, factor: int = 2, most: int = -1) -> Column:
    """Levels above the base: ``most``, or as many as bring the width at or just above 1024, whichever is nearer to it.

    The first width at or below 1024 is the last level's, unless twice that width is nearer to 1024.
    """
    if most >= 0:
        return F.lit(most)
    wider = lambda k: F.floor(width / F.pow(F.lit(float(factor)), k)) > 1024
    k = F.size(F.filter(F.sequence(F.lit(0), F.lit(62)), wider))
    low = F.floor(width / F.pow(F.lit(float(factor)), k))
    return F.greatest(k - F.when((low > 0) & (3 * low < 2048), 1).otherwise(0), F.lit(0)).cast("int")


def build_pyramid(pixels: DataFrame, sizes: DataFrame, factor: int = 2, max_levels: int = -1, interpolation: str = "linear", integer: bool = False) -> DataFrame:
    """All levels, each from the one before: (slide_id, level, [c,] x, y, value); sizes: slide_id, width, height.

    Level n of a slide is floor(width / factor ** n) wide; slides end at their own level.  Only pixels that are there count.
    For packed tiles see :mod:`pyramid`, which needs no pixel rows.
    """
    keys = ["slide_id", *(c for c in ("c",) if c in pixels.columns)]
    known = sizes.select("slide_id", F.col("width").alias("_w"), F.col("height").alias("_h"), level_count(F.col("width"), factor, max_levels).alias("_n"))
    known = written(known, "sizes")  # so that its size is known
    level = per_slide(pixels.select(*keys, "x", "y", "value"), known)
    out = level.select(*keys, "x", "y", "value", F.lit(0).alias("level"))
    top = known.agg(F.max("_n")).first()[0] or 0
    for n in range(1, top + 1):
        inside = (F.col("_n") >= n) & (F.col("x") < F.floor(F.col("_w") / factor**n)) & (F.col("y") < F.floor(F.col("_h") / factor**n))
        # written, so that a level is made from the one before and not from the base again
        level = written(downscale(level.where(F.col("_n") >= n), factor, interpolation, integer).where(inside), "level")
        out = out.unionByName(level.select(*keys, "x", "y", "value", F.lit(n).alias("level")))
    return out.select("slide_id", "level", *keys[1:], "x", "y", "value")


def box_intersects(a: str, b: str) -> Column:
    """Boxes are structs x0, y0, w, h; half open; an empty box meets nothing."""
    f = lambda n: F.col(n)
    test = (f(f"{a}.w") > 0) & (f(f"{a}.h") > 0) & (f(f"{b}.w") > 0) & (f(f"{b}.h") > 0)
    for s, e in (("x0", "w"), ("y0", "h")):
        test = test & (f(f"{a}.{s}") < f(f"{b}.{s}") + f(f"{b}.{e}")) & (f(f"{b}.{s}") < f(f"{a}.{s}") + f(f"{a}.{e}"))
    return test


def box_intersection(a: str, b: str) -> Column:
    parts = []
    for s, e in (("x0", "w"), ("y0", "h")):
        low = F.greatest(F.col(f"{a}.{s}"), F.col(f"{b}.{s}"))
        high = F.least(F.col(f"{a}.{s}") + F.col(f"{a}.{e}"), F.col(f"{b}.{s}") + F.col(f"{b}.{e}"))
        parts += [low.alias(s), (high - low).alias(e)]
    return F.struct(parts[0], parts[2], parts[1], parts[3])


def coverage(tiles: DataFrame, levels: DataFrame, tw: int, th: int) -> DataFrame:
    """Expected and present tiles of each level: (slide_id, level, expected, present)."""
    want = levels.select("slide_id", "level", (F.ceil(F.col("width") / tw) * F.ceil(F.col("height") / th)).cast("bigint").alias("expected"))
    have = tiles.select("slide_id", "level", "tile_x", "tile_y").distinct().groupBy("slide_id", "level").agg(F.count(F.lit(1)).alias("present"))
    return want.join(have, ["slide_id", "level"], "left").withColumn("present", F.coalesce("present", F.lit(0).cast("bigint")))


def scale_samples(tiles: DataFrame, op: str, k: float) -> DataFrame:
    """Scalar arithmetic on packed samples: op is one of + - * /."""
    apply = {"+": lambda v: v + k, "-": lambda v: v - k, "*": lambda v: v * k, "/": lambda v: v / k}[op]
    return tiles.withColumn("samples", F.transform("samples", apply))


def region_with_spacing(region: DataFrame, spacing_x: float, spacing_y: float, downsample: float = 1.0) -> DataFrame:
    """A region with its spacing (um a pixel at its level) and its slide's extremes inside it."""
    known = min_max(region)
    return per_slide(region, known).withColumn("spacing_x", F.lit(spacing_x * downsample)).withColumn("spacing_y", F.lit(spacing_y * downsample))


def filled(tiles: DataFrame, value: float) -> DataFrame:
    """Every sample set to one value."""
    return tiles.withColumn("samples", F.array_repeat(F.lit(value).cast("double"), F.size("samples")))


def sample_at(samples: Column, x: Column, y: Column, c: Column, width: Column, channels: Column) -> Column:
    """One sample of a packed tile, null outside."""
    return F.try_element_at(samples, ((y * width + x) * channels + c + 1).cast("int"))


def with_sample(samples: Column, at: Column, value: Column) -> Column:
    """The samples with the one at a flat index replaced."""
    return F.transform(samples, lambda v, i: F.when(i == at, value).otherwise(v))


def physical_area(area_pixels: Column, spacing_x: Column, spacing_y: Column) -> Column:
    """um2 of an area in level-0 pixels."""
    return area_pixels * spacing_x * spacing_y
