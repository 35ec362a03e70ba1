"""Lookup joins: best level for a downsample, colour lookup tables, overlay alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import hsv_to_rgb, rgb_to_hsv
from ..plans.keyed import per_slide

# The default colour lookup tables as (index, (red, green, blue, alpha)), and whether indices are relative.
LUTS = {
    "Background": (True, [(0.0, (0, 0, 0, 255)), (1.0, (255, 255, 255, 255))]),
    "Normal": (False, [(0.0, (0, 0, 0, 255)), (1.0, (255, 255, 255, 255))]),
    "Label": (False, [(0.0, (0, 0, 0, 0)), (1.0, (0, 224, 249, 255)), (2.0, (0, 249, 50, 255)), (3.0, (174, 249, 0, 255)), (4.0, (249, 100, 0, 255)), (5.0, (249, 0, 125, 255)), (6.0, (149, 0, 249, 255)), (7.0, (0, 0, 206, 255)), (8.0, (0, 185, 206, 255)), (9.0, (0, 206, 41, 255)), (10.0, (143, 206, 0, 255)), (11.0, (206, 82, 0, 255)), (12.0, (206, 0, 103, 255)), (13.0, (124, 0, 206, 255)), (14.0, (0, 0, 162, 255)), (15.0, (0, 145, 162, 255)), (16.0, (0, 162, 32, 255)), (17.0, (114, 162, 0, 255)), (18.0, (162, 65, 0, 255)), (19.0, (162, 0, 81, 255)), (20.0, (97, 0, 162, 255)), (21.0, (0, 0, 119, 255)), (22.0, (0, 107, 119, 255)), (23.0, (0, 119, 23, 255)), (24.0, (83, 119, 0, 255)), (25.0, (119, 47, 0, 255)), (26.0, (119, 0, 59, 255)), (27.0, (71, 0, 119, 255)), (28.0, (100, 100, 249, 255)), (29.0, (100, 234, 249, 255))]),
    "Traffic Light (0 - 255)": (False, [(0.0, (0, 0, 0, 0)), (10.0, (0, 255, 0, 255)), (127.0, (255, 255, 0, 255)), (255.0, (255, 0, 0, 255))]),
    "Traffic Light (0 - 1)": (False, [(0.0, (0, 0, 0, 0)), (10.0 / 255, (0, 255, 0, 255)), (127.0 / 255, (255, 255, 0, 255)), (1.0, (255, 0, 0, 255))]),
}


def lut(spark: SparkSession, name: str) -> DataFrame:
    """A lookup table as rows idx, index_value, r, g, b, a, relative."""
    relative, rows = LUTS[name]
    return spark.createDataFrame([(i, float(v), *(float(c) for c in color), relative) for i, (v, color) in enumerate(rows)], "idx int, index_value double, r double, g double, b double, a double, relative boolean")


def best_level(levels: DataFrame, requests: DataFrame) -> DataFrame:
    """(.., level): the level whose downsample is nearest to each request (slide_id, downsample); below 1 it is 0, ties go to the coarser.

    Every request keeps its row; those of slides without levels go.
    """
    known = levels.groupBy("slide_id").agg(F.collect_list(F.struct("level", F.col("downsample").alias("d"))).alias("_levels"))  # a slide has few levels
    near = F.array_min(F.transform("_levels", lambda v: F.struct(F.abs(v["d"] - F.col("downsample")).alias("far"), (-v["level"]).alias("n"))))
    out = per_slide(requests, known)
    return out.select(*requests.columns, F.when(F.col("downsample") < 1, 0).otherwise(-near["n"]).alias("level"))


def colorize(pixels: DataFrame, table: DataFrame, value: str = "value", minmax: DataFrame | None = None) -> DataFrame:
    """red, green, blue, alpha (0 .. 255) of each value.

    A value takes the last index up to it; between two indices colours are mixed in HSV and alpha linearly; beyond the ends the
    end colours hold; an empty table gives 0.  With a relative table values are first scaled by their slide's (min_value, max_value);
    where these are equal the last colour holds.  A null value has null colours.  The palette is a constant of the
    plan, so no rows are shuffled.
    """
    relative = minmax is not None
    keyed = per_slide(pixels, minmax.select("slide_id", "min_value", "max_value")) if relative else pixels
    wide = F.col("max_value") - F.col("min_value")
    scaled = F.when(wide != 0, (F.col(value) - F.col("min_value")) / wide).when(F.col(value).isNotNull(), F.lit(float("nan"))) if relative else F.col(value).cast("double")
    # a fixed palette of a few rows
    rows = sorted(tuple(r) for r in table.select("index_value", "r", "g", "b", "a").collect())
    entry = lambda r: F.struct(*(F.lit(v).alias(n) for v, n in zip(r, ("index_value", "r", "g", "b", "a"), strict=True)), rgb_to_hsv(*(F.lit(v / 255.0) for v in r[1:4])).alias("hsv"))
    n = len(rows)
    if not n:
        return keyed.select("*", *(F.when(F.col(value).isNotNull(), 0).alias(c) for c in ("red", "green", "blue", "alpha")))
    out = keyed.withColumn("_v", scaled).withColumn("_p", F.array(*(entry(r) for r in rows)))
    at = sum((F.col("_v") >= F.lit(r[0])).cast("int") for r in rows)
    out = out.withColumn("_at", at).withColumn("_lo", F.element_at("_p", F.greatest(F.col("_at"), F.lit(1)))).withColumn("_hi", F.element_at("_p", F.least(F.col("_at") + 1, F.lit(n))))
    exact = (F.abs(F.col("_v") - F.col("_lo.index_value")) <= 0.0001) | (F.col("_at") == 0) | (F.col("_at") == n)
    t = F.when(exact, 0.0).otherwise((F.col("_v") - F.col("_lo.index_value")) / (F.col("_hi.index_value") - F.col("_lo.index_value")))
    out = out.withColumn("_exact", exact).withColumn("_t", t)
    mixed = [F.col(f"_lo.hsv.{k}") * (1 - F.col("_t")) + F.col(f"_hi.hsv.{k}") * F.col("_t") for k in "hsv"]
    out = out.withColumn("_c", hsv_to_rgb(*mixed))
    whole = lambda mixed_, plain: F.when(F.col("_v").isNotNull(), F.when(F.col("_exact"), plain).otherwise(mixed_)).cast("int")
    # a tiny lift before truncation keeps 255 * 1.0 at 255 whatever the rounding of HSV
    colors = [whole(F.floor(F.col(f"_c.{k}") * 255 + 1e-9), F.col(f"_lo.{k}")).alias(name) for k, name in zip("rgb", ("red", "green", "blue"), strict=True)]
    alpha = whole(F.floor(F.col("_lo.a") * (1 - F.col("_t")) + F.col("_hi.a") * F.col("_t") + 1e-9), F.col("_lo.a")).alias("alpha")
    return out.select(*keyed.columns, *colors, alpha)


def overlay(slides: DataFrame, results: DataFrame) -> DataFrame:
    """(slide_id, result_id, scale, level_offset) of results whose size divides the slide's by one whole number."""
    both = slides.select("slide_id", F.col("width").alias("w"), F.col("height").alias("h")).join(results.select("slide_id", "result_id", F.col("width").alias("rw"), F.col("height").alias("rh")), "slide_id")
    fits = both.where("w % rw = 0 and h % rh = 0 and w div rw = h div rh")
    return fits.select("slide_id", "result_id", F.expr("w div rw").alias("scale"), F.round(F.log2(F.expr("w div rw"))).cast("int").alias("level_offset"))


def on_overlay(pixels: DataFrame, result: DataFrame, scale: int) -> DataFrame:
    """Each pixel with the value of the coarser result image below it."""
    key = result.select("slide_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("value").alias("overlay"))
    keyed = pixels.withColumn("_x", F.expr(f"x div {scale}")).withColumn("_y", F.expr(f"y div {scale}"))
    return keyed.join(key, ["slide_id", "_x", "_y"], "left").drop("_x", "_y")


def foreground_levels(slides: DataFrame, results: DataFrame, requests: DataFrame) -> DataFrame:
    """(.., fg_level, residual): the level of a result image to draw over each request, and how far it is still to be scaled.

    slides: slide_id, level, width, downsample; results: slide_id, result_id, level, width; requests: slide_id,
    result_id, level, scale.  The level is the request's, less the slide's best level for the result's scale, inside
    the levels that the result has.
    """
    asked = requests.select("slide_id", "result_id", F.col("scale").cast("double").alias("downsample")).distinct()
    offset = best_level(slides, asked).select("slide_id", "result_id", F.col("downsample").alias("_scale"), F.col("level").alias("_offset"))
    at = requests.withColumn("_scale", F.col("scale").cast("double")).join(offset, ["slide_id", "result_id", "_scale"])
    top = results.groupBy("slide_id", "result_id").agg(F.max("level").alias("_top"))
    at = at.join(top, ["slide_id", "result_id"]).withColumn("fg_level", F.greatest(F.lit(0), F.least(F.col("level") - F.col("_offset"), F.col("_top"))))
    own = slides.select("slide_id", "level", F.col("width").alias("_w"))
    theirs = results.select("slide_id", "result_id", F.col("level").alias("fg_level"), F.col("width").alias("_fw"))
    return at.join(own, ["slide_id", "level"]).join(theirs, ["slide_id", "result_id", "fg_level"]).select(*requests.columns, "fg_level", (F.col("_fw") / F.col("_w")).alias("residual"))


def running_level(levels: DataFrame) -> DataFrame:
    """Levels with the downsample to the level before them."""
    w = Window.partitionBy("slide_id").orderBy("level")
    return levels.withColumn("step", F.col("downsample") / F.lag("downsample").over(w))
