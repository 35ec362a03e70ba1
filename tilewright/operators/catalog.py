"""Catalogues: worklists, image series, frames, extents and level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.lower() for c in df.columns))


def visible(df: DataFrame, shown: list[str], which: str = "visible") -> DataFrame:
    """ALL, VISIBLE or INVISIBLE columns in declared order."""
    keep = {"all": df.columns, "visible": [c for c in df.columns if c in shown], "invisible": [c for c in df.columns if c not in shown]}[which]
    return df.select(*keep)


def appended(df: DataFrame, rows: DataFrame) -> DataFrame:
    if len(df.columns) != len(rows.columns):
        raise ValueError("the record has another number of fields")
    return df.unionByName(rows)


def images_for(images: DataFrame, studies: DataFrame | None = None, patients: DataFrame | None = None, worklist: DataFrame | None = None) -> DataFrame:
    """Images of the given studies, patients and worklist (a table with image ids); None filters nothing."""
    out = images
    if studies is not None:
        out = out.join(studies.select("study_id").distinct(), "study_id", "left_semi")
    if patients is not None:
        out = out.join(patients.select("patient_id").distinct(), "patient_id", "left_semi")
    if worklist is not None:
        out = out.join(worklist.select("image_id").distinct(), "image_id", "left_semi")
    return out


def worklist_items(worklists: DataFrame) -> DataFrame:
    """(worklist_id, image_id) of comma-separated image lists."""
    return worklists.select("worklist_id", F.explode(F.split("images", ",")).alias("image_id")).where("image_id <> ''")


def worklist_lists(items: DataFrame) -> DataFrame:
    return items.groupBy("worklist_id").agg(F.array_join(F.array_sort(F.collect_set("image_id")), ",").alias("images"), F.countDistinct("image_id").alias("n"))


def worklist_add(items: DataFrame, more: DataFrame) -> DataFrame:
    return items.unionByName(more.select(*items.columns)).distinct()


def worklist_remove(items: DataFrame, gone: DataFrame) -> DataFrame:
    return items.join(gone, ["worklist_id", "image_id"], "left_anti")


def worklist_update(items: DataFrame, new: DataFrame) -> DataFrame:
    """The lists of the worklists in ``new`` are replaced."""
    return items.join(new.select("worklist_id").distinct(), "worklist_id", "left_anti").unionByName(new)


def concatenated(headers: DataFrame) -> DataFrame:
    """Instances that name the same ``source`` are parts of one image: it keeps the least instance and all their frames.

    headers with a column ``source`` (null: an instance of its own) and ``n_frames``.
    """
    names = [c for c in headers.columns if c not in ("source", "n_frames", "instance")]
    whole = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.concat(F.lit("i"), F.col("instance").cast("string")))
    first = F.min_by(F.struct(*names), "instance")
    out = headers.groupBy("study", "series", whole.alias("_whole")).agg(F.min("instance").alias("instance"), F.sum("n_frames").alias("n_frames"), F.count(F.lit(1)).alias("n_parts"), first.alias("_h"))
    return out.select("instance", "n_frames", "n_parts", "_h.*")


def associated_images(headers: DataFrame) -> DataFrame:
    """(study, series, kind, instance): the label and the overview of each series, its least instance of that kind."""
    return headers.where("kind in ('label', 'overview')").groupBy("study", "series", "kind").agg(F.min("instance").alias("instance"))


def series_levels(headers: DataFrame) -> DataFrame:
    """(study, series, level, instance, width, downsample): pyramid levels of each series, from its largest volume image.

    Labels and overviews are left out, and images whose ratio to the base is over half off a whole number.
    """
    volumes = headers.where("kind = 'volume'")
    base = volumes.groupBy("study", "series").agg(F.max_by("width", F.struct(F.col("width") * F.col("height"), -F.col("instance"))).alias("base"))
    near = volumes.join(base, ["study", "series"]).withColumn("downsample", F.floor(F.col("base") / F.col("width") + 0.5).cast("bigint")).where(F.abs(F.col("base") / F.col("width") - F.col("downsample")) <= 0.5)
    w = Window.partitionBy("study", "series")
    return near.withColumn("level", F.dense_rank().over(w.orderBy("downsample")) - 1).select("study", "series", "level", "instance", "width", "downsample")


def frames(levels: DataFrame, positions: DataFrame, tile: int) -> DataFrame:
    """(slide_id, col, row, frame): the frame of every tile of the full grid, null where a sparse image has none.

    positions: slide_id, x, y (1-based pixel positions), frame.
    """
    have = positions.select("slide_id", F.expr(f"(x - 1) div {tile}").alias("col"), F.expr(f"(y - 1) div {tile}").alias("row"), "frame")
    span = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col(c) / tile) - 1))
    grid = levels.select("slide_id", span("width").alias("col"), "height").select("slide_id", "col", span("height").alias("row"))
    return grid.join(have, ["slide_id", "col", "row"], "left")


def full_frame(col: str, row: str, tiles_x: str):
    """The frame number of a tile where every tile has a frame."""
    return F.col(col) + F.col(row) * F.col(tiles_x)


def full_frames(levels: DataFrame, tile: int) -> DataFrame:
    """(slide_id, col, row, frame) of images that are tiled without gaps."""
    none = levels.select("slide_id").where("false").select("slide_id", *(F.lit(None).cast("bigint").alias(c) for c in ("x", "y", "frame")))
    at = frames(levels, none, tile).drop("frame").join(levels.select("slide_id", F.ceil(F.col("width") / tile).alias("_n")), "slide_id")
    return at.select("slide_id", "col", "row", full_frame("col", "row", "_n").alias("frame"))


def frame_samples(grid: DataFrame, decoded: DataFrame, size: int, fill: float = 255.0) -> DataFrame:
    """Samples of every tile of a grid of frames; a tile without a frame is filled.  decoded: slide_id, frame, samples."""
    blank = F.array_repeat(F.lit(fill), size)
    return grid.join(decoded.select("slide_id", "frame", F.col("samples").cast("array<double>").alias("samples")), ["slide_id", "frame"], "left").select("slide_id", "col", "row", "frame", F.coalesce("samples", blank).alias("samples"))


def extents(tiles: DataFrame, tile: int) -> DataFrame:
    """(slide_id, index, width, height) of the index with the most pixels of each slide."""
    one = tiles.groupBy("slide_id", "index").agg(((F.max("tile_x") + 1) * tile).alias("width"), ((F.max("tile_y") + 1) * tile).alias("height"))
    best = F.max_by(F.struct("index", "width", "height"), F.struct(F.col("width") * F.col("height"), -F.col("index")))
    return one.groupBy("slide_id").agg(best.alias("b")).select("slide_id", "b.*")


def valid_levels(levels: DataFrame) -> DataFrame:
    """Levels of the slides each of whose levels is strictly narrower than the one before."""
    w = Window.partitionBy("slide_id").orderBy("level")
    checked = levels.withColumn("_ok", F.coalesce(F.col("width") < F.lag("width").over(w), F.lit(True)))
    good = checked.groupBy("slide_id").agg(F.bool_and("_ok").alias("ok")).where("ok").select("slide_id")
    return levels.join(good, "slide_id", "left_semi")


def sidecars(slides: DataFrame, files: DataFrame, suffix: str = "") -> DataFrame:
    """Slides with the files of the same folder and base name (plus a suffix)."""
    from ..functions.text import base_name, directory

    a = slides.withColumn("_k", F.concat_ws("/", directory(F.col("path")), F.concat(base_name(F.col("path")), F.lit(suffix))))
    b = files.select(F.concat_ws("/", directory(F.col("path")), base_name(F.col("path"))).alias("_k"), F.col("path").alias("sidecar"))
    return a.join(b, "_k").drop("_k")
