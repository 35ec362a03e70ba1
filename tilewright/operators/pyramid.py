"""Pyramids of packed tiles as a reduction over quadtrees (d x d children to a parent), per channel, without pixel rows.

A tile is made smaller where it is read, so only 1 / d**2 of its samples is shuffled.  Pieces are dealt by the ancestor
STRIDE levels up and come sorted along the Z curve, where the children of a tile are neighbours at every level: a task
reduces them like a counter with carries, one open tile per level, and so builds STRIDE levels from one shuffle.
Only the topmost of these go on to the next round, which has d**(2 * STRIDE) times fewer tiles.

A parent exists if one of its children does; absent children count as 0, as in an image whose absent tiles are
blank.  Samples beyond a level's size are what the reduction gives; :func:`inside` drops tiles that lie wholly there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.iterate import written
from ..plans.keyed import per_slide
from .packed import AT_ONCE, KEYS, PIECE, batches_of, images, keyed, pieces_schema, tile_schema
from .raster import level_count

STRIDE = 4


def reduced(image: np.ndarray, d: int, interpolation: str = "linear", integer: bool = False) -> np.ndarray:
    """The (h / d, w / d, c) array of the means of d x d blocks (truncated for integer samples), or of their first samples."""
    h, w, c = image.shape
    if h % d or w % d:
        raise ValueError(f"tiles of {w} x {h} samples do not divide by {d}")
    if interpolation == "nearest":
        return image[::d, ::d]
    total = image.reshape(h // d, d, w // d, d, c).sum(axis=(1, 3)) / (d * d)
    return np.trunc(total) if integer else total


def pieces(tiles: DataFrame, d: int, interpolation: str, integer: bool) -> DataFrame:
    """Every tile, made smaller, as a piece of its parent (level, tile_x and tile_y are the parent's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def rows() -> Iterator[tuple]:
                for (slide, level, tx, ty, w, h, n), image in images(batch):  # noqa: B023
                    small = reduced(image, d, interpolation, integer)
                    yield slide, level + 1, tx // d, ty // d, w, h, n, ty % d * (h // d), tx % d * (w // d), h // d, w // d, small

            yield from batches_of(batch.schema.field(0).type, rows(), PIECE, (pa.int32(),) * 4)

    return keyed(tiles).mapInArrow(run, pieces_schema(tiles))


def stacked(parts: DataFrame, d: int, start: int, stride: int, interpolation: str, integer: bool) -> DataFrame:
    """Tiles of the levels start + 1 .. start + stride from pieces of any of these levels; pieces carry _n, their slide's last level.

    Pieces of one slide must not overlap: a tile comes as itself or by what lies below it.
    """
    schema = tile_schema(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for each level: the key of the open tile, its slide's last level, and its samples
        open_: list[tuple | None] = [None] * stride

        def above(key: tuple, k: int) -> tuple:
            """The key of a tile's ancestor, k levels up."""
            slide, level, tx, ty, *rest = key
            return (slide, level + k, tx // d**k, ty // d**k, *rest)

        def place(key: tuple, last: int, at: tuple[int, int], part: np.ndarray) -> Iterator[tuple]:
            k = key[1] - start - 1
            # what the piece does not lie in has got all its children
            for j in range(stride):
                if open_[j] is not None and (j < k or above(key, j - k) != open_[j][0]):
                    yield from finish(j)
            if open_[k] is None:
                open_[k] = (key, last, np.zeros((key[5], key[4], key[6])))
            open_[k][2][at[0] : at[0] + part.shape[0], at[1] : at[1] + part.shape[1]] = part

        def finish(k: int) -> Iterator[tuple]:
            key, last, image = open_[k]
            open_[k] = None
            yield (*key, image)
            if k + 1 < stride and key[1] < last:
                h, w = key[5] // d, key[4] // d
                yield from place(above(key, 1), last, (key[3] % d * h, key[2] % d * w), reduced(image, d, interpolation, integer))

        kind: list[pa.DataType] = []

        def tiles() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                places = list(zip(*(batch.column(i).to_pylist() for i in range(7, 12)), strict=True))
                samples = batch.column(12)
                for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True)):
                    top, left, rows, columns, last = places[i]
                    yield from place(key, last, (top, left), np.asarray(samples[i].values).reshape(rows, columns, key[6]))
            for k in range(stride):
                if open_[k] is not None:
                    yield from finish(k)

        held, size = [], 0
        for row in tiles():
            held.append(row)
            size += row[-1].size
            if size >= AT_ONCE:
                yield from batches_of(kind[0], iter(held))
                held, size = [], 0
        if held:
            yield from batches_of(kind[0], iter(held))

    # where the child behind a piece lies, in tiles of the lowest level: along the Z curve of these, parts of a tile follow each other
    power = lambda k: F.pow(F.lit(float(d)), k)
    child = lambda tile, at, step: (F.col(tile) * d + F.floor(F.col(at) / F.col(step))) * power(F.col("level") - 1 - start)
    placed = parts.select(*KEYS, *PIECE, "_n", "samples", child("tile_x", "left", "columns").cast("bigint").alias("_x"), child("tile_y", "top", "rows").cast("bigint").alias("_y"))
    level = lambda c, k: F.floor(F.col(c) / d**k)
    curve = [level(c, k) for k in range(stride - 1, -1, -1) for c in ("_y", "_x")]
    dealt = placed.repartition("slide_id", level("_x", stride), level("_y", stride))
    names = ["tile_w", "tile_h", "n_channels"]
    return dealt.sortWithinPartitions("slide_id", level("_y", stride), level("_x", stride), *curve, *names).drop("_x", "_y").mapInArrow(run, schema)


def sizes_of(tiles: DataFrame) -> DataFrame:
    """(slide_id, width, height) that the base tiles span."""
    size = tiles.where("level = 0").groupBy("slide_id")
    return size.agg(F.max((F.col("tile_x") + 1) * F.col("tile_w")).cast("bigint").alias("width"), F.max((F.col("tile_y") + 1) * F.col("tile_h")).cast("bigint").alias("height"))


def level_table(sizes: DataFrame, factor: int = 2, max_levels: int = -1) -> DataFrame:
    """(slide_id, level, width, height, downsample) of all levels of slides (slide_id, width, height)."""
    at = sizes.withColumn("level", F.explode(F.sequence(F.lit(0), level_count(F.col("width"), factor, max_levels))))
    low = lambda c: F.floor(F.col(c) / F.pow(F.lit(float(factor)), F.col("level"))).cast("bigint")
    out = at.select("slide_id", "level", low("width").alias("width"), low("height").alias("height"), F.col("width").alias("_w"))
    return out.select("slide_id", "level", "width", "height", (F.col("_w") / F.greatest("width", F.lit(1))).alias("downsample"))


PLACE = ["slide_id", "level", "tile_x", "tile_y"]


def outside(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """(slide_id, level, tile_x, tile_y) of tiles that do not reach into their level (slide_id, level, width, height), or have none; reads no samples."""
    known = levels.select("slide_id", "level", F.col("width").alias("_w"), F.col("height").alias("_h"))
    at = per_slide(tiles.select(*PLACE, "tile_w", "tile_h"), known, "left", on=("slide_id", "level"))
    reaches = (F.col("tile_x") * F.col("tile_w") < F.col("_w")) & (F.col("tile_y") * F.col("tile_h") < F.col("_h"))
    return at.where(~F.coalesce(reaches, F.lit(False))).select(*PLACE)


def inside(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """Tiles that reach into their level.  The few others are listed first, so that no samples are shuffled to find them."""
    return tiles.join(written(outside(tiles, levels), "outside"), PLACE, "left_anti").select(*tiles.columns)


def build_tile_pyramid(tiles: DataFrame, sizes: DataFrame | None = None, factor: int = 2, max_levels: int = -1, interpolation: str = "linear", integer: bool = False, stride: int = STRIDE) -> DataFrame:
    """Base tiles (level 0) and all levels above them, for any number of slides of any sizes.

    sizes: slide_id, width, height; by default what a slide's tiles span.  Tile sizes must divide by ``factor``.
    """
    given = sizes is not None
    sizes = written(sizes_of(tiles) if sizes is None else sizes.select("slide_id", "width", "height"), "sizes")
    levels = level_table(sizes, factor, max_levels)
    top = levels.agg(F.max("level")).first()[0] or 0
    base = keyed(tiles.where("level = 0"))
    # with their own sizes no base tile lies outside
    out, below = inside(base, levels) if given else base, base
    for level in range(0, top, stride):
        # levels that a slide does not have are made with the others and dropped by their keys
        parts = pieces(below, factor, interpolation, integer).withColumn("_n", F.lit(level + stride))
        made = inside(written(stacked(parts, factor, level, stride, interpolation, integer), "levels"), levels)
        out = out.unionByName(made)
        below = made.where(F.col("level") == level + stride)
    return out
