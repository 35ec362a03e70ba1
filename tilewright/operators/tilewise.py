"""User functions on tiles: image to image, image to rows, and tiles with a halo of their neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .packed import KEYS, keyed, tile_schema

Image = np.ndarray
#: Which neighbour a strip comes from (-1: from below or the right), and its size.
STRIP = ("dy", "dx", "rows", "columns")


def _tile(df: DataFrame, more: str = "") -> str:
    """The schema of tiles with the slide's own type, and further columns before the samples."""
    return tile_schema(df).replace(", samples", f"{more}, samples")


def _refused(image: Image, requires: Callable[[Image], str | None] | None) -> None:
    """Ends the job with the message that ``requires`` gives for an image it does not accept."""
    if requires and (why := requires(image)):
        raise ValueError(f"tile refused: {why}")


def channels(*accepted: int) -> Callable[[Image], str | None]:
    """A requirement on the number of channels."""
    return lambda image: None if image.shape[2] in accepted else f"{image.shape[2]} channels, not {accepted}"


def _image(row) -> np.ndarray:
    return np.asarray(row.samples).reshape(row.tile_h, row.tile_w, row.n_channels)


def tile_map(tiles: DataFrame, fn: Callable[[Image], Image], requires: Callable[[Image], str | None] | None = None) -> DataFrame:
    """``fn`` maps each tile's (h, w, c) array to one of the same height and width.

    ``requires`` says what is wrong with an array that ``fn`` can't take, or gives None; a tile that it refuses, and a result of another size, end the job.
    """

    def checked(image: Image) -> Image:
        _refused(image, requires)
        made = np.asarray(fn(image), float)
        if made.shape[:2] != image.shape[:2]:
            raise ValueError(f"a tile of {image.shape[:2]} became one of {made.shape[:2]}")
        return made

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [checked(_image(r)) for r in batch.itertuples(index=False)]
            out = batch[KEYS].copy()
            out["n_channels"] = [m.shape[2] if m.ndim == 3 else 1 for m in made]
            out["samples"] = [m.ravel() for m in made]
            yield out

    return tiles.select(*KEYS, "samples").mapInPandas(run, tile_schema(tiles))


def tile_flat_map(tiles: DataFrame, fn: Callable[[Image, int, int], pd.DataFrame], schema: str, requires: Callable[[Image], str | None] | None = None) -> DataFrame:
    """``fn(image, x0, y0)`` gives any number of rows for each tile; slide_id is put in front.  ``requires`` as in :func:`tile_map`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                image = _image(r)
                _refused(image, requires)
                rows = fn(image, r.tile_x * r.tile_w, r.tile_y * r.tile_h)
                rows.insert(0, "slide_id", r.slide_id)
                yield rows

    return tiles.select(*KEYS, "samples").mapInPandas(run, f"slide_id {tiles.schema['slide_id'].dataType.simpleString()}, {schema}")


def _spans(samples: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    """The samples of rows that have equally many, one row each."""
    ends = np.asarray(samples.offsets)
    return np.asarray(samples.values)[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])]


def _lists(flat: np.ndarray) -> pa.ListArray:
    """A list for each row of a two-dimensional array."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


def _alike(*columns: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """Row numbers by the values of columns."""
    values, which = np.unique(np.stack(columns, 1), axis=0, return_inverse=True)
    for i, v in enumerate(values.tolist()):
        yield v, np.flatnonzero(which.ravel() == i)


def _numbers(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def with_halo(tiles: DataFrame, k: int, fill: float = 0.0) -> DataFrame:
    """Tiles widened by k samples of their neighbours on each side, so that filters have no seams; a k over a tile's size is an error.

    Each tile goes whole to itself, and to its eight neighbours only as the strip or corner of width k that they need.
    These come sorted by tile, at most nine for each, and a batch of tiles is put together at once.
    """
    schema = tile_schema(tiles)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (w, h, n), rows in _alike(*_numbers(batch, 4, 5, 6)):
                if k > min(h, w):
                    raise ValueError(f"a halo of {k} is wider than tiles of {w} x {h}")
                part, images_ = batch.take(pa.array(rows)), _spans(batch.column(7), rows).reshape(len(rows), h, w, n)
                for dy, ys in ((-1, slice(0, k)), (0, slice(0, h)), (1, slice(h - k, h))):
                    for dx, xs in ((-1, slice(0, k)), (0, slice(0, w)), (1, slice(w - k, w))):
                        cut = images_[:, ys, xs]
                        x, y = (pc.add(part.column(c), pa.scalar(d, pa.int64())) for c, d in ((2, dx), (3, dy)))
                        about = [pa.array(np.full(len(rows), v, np.int32)) for v in (dy, dx, *cut.shape[1:3])]
                        yield pa.RecordBatch.from_arrays([*part.columns[:2], x, y, *part.columns[4:7], *about, _lists(cut.reshape(len(rows), -1))], [*KEYS, *STRIP, "samples"])

    def joined(batch: pa.RecordBatch, tile: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole tiles; ``tile`` numbers the tile of each row."""
        w, h, n, dy, dx, rows, columns = _numbers(batch, 4, 5, 6, 7, 8, 9, 10)
        own = np.full(tile[-1] + 1, -1)
        mine = np.flatnonzero((dy == 0) & (dx == 0))[::-1]
        own[tile[mine]] = mine  # the first, should a tile come twice
        there = np.flatnonzero(own[tile] >= 0)
        if not len(there):
            return
        to = own[tile[there]]
        for (tw, th, tn), at in _alike(w[to], h[to], n[to]):
            of, first = there[at], np.unique(to[at])
            wide = np.full((len(first), th + 2 * k, tw + 2 * k, tn), fill, float)
            for (y, x, r, c), some in _alike(dy[of], dx[of], rows[of], columns[of]):
                top, left, source = (0, k, th + k)[1 - y], (0, k, tw + k)[1 - x], of[some]
                wide[np.searchsorted(first, own[tile[source]]), top : top + r, left : left + c] = _spans(batch.column(11), source).reshape(-1, r, c, tn)
            part = batch.take(pa.array(first))
            sides = [pa.array(np.full(len(first), v + 2 * k, np.int32)) for v in (tw, th)]
            yield pa.RecordBatch.from_arrays([*part.columns[:4], *sides, part.column(6), _lists(wide.reshape(len(first), -1))], [*KEYS, "samples"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last tile, which may go on in the next batch
        for batch in batches:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(0).dictionary_encode("encode").indices), *_numbers(batch, 1, 2, 3)]
            tile = np.concatenate(([0], np.cumsum(np.any([c[1:] != c[:-1] for c in keys], axis=0))))
            last = int(np.searchsorted(tile, tile[-1]))
            if last:
                yield from joined(batch.slice(0, last), tile[:last])
            held = batch.slice(last)
        if held is not None:
            yield from joined(held, np.zeros(held.num_rows, np.int64))

    if not k:
        return keyed(tiles)
    sent = keyed(tiles).mapInArrow(strips, _tile(tiles, "".join(f", {c} int" for c in STRIP)))
    place = KEYS[:4]
    return sent.repartition(*place).sortWithinPartitions(*place).mapInArrow(join, schema)


def register_tile_function(spark: SparkSession, name: str, fn: Callable[[Image, int, int], list[tuple]], schema: str, requires: Callable[[Image], str | None] | None = None) -> None:
    """A table function for SQL: ``SELECT * FROM name(TABLE(tiles) PARTITION BY (slide_id, tile_y))``.

    ``fn(image, x0, y0)`` gives the rows of a tile, of the columns in ``schema``; slide_id, with the type it has in the table, is put in
    front.  The table must have the columns of tiles (checked when the query is analysed), in any order and beside others.
    """
    columns = T.StructType.fromDDL(schema)

    class TileFunction:
        @staticmethod
        def analyze(tiles: AnalyzeArgument) -> AnalyzeResult:
            if not tiles.isTable:
                raise ValueError(f"{name} takes a table of tiles: {name}(TABLE(..))")
            missing = [c for c in (*KEYS, "samples") if c not in tiles.dataType.fieldNames()]
            if missing:
                raise ValueError(f"{name} needs the columns {missing}")
            return AnalyzeResult(T.StructType([T.StructField("slide_id", tiles.dataType["slide_id"].dataType), *columns.fields]))

        def eval(self, tile: T.Row):
            image = np.asarray(tile["samples"]).reshape(tile["tile_h"], tile["tile_w"], tile["n_channels"])
            _refused(image, requires)
            for row in fn(image, tile["tile_x"] * tile["tile_w"], tile["tile_y"] * tile["tile_h"]):
                yield (tile["slide_id"], *row)

    spark.udtf.register(name, udtf(TileFunction))
