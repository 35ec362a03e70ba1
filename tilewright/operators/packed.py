"""Work on packed tiles inside Arrow tasks: pieces of tiles are cut, shuffled and put together again; no pixel becomes a row.

A piece is a rectangle of samples (rows x columns x channels) with the tile it belongs to and its place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["slide_id", "level", "tile_x", "tile_y", "tile_w", "tile_h", "n_channels"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def tile_schema(df: DataFrame) -> str:
    """The columns of tiles, with the slide's own type."""
    return f"slide_id {df.schema['slide_id'].dataType.simpleString()}, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>"


def keyed(tiles: DataFrame, *more: str) -> DataFrame:
    """Tiles with columns in the order and types that the tasks expect."""
    kinds = {"level": "int", "tile_x": "bigint", "tile_y": "bigint", "tile_w": "int", "tile_h": "int", "n_channels": "int"}
    return tiles.select(*(F.col(k).cast(kinds[k]).alias(k) if k in kinds else F.col(k) for k in KEYS), F.col("samples").cast("array<double>").alias("samples"), *more)


def images(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """Keys (slide_id .. n_channels) and the (h, w, c) array of each tile of a batch from :func:`keyed`."""
    keys = zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)
    samples = batch.column(7)
    for i, key in enumerate(keys):
        yield key, np.asarray(samples[i].values).reshape(key[5], key[4], key[6])


def batch_of(slide: pa.DataType, rows: list[tuple], names: tuple[str, ...] = (), kinds: tuple[pa.DataType, ...] = ()) -> pa.RecordBatch:
    """Rows (slide_id .. n_channels, further values, samples) as a batch; samples stay flat."""
    columns = list(zip(*rows, strict=True)) or [()] * (8 + len(names))
    types = [slide, *_TYPES, *kinds]
    arrays = [pa.array(c, t) for c, t in zip(columns[:-1], types, strict=True)]
    flat = [np.asarray(x, float).ravel() for x in columns[-1]]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int32)
    values = pa.array(np.concatenate(flat) if flat else np.zeros(0))
    return pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(pa.array(ends), values)], [*KEYS, *names, "samples"])


#: Samples that a task collects before it hands them on.
AT_ONCE = 1 << 20


def batches_of(slide: pa.DataType, rows: Iterator[tuple], names: tuple[str, ...] = (), kinds: tuple[pa.DataType, ...] = ()) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[-1].size
        if size >= AT_ONCE:
            yield batch_of(slide, held, names, kinds)
            held, size = [], 0
    if held:
        yield batch_of(slide, held, names, kinds)


PIECE = ("top", "left", "rows", "columns")
_PIECES = (pa.int32(),) * 4


def pieces_schema(df: DataFrame) -> str:
    return tile_schema(df).replace(", samples", ", top int, left int, rows int, columns int, samples")


def assembled(pieces: DataFrame, fill: float = 0.0) -> DataFrame:
    """Tiles from their pieces; samples that no piece brings become ``fill``.

    Pieces come sorted by tile, so a task holds one tile at a time.
    """
    schema = tile_schema(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind: list[pa.DataType] = []

        def tiles() -> Iterator[tuple]:
            now, image = None, None
            for batch in batches:
                kind[:] = [batch.schema.field(0).type]
                places = list(zip(*(batch.column(i).to_pylist() for i in range(7, 11)), strict=True))
                samples = batch.column(11)
                for i, key in enumerate(zip(*(batch.column(j).to_pylist() for j in range(7)), strict=True)):
                    if key != now:
                        if now is not None:
                            yield (*now, image)
                        now, image = key, np.full((key[5], key[4], key[6]), fill)
                    top, left, rows, columns = places[i]
                    image[top : top + rows, left : left + columns] = np.asarray(samples[i].values).reshape(rows, columns, key[6])
            if now is not None:
                yield (*now, image)

        # the slide's type is known with the first row
        for row in tiles():
            yield batch_of(kind[0], [row])

    names = [*KEYS, *PIECE, "samples"]
    return pieces.select(*names).repartition(*KEYS[:4]).sortWithinPartitions(*KEYS).mapInArrow(run, schema)


def retiled(tiles: DataFrame, size: int = 512, fill: float = 0.0) -> DataFrame:
    """All slides, levels and channels in size x size tiles: each tile is cut at the new borders and the pieces are put together."""
    schema = pieces_schema(tiles)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:

            def rows() -> Iterator[tuple]:
                for (slide, level, tx, ty, w, h, n), image in images(batch):  # noqa: B023
                    x0, y0 = tx * w, ty * h
                    for ny in range(y0 // size, (y0 + h - 1) // size + 1):
                        for nx in range(x0 // size, (x0 + w - 1) // size + 1):
                            top, left = max(ny * size, y0), max(nx * size, x0)
                            part = image[top - y0 : (ny + 1) * size - y0, left - x0 : (nx + 1) * size - x0]
                            yield slide, level, nx, ny, size, size, n, top - ny * size, left - nx * size, part.shape[0], part.shape[1], part

            yield from batches_of(batch.schema.field(0).type, rows(), PIECE, _PIECES)

    return assembled(keyed(tiles).mapInArrow(cut, schema), fill)
