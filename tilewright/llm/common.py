"""Shared helpers: text columns as flat byte arrays, word hashes, checkpoints and connected components.

The numpy helpers work on one Arrow batch inside a Spark task.  A text column is seen as one flat
array of UTF-8 bytes with row offsets, so that tokenising and hashing are array operations and no
Python loop runs over words.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import iterate
from ..plans.iterate import discard

#: Bytes of text that one step of a task works on; a single longer document is a step of its own.
STEP_BYTES = 1 << 20
LONG = 512

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parquet(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.step = path
    return back


def written(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` below the session's shared folder (``spark.checkpoint.dir``, or its owner's part of it) and read it again, which cuts the lineage."""
    return _parquet(df, f"{iterate.folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def made(spark: SparkSession, make: Callable[[], DataFrame], name: str = "stage") -> DataFrame:
    """What ``make`` returns, written and read again; all that it has written on its way is deleted then."""
    path = f"{iterate.folder(spark)}/{name}-{uuid.uuid4().hex}"
    with iterate.steps(spark):
        return _parquet(make(), path)


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, so that every bit of a hash depends on all of its input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64; kept and extended by doubling."""
    key = "inverse" if inverse else "base"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        step = _INVERSE if inverse else _BASE
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * np.uint64(pow(int(step), done, 1 << 64))
            done *= 2
        _powers[key] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat UTF-8 bytes and ``len + 1`` offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1 + column.offset)
    offsets = offsets[column.offset :].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches with at most STEP_BYTES of text each (or one row), with bytes and offsets."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
            end = min(end, len(batch))
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words ``[^\\x20\\x09-\\x0D]+``; no word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_hashes(symbols: np.ndarray) -> np.ndarray:
    """Running sums of ``(symbol + 1) * base ** position``; see :func:`span_hashes`."""
    out = np.zeros(len(symbols) + 1, np.uint64)
    if len(symbols):
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(len(symbols)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the content of each span, independent of where it lies."""
    inverse = powers(len(prefix), inverse=True)
    return mixed(((prefix[ends] - prefix[starts]) * inverse[starts]) ^ mixed((ends - starts).astype(np.uint64)))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words or lines; spans of over LONG bytes, for which colliding texts are known, by BLAKE2."""
    out = span_hashes(prefix_hashes(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[0] .. starts[0] + lengths[0] - 1, starts[1] ..`` in one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return base + np.arange(total)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component): the least node that the links reach from each node that has a link.

    Every round each node takes the least label among its neighbours and itself and then the label
    of that label (pointer jumping), so that chains shorten by half.  Aggregation is partial before
    each shuffle, so a node with very many links is no hot task.
    """
    both = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    links = written(both, "links")
    both = written(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        step = labels.join(near, "u", "left").select("u", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("m"))
        up = labels.select(F.col("u").alias("m"), F.col("c").alias("mc"))
        new = written(step.join(up, "m", "left").select("u", "old", F.least("m", F.coalesce("mc", "m")).alias("c")), "labels")
        changed = new.where("c <> old").limit(1).count()
        discard(labels)
        labels = new.select("u", "c")
        if not changed:
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words each followed by one space in one flat array, and where each starts in it (with the end as last)."""
    size = ends - starts
    into = np.concatenate(([0], np.cumsum(size + 1)))
    flat = np.full(int(into[-1]), 32, np.uint8)
    flat[ranges(into[:-1], size)] = data[ranges(starts, size)]
    return flat, into


def row_texts(flat: np.ndarray, into: np.ndarray, at: np.ndarray) -> list[bytes]:
    """The words of each row joined by one space; row i has words ``at[i] .. at[i + 1] - 1`` of :func:`joined_words`."""
    raw, cuts = flat.tobytes(), into[at].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
