"""Operator 1, exact top-k search by inner product over a bit-sliced index.

Every component x becomes the integer floor(256 * x).  The index holds blocks of rows; a block keeps,
for each dimension, the bits of (value - least value of the dimension) as bitmaps over its rows, the
top ``SLICES`` bits that the dimension needs as the searchable slices and the integers themselves for exact
resolution.  Rows with larger components than 8 bits have slices of their own, one set for every 4 more bits, so that a
few wide values do not take the precision of the others' slices.

A query's components are written in signed binary digits (no two neighbours are set), so that a
component of eight bits has some three of them.  The score of every row is summed with bitmap arithmetic
only: each digit adds the slices of its dimension at its weight (complemented where the digit is
negative), and carry-save adders turn all bitmaps of one weight into one and carries to the next.  The
result is the score's own bit slices, too small by the slices left out at most, a proven bound.  Rows
are then selected from the most significant slice downward until k rows are certain; every row within
the bound of the k-th score is a boundary row, and those are resolved exactly with integer inner
products.  Nothing is approximate in the result.

Index blocks are dealt round to 64 parts at most, query blocks to parts of some 1,024 queries, and a task
takes one part of each (a cartesian product of parts), so no copies of the queries are made or broadcast, and the k best that
leave the tasks grow with the queries alone.  Each query meets each row once, in blocks.  A block is sliced once
for all query blocks of its task.

Vectors that are null or hold null or non-finite components take no part, nor do rows without id.  Vectors
of different lengths are not compared.  Scores beyond a long count as they are and are given as the nearest long.  An id that occurs more than once counts as rows of the same id: none
of them is a candidate of its own query, and a query id is answered once, for its least vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows in a block of the index, queries in a block of queries, slices kept for the search.
BLOCK_ROWS, BLOCK_QUERIES, SLICES = 16384, 512, 8
#: Most parts of the index, and queries in a part of the queries; a task takes one part of each.
INDEX_PARTS, PART_QUERIES = 64, 1024
SCALE = 256


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v, dims) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col(id_col).cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v")).withColumn("dims", F.size("v"))


def blocked(rows: DataFrame, size: int) -> DataFrame:
    """Rows (dims, n, ids binary, vals binary, block): at most ``size`` vectors of one length each.

    Blocks are cut inside the partitions that the scan gives, so nothing is shuffled; integers take four bytes
    where they fit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        held: dict[int, int] = {}

        def out(dims: int) -> pa.RecordBatch:
            parts = waiting.pop(dims)
            held.pop(dims)
            ids, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            if _width(values) < 32:
                values = values.astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["dims", "n", "ids", "vals"])

        for batch in batches:
            lengths = np.asarray(batch.column(2))
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                ids = np.asarray(part.column(0))
                values = np.asarray(part.column(1).flatten()).reshape(len(ids), dims)
                at = 0
                while at < len(ids):
                    take = min(size - held.get(dims, 0), len(ids) - at)
                    waiting.setdefault(dims, []).append((ids[at : at + take], values[at : at + take]))
                    held[dims] = held.get(dims, 0) + take
                    at += take
                    if held[dims] == size:
                        yield out(dims)
        for dims in list(waiting):
            yield out(dims)

    return rows.mapInArrow(run, "dims int, n int, ids binary, vals binary").withColumn("block", F.monotonically_increasing_id())


def _slices(values: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps [dimension, slice, word] of the top ``keep`` bits, and of each dimension the number of bits left out and all bits."""
    values = values.astype(np.int64)
    # unsigned, so that the widest range of longs fits
    base = values.astype(np.uint64) - values.min(axis=0).astype(np.uint64)
    bits = np.array([int(v).bit_length() for v in base.max(axis=0)])
    kept = min(keep, max(1, int(bits.max())))
    low = np.maximum(bits - kept, 0)
    rows = -(-len(values) // 64) * 64
    padded = np.zeros((values.shape[1], rows), np.uint64)
    padded[:, : len(values)] = (base >> low.astype(np.uint64)).T
    planes = [np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.uint64) for b in range(kept)]
    return np.stack(planes, axis=1), low, bits


def _width(values: np.ndarray) -> int:
    """Bits of the largest magnitude."""
    return max(int(values.max(initial=0)), -int(values.min(initial=0))).bit_length()


def _digits(query: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dimension, weight and sign of the signed binary digits of a query, no two of them neighbours."""
    left, weight, found = query.astype(object if _width(query) > 60 else np.int64), 0, []
    while left.any():
        digit = np.where(left & 1, 2 - (left & 3), 0)
        on = np.flatnonzero(digit)
        found.append((on, np.full(len(on), weight), digit[on].astype(np.int64)))
        left = (left - digit) >> 1
        weight += 1
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _added(bitmaps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """One bitmap and the carries of a sum of bitmaps [n, word] of one weight, by carry-save adders."""
    carries = []
    while len(bitmaps) > 2:
        m = len(bitmaps) // 3 * 3
        a, b, c = bitmaps[0:m:3], bitmaps[1:m:3], bitmaps[2:m:3]
        half = a ^ b
        carries.append((a & b) | (half & c))
        bitmaps = np.concatenate((half ^ c, bitmaps[m:]))
    if len(bitmaps) == 2:
        carries.append((bitmaps[0] & bitmaps[1])[None])
        bitmaps = (bitmaps[0] ^ bitmaps[1])[None]
    return bitmaps[0], carries


def _scores(planes: np.ndarray, query: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, int]:
    """Score slices [slice, word] of all rows, least first, and the largest error of the scores.

    Up to a constant of the query, the inner product is the sum of the slices' digits at their weights, times two to the power of
    the least number of bits left out, plus an error from a range as wide as the bound, as the low bits of the rows are left out.
    """
    keep, words = planes.shape[1:]
    flat = planes.reshape(-1, words)
    dim, weight, sign = _digits(query)
    s = np.arange(keep)
    plane, at, flip = (dim[:, None] * keep + s).ravel(), ((weight + low[dim] - low.min(initial=0))[:, None] + s).ravel(), np.repeat(sign < 0, keep)
    order = np.argsort(at, kind="stable")
    plane, at, flip = plane[order], at[order], np.where(flip[order], np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    cut = np.searchsorted(at, np.arange(int(at.max(initial=-1)) + 2))
    out, carries, w = [], [], 0
    while w < len(cut) - 1 or carries:
        mine = slice(cut[w], cut[w + 1]) if w < len(cut) - 1 else slice(0, 0)
        bitmaps = np.concatenate([flat[plane[mine]] ^ flip[mine, None], *carries])
        one, carries = _added(bitmaps) if len(bitmaps) else (np.zeros(words, np.uint64), [])
        out.append(one)
        w += 1
    return np.array(out or [np.zeros(words, np.uint64)]), sum(abs(int(query[d])) * ((1 << int(low[d])) - 1) for d in np.flatnonzero(low))


def _boundary(slices: np.ndarray, error: int, shift: int, alive: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows that can be among the k best of one query.

    From the most significant slice downward the rows that share the k-th score's prefix stay; once
    they are known, the k-th score is a bound and a second descent keeps every row whose score plus
    the error reaches it.
    """
    sure, same, need, bound = np.zeros_like(alive), alive.copy(), k, 0
    for level in range(len(slices) - 1, -1, -1):
        one = same & slices[level]
        n = int(np.bitwise_count(one).sum())
        if n >= need:
            same, bound = one, bound | (1 << level)
        else:
            sure, need, same = sure | one, need - n, same & ~slices[level]
    least = max(0, -((error - (bound << shift)) // (1 << shift))) if error <= (bound << shift) else 0
    above, equal = np.zeros_like(alive), alive.copy()
    for level in range(max(len(slices), least.bit_length()) - 1, -1, -1):
        plane = slices[level] if level < len(slices) else np.zeros_like(alive)
        if (least >> level) & 1:
            equal = equal & plane
        else:
            above, equal = above | (equal & plane), equal & ~plane
    return above | equal


def boundary_rows(planes: np.ndarray, low: np.ndarray, query: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """The rows that the slices can't exclude from the k best of one query."""
    slices, error = _scores(planes, query, low)
    near = _boundary(slices, error, int(low.min(initial=0)), alive, k)
    return np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))


@dataclass
class Part:
    """Rows of a block with components of about the same width: the integers, their slices, and the order of their ids."""

    ids: np.ndarray
    values: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    order: np.ndarray
    width: int

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the rows that the slices can't exclude; none of them has the query's id."""
        alive = np.packbits(np.arange(self.planes.shape[2] * 64) < len(self.ids), bitorder="little").view(np.uint64)
        own = self.order[slice(*np.searchsorted(self.ids, [query_id, query_id + 1], sorter=self.order))]
        np.bitwise_and.at(alive, own // 64, ~(np.uint64(1) << (own % 64).astype(np.uint64)))
        rows = boundary_rows(self.planes, self.low, query, alive, k)
        kind = object if self.width + _width(query) + len(query).bit_length() > 62 else np.int64
        return self.ids[rows], self.values[rows].astype(kind) @ query.astype(kind) if len(query) else np.zeros(len(rows), np.int64)


def indexed(ids: np.ndarray, values: np.ndarray) -> list[Part]:
    """The index of one block of rows: a part for components of up to 8 bits, and one for every 4 bits more."""
    most = np.maximum(values.max(axis=1, initial=0), ~values.min(axis=1, initial=0)).astype(float)
    width = np.maximum(np.ceil((np.floor(np.log2(most + 1)) - 8) / 4), 0)
    parts = []
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        mine, v = ids[rows], values[rows]
        planes, low, _ = _slices(v, SLICES) if v.shape[1] else (np.zeros((0, 1, -(-len(rows) // 64)), np.uint64), np.zeros(0, np.int64), None)
        parts.append(Part(mine, v, planes, low, np.argsort(mine, kind="stable"), _width(v)))
    return parts


def search(parts: list[Part], query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of one indexed block for each query: query ids, row ids, scores."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, query in zip(query_ids.tolist(), queries, strict=True):
        ids, scores = (np.concatenate(x) for x in zip(*(part.best(q, query, k) for part in parts), strict=True))
        best = np.lexsort((ids, -scores if scores.dtype == object else ~scores))[:k]
        found.append((np.full(len(best), q, np.int64), ids[best], scores[best]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def search_block(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return search(indexed(ids, values), query_ids, queries, k)


def _vectors(raw: bytes, n: int, dims: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dims else np.int64).reshape(n, dims)


def top_k(vectors: DataFrame, query_ids, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows for every query: (query_id, rank, vec_id, score).

    ``query_ids`` is a Column condition on ``vec_id`` that states which rows are queries.
    """
    rows = quantised(vectors, id_col, vector_col)
    # both written, so that blocks stay the same when a task runs again
    index = written(blocked(rows, block_rows), "index")
    asked = rows.where(query_ids).groupBy("vec_id", "dims").agg(F.min("v").alias("v")).select("vec_id", "v", "dims")
    asks = written(blocked(asked, BLOCK_QUERIES).select("dims", F.col("n").alias("asked"), F.col("ids").alias("q_ids"), F.col("vals").alias("q_vals")), "queries")
    # two numbers
    blocks, queries = index.count(), asks.agg(F.sum("asked")).first()[0] or 0
    index, asks = index.repartition(min(INDEX_PARTS, max(1, blocks))), asks.repartition(-(-max(1, queries) // PART_QUERIES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["block"] != block:
                    block, parts = row["block"], indexed(np.frombuffer(row["ids"], np.int64), _vectors(row["vals"], row["n"], row["dims"]))
                q, v, s = search(parts, np.frombuffer(row["q_ids"], np.int64), _vectors(row["q_vals"], row["asked"], row["dims"]), k)
                s = s.tolist()
                longs = pa.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in s], pa.int64())
                # the exact score as bytes in the order of the scores
                exact = pa.array([(x + (1 << 191)).to_bytes(24, "big") for x in s], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), longs, exact], ["query_id", "vec_id", "score", "exact"])

    # a part of the queries is read by each task that needs it: copies of them would outgrow a broadcast, and the disk
    pairs = index.join(asks.hint("shuffle_replicate_nl"), "dims").select("block", "dims", "n", "ids", "vals", "asked", "q_ids", "q_vals")
    best = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
