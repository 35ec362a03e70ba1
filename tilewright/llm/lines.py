"""Operator 5, line dedup: repeated runs of lines by distributed prefix doubling over line ids.

A line that holds a word has an id, the hash of its trimmed bytes; other lines have no part in runs.  Prefix doubling names
blocks of 1, 2, 4 .. lines: the name of a block of 2h lines is the pair of the names of its halves.  Each
round counts names over the corpus and goes on only with blocks that occur more than once, so later rounds
are small.  A run of any length c is named by its first and its last block of the largest power of two up to c.

A run counts as repeated if it holds at least ``min_words`` words and also occurs earlier (a smaller doc_id, or
earlier in the same document).  Every qualifying run is the union of shortest qualifying runs (the shortest
that starts at a line, and the shortest that ends at one), and where a run occurs earlier, so do they; so
only those, of at most ``min_words`` lines each, are looked up by name.  Their union gives the maximal
repeated runs, and those later copies are deleted with their line ends.

Defined cases: a null text has no lines; rows with a null id are kept whole; rows with a repeated id are
ordered by the hash of their text and equal such rows are one document; further columns are ignored by
:func:`dedup_lines`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranges, steps, word_hashes, words, written

MIN_WORDS = 6
PLACE = ["doc_id", "v", "ln"]


def line_table(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of all lines with words: row, byte span with its line end, hash of the trimmed line, words.

    Row r's lines are cut at newlines; the span of a line includes the newline that ends it.
    """
    starts, ends, rows = words(data, offsets)
    newline = np.flatnonzero(data == 10)
    edges = np.union1d(newline + 1, offsets[:-1])
    line = np.searchsorted(edges, starts, "right") - 1
    first = np.ones(len(line), bool)
    first[1:] = line[1:] != line[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(line)))
    closing = np.append(edges[1:], len(data))
    last = ends[begin + count - 1] if len(begin) else ends[:0]
    hashes = word_hashes(data, starts[begin], last)
    return rows[begin], edges[line[begin]], closing[line[begin]], hashes, count


def shortest_runs(row: np.ndarray, count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines in the shortest run of enough words that starts, and that ends, at each line; 0 if there is none."""
    n = len(row)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(count)))
    i = np.arange(n)
    begin = np.searchsorted(row, row, "left")
    end = np.searchsorted(row, row, "right")
    stop = np.searchsorted(total, total[:-1] + least, "left")
    forward = np.where(stop <= end, stop - i, 0)
    back = np.searchsorted(total, total[1:] - least, "right") - 1
    backward = np.where((total[1:] - total[begin] >= least), i + 1 - back, 0)
    return forward, backward


def lines_of(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            row, _, _, name, count = line_table(data, offsets)
            ln = np.arange(len(row)) - np.searchsorted(row, row, "left")
            forward, backward = shortest_runs(row, count, min_words)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(ln.astype(np.int32)), pa.array(name.view(np.int64)), pa.array(forward.astype(np.int32)), pa.array(backward.astype(np.int32))], [*PLACE, "name", "forward", "backward"])

    return docs.mapInArrow(run, "doc_id bigint, v bigint, ln int, name bigint, forward int, backward int")


def repeated(blocks: DataFrame) -> DataFrame:
    """The blocks whose name occurs more than once."""
    often = blocks.groupBy("name").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("name")
    # written, so that both sides of the join are plain shuffles, whose large partitions Spark can split
    return blocks.join(written(often, "often"), "name")


def doubled(blocks: DataFrame, h: int) -> DataFrame:
    """Blocks of 2h lines from blocks of h lines."""
    right = blocks.select("doc_id", "v", (F.col("ln") - h).alias("ln"), F.col("name").alias("next"))
    return blocks.join(right, PLACE).select(*PLACE, F.xxhash64("name", "next", F.lit(h)).alias("name"))


def covered_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """Rows (doc_id, v, start, c): shortest qualifying runs that occur earlier."""
    blocks = written(repeated(lines), "lines")
    runs = blocks.where("forward > 0").select("doc_id", "v", F.col("ln").alias("start"), F.col("forward").alias("c"))
    runs = runs.unionByName(blocks.where("backward > 0").select("doc_id", "v", (F.col("ln") - F.col("backward") + 1).alias("start"), F.col("backward").alias("c"))).distinct()
    runs = written(runs, "runs")
    named, h = [], 1
    level = blocks.select(*PLACE, "name")
    while True:
        mine = runs.where(F.col("c").between(h, 2 * h - 1))
        first = level.select("doc_id", "v", F.col("ln").alias("start"), F.col("name").alias("a"))
        last = level.select("doc_id", "v", F.col("ln").alias("at"), F.col("name").alias("b"))
        named.append(mine.join(first, ["doc_id", "v", "start"]).withColumn("at", F.col("start") + F.col("c") - h).join(last, ["doc_id", "v", "at"]).select("doc_id", "v", "start", "c", F.xxhash64("a", "b", "c").alias("name")))
        h *= 2
        if h > min_words:
            break
        level = written(repeated(doubled(level, h // 2)), "level")
    windows = named[0]
    for more in named[1:]:
        windows = windows.unionByName(more)
    windows = written(windows, "windows")
    least = windows.groupBy("name").agg(F.min(F.struct("doc_id", "v", "start")).alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    return windows.join(written(least, "least"), "name").where(F.col("first") < F.struct("doc_id", "v", "start")).select("doc_id", "v", "start", "c")


def with_covered(docs: DataFrame, min_words: int) -> DataFrame:
    """docs (doc_id, v, text, ..) with ``found``, the covered runs of each row's document."""
    lines = lines_of(docs.where("doc_id is not null").select("doc_id", "v", "text"), min_words)
    runs = covered_runs(lines, min_words).groupBy("doc_id").agg(F.collect_list(F.struct("v", "start", "c")).alias("found"))
    return docs.join(runs.hint("shuffle_hash"), "doc_id", "left")


def kept_text(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The kept bytes, number of lines with words, and number of those removed, of each row of a batch."""
    row, begin, end, _, _ = line_table(data, offsets)
    at = np.searchsorted(row, np.arange(len(part) + 1))
    found = part.column(part.schema.get_field_index("found"))
    counts = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
    edges = np.zeros(len(row) + 1, np.int64)
    if counts.sum():
        flat = found.flatten()
        owner = np.repeat(np.arange(len(part)), counts)
        v, start, c = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
        mine = v == np.asarray(part.column(part.schema.get_field_index("v")))[owner]
        np.add.at(edges, at[owner[mine]] + start[mine], 1)
        np.add.at(edges, at[owner[mine]] + start[mine] + c[mine], -1)
    gone = np.flatnonzero(np.cumsum(edges)[:-1] > 0)
    keep = np.ones(len(data), bool)
    keep[ranges(begin[gone], (end - begin)[gone])] = False
    raw = data[keep].tobytes()
    cut = np.concatenate(([0], np.cumsum(keep)))[offsets].tolist()
    removed = np.bincount(row[gone], minlength=len(part))
    # a text whose last line goes ends without the newline before it
    kept = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    kept = [k[:-1] if removed[i] and k.endswith(b"\n") and data[offsets[i + 1] - 1] != 10 else k for i, k in enumerate(kept)]
    return kept, np.diff(at), removed


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"xxhash64(cast(`{text_col}` as string)) as v", f"cast(`{text_col}` as string) as text")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines (with words), n_removed, kept_sha256 and, if wanted, the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            kept, n, removed = kept_text(part, data, offsets)
            columns = [part.column(0), pa.array(n), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            names = ["doc_id", "n_lines", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([k.decode() for k in kept]))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    return with_covered(marked(docs, id_col, text_col), min_words).mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with all its columns, its texts without repeated runs of lines.

    A document all of whose lines are copies goes; ``length_col``, if named, becomes the new length in characters.
    """
    names, schema = docs.columns, docs.schema
    others = [F.col(f"`{c}`").alias(f"kept_{i}") for i, c in enumerate(names)]
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("v"), F.col(text_col).cast("string").alias("text"), *(o for c, o in zip(names, others, strict=True) if c != text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            kept, n, removed = kept_text(part, data, offsets)
            columns = []
            for i, c in enumerate(names):
                if c == text_col:
                    was = part.column(2)
                    columns.append(pc.if_else(pa.array(removed == 0), was, pa.array([k.decode() for k in kept], was.type)))
                else:
                    columns.append(part.column(part.schema.get_field_index(f"kept_{i}")))
            if length_col:
                i = names.index(length_col)
                columns[i] = pc.if_else(pa.array(removed == 0), columns[i], pc.utf8_length(columns[names.index(text_col)]).cast(columns[i].type))
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array((removed == 0) | (removed < n)))

    return with_covered(picked, min_words).mapInArrow(run, schema)
