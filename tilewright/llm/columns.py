"""Operator 7, byte-level suffix-array dedup by column-wise construction for many strings at once.

Built for a whole corpus of long documents, column-wise insertion would need one pass for each byte of the
longest document.  So it is applied where it is at home, to many short strings: the contexts of repeated
anchors (see :mod:`repeats`), at most ``length`` bytes to each side.  One symbol of every string is inserted a
round, from the last column to the first.  A round takes the transform's newest segment (the symbols that stand before
the strings' current suffixes, in the order of those), sorts the suffixes by it, stably and within their group, and
updates the common prefixes of neighbours: one more than the least of the old ones between them where their symbols
agree, else 0.  Only the newest segment can change the order, so older ones are not kept, and the state of
a round (order, segment, common prefixes) is a few numbers a string: it stays in the memory of the task, whose
groups are bounded, and no external files are written.  Runs of
neighbours whose common prefix reaches a depth are the suffix-array intervals of that depth.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a
smaller doc_id, or earlier in the same document.  Overlapping occurrences count.  Defined cases: a null text is
empty; rows with a null id are kept whole and no other row is compared with them; rows with a repeated id are
ordered by the hash of their text, and equal such rows are one document; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import steps, text_bytes
from .repeats import Rule, removed_symbols, with_runs

LENGTH, K = 100, 24
END = 256


def inserted(columns: np.ndarray, group: np.ndarray, end: int = END, watch: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings (rows) by group and symbols, and each one's common prefix with the one before (-1: none).

    ``watch(column, order, segment, lcp)`` is called after each round.
    """
    many, width = columns.shape
    order = np.argsort(group, kind="stable")
    groups = np.unique(group[order], return_inverse=True)[1]  # of each place in the order, in all rounds
    small = groups.astype(np.uint16) if len(groups) and groups[-1] < 1 << 16 else groups
    inside = np.zeros(many, bool)
    inside[1:] = groups[1:] == groups[:-1]
    lcp = np.append(np.where(inside, 0, -1), 0)
    for c in range(width - 1, -1, -1):
        segment = columns[order, c]
        into = np.argsort(segment, kind="stable")
        into = into[np.argsort(small[into], kind="stable")]
        a, b = into[:-1], into[1:]
        agree = np.flatnonzero(inside[1:] & (segment[a] == segment[b]) & (segment[b] != end))
        new = np.where(inside, 0, -1)
        if len(agree):
            between = np.stack((a[agree] + 1, b[agree] + 1), 1).ravel()
            new[agree + 1] = 1 + np.minimum.reduceat(lcp, between)[::2]
        order, lcp[:-1] = order[into], new
        if watch:
            watch(c, order, segment, lcp[:-1])
    return order, lcp[:-1]


def intervals(columns: np.ndarray, group: np.ndarray, end: int = END) -> list[np.ndarray]:
    """For each depth, the number of the suffix-array interval that holds each string."""
    order, lcp = inserted(columns, group, end)
    out = []
    for depth in range(columns.shape[1] + 1):
        number = np.empty(len(group), np.int64)
        number[order] = np.cumsum(lcp < depth)
        out.append(number)
    return out


def byte_contexts(content: pa.Array, left: np.ndarray, group: np.ndarray, depth: int, k: int = K) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Intervals of what stands before (read backwards) and after the anchors, by depth."""
    data, offsets = text_bytes(content)
    anchor = offsets[:-1] + left
    room = offsets[1:] - anchor - k
    d = np.arange(depth)[None, :]
    padded = np.append(data.astype(np.uint16), np.uint16(END))
    none = len(data)
    before = padded[np.where(d < left[:, None], anchor[:, None] - 1 - d, none)]
    after = padded[np.where(d < room[:, None], anchor[:, None] + k + d, none)]
    return intervals(before, group), intervals(after, group)


RULE = Rule("bytes", LENGTH, K, "earlier", byte_contexts)


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True, fit: int | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            gone = removed_symbols(part, offsets, LENGTH)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            edge = offsets[:-1][offsets[:-1] < len(data)]
            first[edge] = gone[edge]
            count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
            n, removed = np.diff(offsets), count(gone)
            raw = data[~gone].tobytes()
            at = np.concatenate(([0], np.cumsum(n - removed))).tolist()
            kept = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [part.column(0), pa.array(n), pa.array(removed), pa.array(count(first)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_bytes:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * keep_bytes
    return with_runs(docs, RULE, id_col, text_col, fit).mapInArrow(run, schema)
