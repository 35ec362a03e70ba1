"""Operator 4, substring dedup of word sequences by prefix-partitioned suffix trees.

Suffixes are cut into memory-sized groups by a prefix (a k-gram, extended up to a whole window until its group
fits; see :mod:`repeats`).  A group's suffixes form a tree that is built level by level: the
children of a node are the distinct next words of its suffixes.  A second tree holds what stands before the
prefix, read backwards.  A pair of nodes whose depths and prefix add up to the window length is a deep
internal node: if suffixes of several documents share it, the later ones' windows are repeats.

A word is removed if a window of ``length`` words that covers it also starts in a document with a smaller
doc_id.  Defined cases: a null or empty text has no words; rows with a null id are kept whole and no other row
is compared with them; rows with a repeated id are one document (they do not remove words of each other);
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ranges, steps, text_bytes, word_hashes, words
from .repeats import Rule, removed_symbols, symbols, with_runs

LENGTH, K = 50, 13


def levels(values: np.ndarray, first: np.ndarray, step: int, room: np.ndarray, group: np.ndarray, depth: int) -> list[np.ndarray]:
    """Node numbers of suffixes at depths 0 .. depth; a suffix that has ended has a node of its own."""
    node = group.astype(np.int64)
    out = [node]
    many = len(node)
    for d in range(depth):
        on = np.flatnonzero(room > d)
        child = np.arange(many) + many
        if len(on):
            word = values[first[on] + step * d]
            order = np.lexsort((word, node[on]))
            a, b = node[on][order], word[order]
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            child[on[order]] = np.cumsum(fresh) - 1
        node = child
        out.append(node)
    return out


def suffix_trees(content: pa.Array, left: np.ndarray, group: np.ndarray, depth: int, k: int = K) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Levels of the backward and the forward tree of word contexts."""
    data, offsets = text_bytes(content)
    starts, ends, rows = words(data, offsets)
    values = word_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=len(content))
    at = np.cumsum(count) - count
    anchor = at + left
    before = levels(values, anchor - 1, -1, left, group, depth)
    after = levels(values, anchor + k, 1, at + count - anchor - k, group, depth)
    return before, after


RULE = Rule("words", LENGTH, K, "smaller", suffix_trees)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, fit: int | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept text (words joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            _, at, starts, ends = symbols("words", data, offsets)
            gone = removed_symbols(part, at, LENGTH)
            keep = np.flatnonzero(~gone)
            size = (ends - starts)[keep]
            into = np.cumsum(size + 1) - size - 1
            flat = np.full(int((size + 1).sum()), 32, np.uint8)
            flat[ranges(into, size)] = data[ranges(starts[keep], size)]
            total = np.concatenate(([0], np.cumsum(~gone)))[at]
            byte = np.concatenate((into, [len(flat)]))[total]
            raw = flat.tobytes()
            kept = [raw[a : max(a, b - 1)] for a, b in zip(byte[:-1].tolist(), byte[1:].tolist(), strict=True)]
            n = np.diff(at)
            columns = [part.column(0), pa.array(n), pa.array(n - np.diff(total)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array([x.decode() for x in kept]))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * keep_text
    return with_runs(docs, RULE, id_col, text_col, fit).mapInArrow(run, schema)
