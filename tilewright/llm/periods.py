"""Operator 12, periodic run detection by recursive frequency splitting.

A run is a stretch of consecutive words with smallest period q and at least ``max(6, 4 * q)`` words that no
neighbouring word extends.  Each of its words occurs four times or more in it, so a word that occurs more rarely within
its segment can't belong to one and splits the segment; pieces are split again until nothing changes.  What survives
(little, in prose) is scanned lag by lag: a run of period q has a multiple of q at which a block of
2 * q words equals the block q words on, so only multiples are tried, by hashes; hits are extended
by bisection, and every run is compared word by word in the end.

One pass over the documents without a shuffle; a task holds some 1 MB of text or one document.

Defined cases: a null or empty text, and one without words, has no runs and keeps nothing; rows of a repeated or a
null id are taken one by one; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_words, mixed, prefix_hashes, ranges, row_texts, span_hashes, steps, words

#: The fewest words of a run, the fewest periods in it, and the anchors that are tried at once.
LEAST, TIMES, AT_ONCE = 6, 4, 1 << 20

#: For a document's id and number of words: the word from which it repeats itself, and the period; None: as it is.
Rebuild = Callable[[int | None, int], "tuple[int, int] | None"]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """One document of ten repeats itself from some word on."""
    if doc_id is None or n == 0 or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers (exactly)."""
    if not len(starts):
        return np.zeros(0, np.int64)
    # words and what lies between them in turn, over the bytes as they are
    cuts = np.empty(2 * len(starts), np.int64)
    cuts[0::2], cuts[1::2] = starts, ends
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return np.asarray(both.take(pa.array(np.arange(0, len(cuts) - 1, 2))).dictionary_encode().indices).astype(np.int64)


def surviving(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word is frequent enough."""
    pos, seg, kinds = np.arange(len(ids)), rows.astype(np.int64), int(ids.max(initial=0)) + 1
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(pos):
        key = seg * kinds + ids[pos]
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        rare = counts[inverse] < TIMES
        split = np.bincount(seg, rare, minlength=int(seg[-1]) + 1) > 0
        # segments that no rare word splits are stable
        stay = ~split[seg]
        if stay.any():
            p, s = pos[stay], seg[stay]
            first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            done.append((p[first], p[np.concatenate((first[1:] - 1, [len(p) - 1]))] + 1))
        on = ~stay & ~rare
        pos, seg = pos[on], seg[on]
        if len(pos):
            fresh = np.concatenate(([True], (pos[1:] != pos[:-1] + 1) | (seg[1:] != seg[:-1])))
            seg = np.cumsum(fresh) - 1
            long = np.bincount(seg)[seg] >= LEAST
            pos, seg = pos[long], seg[long]
    if not done:
        none = np.zeros(0, np.int64)
        return none, none
    starts, ends = (np.concatenate(x) for x in zip(*done, strict=True))
    enough = ends - starts >= LEAST
    return starts[enough], ends[enough]


def _stretches(w: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """All maximal stretches of period q by comparing every word with the one q words on."""
    same = np.concatenate(([False], w[:-q] == w[q:], [False])).astype(np.int8)
    edge = np.diff(same)
    return [(a, b - a + q, q) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b - a + q >= max(LEAST, TIMES * q)]


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of stretches (start, length, q) with equal start and length, that of the smallest period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[fresh]


def lag_scan(w: np.ndarray) -> np.ndarray:
    """Rows (start, length, period): the runs of one segment of word numbers."""
    m = len(w)
    prefix = prefix_hashes(mixed(w.astype(np.uint64)))
    same = lambda a, b, lag: span_hashes(prefix, a, b) == span_hashes(prefix, a + lag, b + lag)
    lags = np.arange(1, m // TIMES + 1)
    tries = np.cumsum((m - 1) // lags - 2)
    out, begun = [np.zeros((0, 3), np.int64)], 0
    while begun < len(lags):
        end = max(begun + 1, int(np.searchsorted(tries, (tries[begun - 1] if begun else 0) + AT_ONCE, "right")))
        some = lags[begun:end]
        many = (m - 1) // some - 2
        q = np.repeat(some, many)
        at = ranges(np.zeros(len(some), np.int64), many) * q
        hit = w[at] == w[at + q]
        q, at = q[hit], at[hit]
        hit = (w[at + q] == w[at + 2 * q]) & (w[at + 2 * q] == w[at + 3 * q])
        q, at = q[hit], at[hit]
        hit = same(at, at + 2 * q, q)
        q, at = q[hit], at[hit]
        begun = end
        if not len(q):
            continue
        fresh = np.concatenate(([True], (q[1:] != q[:-1]) | (at[1:] != at[:-1] + q[1:])))
        first = np.flatnonzero(fresh)
        low, high, q = at[first], at[np.concatenate((first[1:] - 1, [len(at) - 1]))] + 2 * q[first], q[first]

        def reach(most: np.ndarray, ok: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
            least = np.zeros_like(most)
            while (least < most).any():
                middle = (least + most + 1) // 2
                yes = ok(middle)
                least, most = np.where(yes, middle, least), np.where(yes, most, np.maximum(middle - 1, least))
            return least

        start = low - reach(np.minimum(q - 1, low), lambda t: same(low - t, low, q))  # noqa: B023
        stop = high + q + reach(np.minimum(q, m - q - high), lambda t: same(high, high + t, q))  # noqa: B023
        long = stop - start >= np.maximum(LEAST, TIMES * q)
        out.append(np.stack((start, stop - start, q), axis=1)[long])
    found = _smallest(np.concatenate(out))
    if all(np.array_equal(w[s : s + n - q], w[s + q : s + n]) for s, n, q in found.tolist()):
        return found
    # two different blocks had one hash
    return _smallest(np.array([x for q in lags.tolist() for x in _stretches(w, q)], np.int64).reshape(-1, 3))


def runs_of(ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs; starts count over all words of all rows."""
    starts, ends = surviving(ids, rows)
    found = [np.zeros((0, 3), np.int64)]
    for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
        some = lag_scan(ids[a:b])
        some[:, 0] += a
        found.append(some)
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rebuild: Rebuild | None = None) -> DataFrame:
    """Per row: doc_id, runs (by start and period) and kept, the text without each run's words after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            starts, ends, rows = words(data, offsets)
            count = np.bincount(rows, minlength=len(part))
            at = np.concatenate(([0], np.cumsum(count)))
            ids = word_ids(data, starts, ends)
            if rebuild:
                source = np.arange(len(ids))
                for i, (doc_id, n) in enumerate(zip(part.column(0).to_pylist(), count.tolist(), strict=True)):
                    if cut := rebuild(doc_id, n):
                        a, p = cut
                        source[at[i] + a : at[i + 1]] = at[i] + a + np.arange(n - a) % p
                ids, starts, ends = ids[source], starts[source], ends[source]
            runs = runs_of(ids, rows)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
            keep = np.cumsum(edges)[:-1] == 0
            kept = row_texts(*joined_words(data, starts[keep], ends[keep]), np.concatenate(([0], np.cumsum(keep)))[at])
            row = np.searchsorted(at, runs[:, 0], "right") - 1
            of = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part)))))
            fields = [pa.array(x) for x in (runs[:, 0] - at[row], runs[:, 1], runs[:, 2])]
            listed = pa.ListArray.from_arrays(pa.array(of, pa.int32()), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([part.column(0), listed, pa.array([x.decode() for x in kept])], ["doc_id", "runs", "kept"])

    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string")


def run_digests(collapsed: DataFrame) -> DataFrame:
    """Per document: n_runs, its longest run (ties: least start, then period) and digests of its runs and of what is kept."""
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = collapsed.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("x"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", F.col("x.start").alias("start"), (-F.col("x.n")).alias("length"), F.col("x.period").alias("period"), F.expr("(1000 * -x.n) div x.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
