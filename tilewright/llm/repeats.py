"""Exact detection of repeated windows of L symbols (words or bytes) over a corpus, without shipping all windows.

1. *Anchors.*  In every window the least of its k-gram hashes marks one k-gram, the window's anchor, so that
   equal windows have equal anchors at equal offsets.  Neighbouring windows mostly share an anchor, which
   leaves about 2 / (L - k + 2) anchors a symbol.
2. *Repeated anchors.*  Equal texts are one string of the collection, the one with the least doc_id; the windows of the
   others are decided by that alone.  Aggregating anchors by hash (partially before the shuffle) tells which occur in
   two different texts or twice in one; a window of any other anchor is not repeated.  This goes back to the
   documents by doc_id.
3. *Groups by prefix, of variable length.*  A repeated anchor's context (all windows that have this anchor) is sent to
   the group of its k-gram.  Where the contexts of a k-gram would not fit ``GROUP_BYTES``, the prefix is extended: the
   windows are cut by the offset of their anchor into 2, 4 or all L - k + 1 ranges, and what all windows of a range
   have in common, up to the whole window, is the prefix.  So no group grows beyond some 16 times ``GROUP_BYTES``.
   Equal contexts of a task are merged before they are sent: the first stands for all, the others are decided at once.
   So no group grows with a passage that everyone quotes, nor with copies of a document.
4. In a group, in every case, the operator's own structure (see ``substrings`` and ``columns``) finds the windows that
   occur earlier; a bounded list of window runs goes back to each document.  Groups come sorted and are worked on
   some ``GROUP_BYTES`` at a time.

The text is shuffled once, by doc_id, and that exchange serves steps 3 and 4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, powers, prefix_hashes, ranges, span_hashes, steps, word_hashes, words, written

#: Bytes of contexts that a task works on at once; the prefix of a group is extended until it fits.
GROUP_BYTES = 2 << 20
#: Marks a text hash among a document's anchors: the whole text is a copy of an earlier document's.
COPY = -1
#: Contexts that a task remembers for merging equal ones; when it is full, merging begins anew.
SEEN = 1 << 20
LOW32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Rule:
    """What a symbol is, the window and k-gram lengths, and which earlier windows count.

    ``counts``: "earlier" for any earlier start, "smaller" for a start in a document with a smaller doc_id,
    "shared" for a start in a document of another version.
    ``nodes(contents, left, group, depth, k)`` gives node numbers of the left and right contexts by depth, with
    prefixes of k symbols.
    """

    unit: str
    length: int
    k: int
    counts: str
    nodes: Callable

    def fit(self) -> int:
        """Contexts of a k-gram that fit GROUP_BYTES."""
        return GROUP_BYTES // ((2 * self.length - self.k) * (1 if self.unit == "bytes" else 8))

    def parts(self, level: int) -> int:
        """Ranges of anchor offsets into which windows are cut."""
        return (1, 2, 4, self.length - self.k + 1)[level]


def symbols(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol values, row offsets into them, and the byte span of each symbol."""
    if unit == "bytes":
        at = np.arange(len(data))
        return data, offsets, at, at + 1
    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1, np.int64)
    return word_hashes(data, starts, ends), np.concatenate(([0], np.cumsum(count))), starts, ends


def anchors(prefix: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchors in order: position, k-gram hash, row, and the first and last window that have it."""
    n = len(prefix) - 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(at)
    rows = np.flatnonzero(sizes >= length)
    if not len(rows):
        return none, none.astype(np.uint64), none, none, none
    grams = mixed((prefix[k:] - prefix[:-k]) * powers(n + 1, inverse=True)[: n - k + 1])
    low = (grams & ~LOW32) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - k + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = ranges(at[rows], sizes[rows] - length + 1)
    place = (low[starts] & LOW32).astype(np.int64)
    row = np.repeat(rows, sizes[rows] - length + 1)
    first = np.ones(len(place), bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(place)) - 1
    return place[begin], grams[place[begin]], row[begin], starts[begin], starts[end]


def anchor_counts(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows (g, v, m, c): anchors of each text, how often it has them and how many different contexts they have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            values, at, _, _ = symbols(rule.unit, data, offsets)
            prefix = prefix_hashes(values)
            place, gram, row, s0, s1 = anchors(prefix, at, rule.length, rule.k)
            gram = mixed(gram ^ np.asarray(part.column(2)).view(np.uint64)[row])
            context = mixed(span_hashes(prefix, s0, s1 + rule.length) ^ (place - s0).astype(np.uint64))
            order = np.argsort(mixed(gram ^ mixed(row.astype(np.uint64))), kind="stable")
            gram, row, context = gram[order], row[order], context[order]
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(fresh)
            new = fresh.copy()
            new[1:] |= context[1:] != context[:-1]
            c = np.add.reduceat(new.astype(np.int64), begin) if len(begin) else begin
            versions = np.asarray(part.column(1))[row[begin]]
            yield pa.RecordBatch.from_arrays([pa.array(gram[begin].view(np.int64)), pa.array(versions), pa.array(np.diff(np.append(begin, len(gram)))), pa.array(c)], ["g", "v", "m", "c"])

    return docs.select("doc_id", "v", "salt", "text").mapInArrow(run, "g bigint, v bigint, m bigint, c bigint")


def anchor_rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """Rows (g, doc_id): the anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            values, at, _, _ = symbols(rule.unit, data, offsets)
            _, gram, row, _, _ = anchors(prefix_hashes(values), at, rule.length, rule.k)
            ids, salt = np.asarray(part.column(0)), np.asarray(part.column(1)).view(np.uint64)
            gram = mixed(gram ^ salt[row])
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[row])], ["g", "doc_id"])

    return docs.select("doc_id", "salt", "text").mapInArrow(run, "g bigint, doc_id bigint")


OUT_SCHEMA = "key bigint, doc_id bigint, v bigint, start int, n int, left int, k int, content binary, more binary"
OUT = [x.split()[0] for x in OUT_SCHEMA.split(", ")]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the given spans of bytes."""
    sizes = ends - starts
    flat = data[ranges(starts, sizes)]
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def runs_of(doc: np.ndarray, v: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring starts: doc, v, first start, how many."""
    order = np.lexsort((start, v, doc))
    doc, v, start = doc[order], v[order], start[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(first)
    return doc[begin], v[begin], start[begin], np.diff(np.append(begin, len(doc)))


def judged(key: np.ndarray, doc: np.ndarray, v: np.ndarray, counts: str) -> np.ndarray:
    """Which windows have an equal one that counts; rows are in order of key, document and place."""
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    if counts == "earlier" or not len(key):
        return ~fresh
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(key)))
    if counts == "smaller":
        return doc != np.repeat(doc[begin], size)
    return np.repeat(np.logical_or.reduceat(v != np.repeat(v[begin], size), begin), size)


@dataclass
class Pieces:
    """Contexts, or ranges of their windows: prefix key, content hash, owner, first window, windows, place and length of the prefix."""

    key: np.ndarray
    content: np.ndarray
    doc: np.ndarray
    v: np.ndarray
    start: np.ndarray
    n: np.ndarray
    left: np.ndarray
    k: np.ndarray
    row: np.ndarray

    def take(self, which: np.ndarray) -> Pieces:
        return Pieces(*(x[which] for x in vars(self).values()))


def pieces(rule: Rule, prefix: np.ndarray, place: np.ndarray, row: np.ndarray, s0: np.ndarray, s1: np.ndarray, level: int, salt: np.ndarray) -> list[np.ndarray]:
    """Ranges of the anchors' windows at a level: key, content hash, row, first window (in the batch), windows, left, k."""
    depth, parts = rule.length - rule.k, rule.parts(level)
    if parts > depth:
        which, first = np.repeat(np.arange(len(place)), s1 - s0 + 1), ranges(s0, s1 - s0 + 1)
        last, begin, k = first, first, np.full(len(first), rule.length)
    else:
        edge = np.arange(parts + 1) * (depth + 1) // parts
        which, j = np.repeat(np.arange(len(place)), parts), np.tile(np.arange(parts), len(place))
        a, b = edge[j], edge[j + 1]
        first, last = np.maximum(s0[which], place[which] - b + 1), np.minimum(s1[which], place[which] - a)
        good = first <= last
        which, first, last, begin, k = which[good], first[good], last[good], (place[which] - a)[good], (rule.length - (b - 1 - a))[good]
    row = row[which]
    key = mixed(span_hashes(prefix, begin, begin + k) ^ salt[row] ^ mixed(k.astype(np.uint64)))
    content = mixed(span_hashes(prefix, first, last + rule.length) ^ key ^ (begin - first).astype(np.uint64))
    return [key, content, row, first, last - first + 1, begin - first, k]


class Merger:
    """The first document of each context that a task has met, in order of documents."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.content, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, found: Pieces) -> tuple[Pieces, np.ndarray, Pieces]:
        """Pieces to tell, the number of places (in order) that each stands for, and pieces that are decided already.

        A told piece stands for all places of its context in its document; its further places follow it.
        """
        order = np.lexsort((found.start, found.v, found.doc, found.content))
        p = found.take(order)
        same = np.zeros(len(order), bool)
        same[1:] = (p.content[1:] == p.content[:-1]) & (p.doc[1:] == p.doc[:-1]) & (p.v[1:] == p.v[:-1])
        repeat = same.copy()
        repeat[1:] &= p.start[1:] == p.start[:-1]  # the same row twice
        p, same = p.take(~repeat), same[~repeat]
        if self.rule.counts == "shared":
            decided = np.zeros(len(same), bool)
        else:
            fresh = np.ones(len(same), bool)
            fresh[1:] = p.content[1:] != p.content[:-1]
            begin = np.flatnonzero(fresh)
            first = p.doc[begin]
            at = np.minimum(np.searchsorted(self.content, p.content[begin]), max(0, len(self.content) - 1))
            known = self.content[at] == p.content[begin] if len(self.content) else np.zeros(len(begin), bool)
            size = np.diff(np.append(begin, len(same)))
            old = np.repeat(known, size)
            head = np.repeat(np.where(known, self.doc[at] if len(self.doc) else first, first), size)
            decided = (p.doc != head) if self.rule.counts == "smaller" else old | ~fresh
            if self.rule.counts == "earlier":
                decided[begin] = known
            new = begin[~known]
            if len(self.content) + len(new) > SEEN:
                self.content, self.doc = p.content[new], p.doc[new]
            else:
                content, doc = np.concatenate((self.content, p.content[new])), np.concatenate((self.doc, p.doc[new]))
                order = np.argsort(content, kind="stable")
                self.content, self.doc = content[order], doc[order]
        told = p.take(~decided)
        heads = np.flatnonzero(~same[~decided])
        return told, heads, p.take(decided)


def contexts(docs: DataFrame, rule: Rule) -> DataFrame:
    """Pieces of repeated anchors' contexts with their prefix (k > 0), and windows already decided (k = 0)."""

    def rows(p: Pieces, key: np.ndarray, content: pa.Array | None, more: pa.Array | None) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.binary())
        small = [pa.array(x.astype(np.int32)) for x in (p.start, p.n, p.left, p.k)]
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(p.doc), pa.array(p.v), *small, none if content is None else content, none if more is None else more], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = Merger(rule)
        for part, data, offsets in steps(batches):
            found, salt = part.column(4), np.asarray(part.column(2)).view(np.uint64)
            counts = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
            if not counts.sum():
                continue
            flat = found.flatten()
            owner = np.repeat(np.arange(len(part)), counts)
            ids, versions = np.asarray(part.column(0).fill_null(0)), np.asarray(part.column(1))
            values, at, begin, end = symbols(rule.unit, data, offsets)
            anchor, level = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            copies = np.unique(owner[(level == COPY) & (anchor == versions[owner])])
            size = np.diff(at)[copies]
            copies, size = copies[size >= rule.length], size[size >= rule.length]
            if len(copies):
                zero = np.zeros(len(copies), np.int64)
                whole = Pieces(zero, zero, ids[copies], versions[copies], zero, size - rule.length + 1, zero, zero, copies)
                yield rows(whole, mixed((whole.doc ^ whole.v).view(np.uint64)), None, None)
            mine = (level != COPY) & ~np.isin(owner, copies)
            owner, anchor, level = owner[mine], anchor[mine], level[mine]
            if not len(owner):
                continue
            wanted = mixed(anchor.view(np.uint64) ^ mixed(owner.astype(np.uint64)))
            order = np.argsort(wanted)
            wanted, level = wanted[order], level[order]
            prefix = prefix_hashes(values)
            place, gram, row, s0, s1 = anchors(prefix, at, rule.length, rule.k)
            here = mixed(mixed(gram ^ salt[row]) ^ mixed(row.astype(np.uint64)))
            hit = np.minimum(np.searchsorted(wanted, here), len(wanted) - 1)
            good = wanted[hit] == here
            place, row, s0, s1, level = (x[good] for x in (place, row, s0, s1, level[hit]))
            made = [pieces(rule, prefix, *(x[level == e] for x in (place, row, s0, s1)), e, salt) for e in np.unique(level).tolist()]
            if not made:
                continue
            key, content, row, first, n, left, k = (np.concatenate(x) for x in zip(*made, strict=True))
            told, heads, decided = merger(Pieces(key, content, ids[row], versions[row], first - at[row], n, left, k, row))
            if len(heads):
                many = np.diff(np.append(heads, len(told.key)))
                head = told.take(heads)
                first = head.start + at[head.row]
                open_ = head.k < rule.length
                spans = slices(data, np.where(open_, begin[first], 0), np.where(open_, end[first + head.n - 1 + rule.length - 1], 0))
                others = told.start.astype(np.int32)
                more = slices(others.view(np.uint8), 4 * (heads + 1), 4 * (heads + many))
                yield rows(head, head.key, spans, more)
            if len(decided.key):
                doc, v, start, n = decided.doc, decided.v, decided.start, decided.n
                decided.k = np.zeros(len(doc), np.int64)
                yield rows(decided, mixed((doc ^ v).astype(np.uint64) + start.astype(np.uint64)), None, None)

    return docs.select("doc_id", "v", "salt", "text", "found").mapInArrow(run, OUT_SCHEMA)


def _found(rule: Rule, table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (doc, v, start, n) of windows that have an equal one that counts, in whole groups."""
    columns = {n: np.asarray(table[n]) for n in OUT[:7]}
    content, more = table["content"].combine_chunks(), table["more"].combine_chunks()
    size = np.asarray(pc.binary_length(content))
    further = np.asarray(pc.binary_length(more)) // 4
    for k in np.unique(columns["k"]).tolist():
        mine = np.flatnonzero(columns["k"] == k)
        for some in whole_groups(columns["key"][mine], size[mine] + 64, further[mine]):
            some = mine[some]
            key, doc, v, start, n, left = (columns[x][some] for x in ("key", "doc_id", "v", "start", "n", "left"))
            order = np.lexsort((start + left, v, doc, key))
            key, doc, v, start, n, left = (x[order] for x in (key, doc, v, start, n, left))
            row = some[order]
            group = np.unique(key, return_inverse=True)[1]
            covered = counted(rule, content.take(pa.array(row)), left.astype(np.int64), n.astype(np.int64), group, doc, v, k)
            where, offset = np.nonzero(covered)
            if not len(where):
                continue
            first = (start[where] + left[where] - offset).astype(np.int64)
            yield runs_of(doc[where], v[where], first)
            # the other places of the same contexts
            again = np.flatnonzero(further[row[where]])
            if len(again):
                taken = more.take(pa.array(row[where[again]]))
                moved = np.frombuffer(b"".join(x.as_py() for x in taken), np.int32).astype(np.int64)
                which = np.repeat(where[again], further[row[where[again]]])
                yield runs_of(doc[which], v[which], moved + np.repeat(first[again] - start[where[again]], further[row[where[again]]]))


def whole_groups(key: np.ndarray, size: np.ndarray, further: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of whole groups of two or more places, some GROUP_BYTES of content at a time (or one larger group)."""
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order[1:]] != key[order[:-1]]
    begin = np.append(np.flatnonzero(first), len(key))
    total = np.concatenate(([0], np.cumsum(size[order])))[begin]
    many = np.repeat(np.diff(begin), np.diff(begin)) > 1
    at = 0
    while at < len(begin) - 1:
        end = max(at + 1, int(np.searchsorted(total, total[at] + GROUP_BYTES, "right")) - 1)
        rows = order[begin[at] : begin[end]][many[begin[at] : begin[end]]]
        if len(rows):
            yield rows
        at = end


def counted(rule: Rule, content: pa.Array, left: np.ndarray, n: np.ndarray, group: np.ndarray, doc: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """covered[i, l]: context i's window with l symbols before the prefix of k symbols has an equal one that counts.

    Contexts come in order of group, document and place.
    """
    depth = rule.length - k
    before, after = rule.nodes(content, left, group, depth, k) if depth else ([group], [group])
    covered = np.zeros((len(left), depth + 1), bool)
    for l in range(depth + 1):  # noqa: E741
        has = np.flatnonzero((l <= left) & (l >= left - n + 1))
        if len(has) < 2:
            continue
        a, b = before[l][has], after[depth - l][has]
        pair = a.astype(np.int64) * (int(b.max()) + 1) + b
        order = np.argsort(pair, kind="stable")
        covered[has[order], l] = judged(pair[order], doc[has[order]], v[has[order]], rule.counts)
    return covered


def repeated_runs(contexts_: DataFrame, rule: Rule) -> DataFrame:
    """Rows (doc_id, v, start, n): the windows start .. start + n - 1 have an equal one that counts."""

    def out(runs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        doc, v, start, n = runs
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(v), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["doc_id", "v", "start", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            k = np.asarray(batch.column(6))
            if not k.all():
                done = batch.filter(pa.array(k == 0))
                yield out(tuple(np.asarray(done.column(i)) for i in (1, 2, 3, 4)))
                batch = batch.filter(pa.array(k > 0))
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size > 2 * GROUP_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                keys = np.asarray(table["key"])
                cut = int(np.searchsorted(keys, keys[-1]))  # rows are sorted by key; the last group may go on
                if cut:
                    for runs in _found(rule, table.slice(0, cut)):
                        yield out(runs)
                held, size = table.slice(cut).to_batches(), 0
        if held:
            for runs in _found(rule, pa.Table.from_batches(held)):
                yield out(runs)

    return contexts_.repartition("key").sortWithinPartitions("key").mapInArrow(run, "doc_id bigint, v bigint, start int, n int")


def with_runs(docs: DataFrame, rule: Rule, id_col: str, text_col: str, fit: int | None = None, salt: str | None = None, version: str | None = None, keep: list[str] = (), only: str = "true") -> DataFrame:
    """Every document as (doc_id, v, salt, text, .., found): ``found`` lists its runs of windows that have an equal one that counts.

    Windows only count for each other if their documents have the same ``salt``.  ``version`` names a number that
    tells documents of one id apart, else it is the hash of the text.  ``keep`` names further columns,
    ``only`` says which documents are returned (all are searched).  ``fit`` replaces the rule's number of contexts in a group.
    """
    fit = fit or rule.fit()
    text = F.col(text_col).cast("string")
    columns = [F.col(id_col).cast("bigint").alias("doc_id"), (F.col(version) if version else F.xxhash64(text)).alias("v"), (F.col(salt) if salt else F.lit(0)).cast("bigint").alias("salt"), text.alias("text")]
    marked = docs.select(*columns)
    back = docs.where(only).select(*columns, *keep) if keep or only != "true" else marked
    known = marked.where("doc_id is not null")
    often = anchor_counts(known, rule).groupBy("g").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.max("m").alias("m"), F.sum("c").alias("c")).where("least < most or m > 1")
    level = F.when(F.col("c") <= fit, 0).when(F.col("c") <= 4 * fit, 1).when(F.col("c") <= 16 * fit, 2).otherwise(3)
    # written, so that both sides of the next join are plain shuffles, whose large partitions Spark can split
    often = written(often.select("g", level.alias("level")), "often")
    again = anchor_rows(known, rule).join(often, "g").select("doc_id", F.struct("g", "level").alias("a"))
    whole = known.where(F.lit(rule.counts != "shared")).select("doc_id", "v")
    first = whole.groupBy("v").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = whole.join(written(first, "first"), "v").where("doc_id > first").select("doc_id", F.struct(F.col("v").alias("g"), F.lit(COPY).alias("level")).alias("a"))
    of_doc = again.unionByName(copies).groupBy("doc_id").agg(F.collect_list("a").alias("found"))
    # in an order of their own, so that a task that runs again merges and tells the same contexts
    # (a left join, as an inner one filters the ids and so shuffles the texts once more for the last join)
    held = marked.join(of_doc.hint("shuffle_hash"), "doc_id", "left").sortWithinPartitions("doc_id", "v", "salt")
    runs = repeated_runs(contexts(held, rule), rule).groupBy("doc_id").agg(F.collect_list(F.struct("v", "start", "n")).alias("found"))
    return back.join(runs.hint("shuffle_hash"), "doc_id", "left")


def removed_symbols(part: pa.RecordBatch, at: np.ndarray, length: int) -> np.ndarray:
    """Mask of the symbols that the runs of a batch from :func:`with_runs` cover."""
    found = part.column(part.schema.get_field_index("found"))
    edges = np.zeros(int(at[-1]) + 1, np.int64)
    counts = np.asarray(found.value_lengths().fill_null(0)).astype(np.int64)
    if counts.sum():
        flat = found.flatten()
        row = np.repeat(np.arange(len(part)), counts)
        v, start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
        mine = v == np.asarray(part.column(1))[row]
        row, start, n = row[mine], start[mine], n[mine]
        np.add.at(edges, at[row] + start, 1)
        np.add.at(edges, at[row] + start + n - 1 + length, -1)
    return np.cumsum(edges)[:-1] > 0
