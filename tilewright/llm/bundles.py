"""Windows of L words that texts of different versions share, found with little on disk.

The steps are those of :mod:`repeats` (anchors, repeated anchors, groups by prefix of variable length, the operator's own
structure in each group), for the rule "shared" alone.  What differs is how they travel:

1. *Bundles.*  Texts, in order of salt, version and row within each partition, are put into bundles of up to ``STEP_BYTES``,
   compressed.  They are shuffled once, by the number of the bundle; all steps read that exchange, and nothing else is written.
2. *Anchors.*  A bundle tells each of its anchors once, by 40 bits of its hash, with the number of its contexts there and whether several
   versions have it.  An anchor goes back to the bundles if several versions of one bundle or several bundles have it.  Two
   hashes that agree in 40 bits only, or versions that lie in several bundles, cost a context more and change no result.
3. *Contexts.*  A task sends each context once for each version, with all its places; of a third version on, its places are
   known to be shared at once, as the other two are sent.  So no group grows with a passage that every text has.
4. *Groups.*  They lie in buckets by the first bits of the prefix; a bucket is one Arrow group, worked on some ``GROUP_BYTES`` at a time.

Rows of numbers travel as planes of bytes, compressed by zstd.  Buckets are as many as Spark's shuffle partitions, ``BUCKETS`` at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, prefix_hashes, ranges, span_hashes, steps, text_bytes
from .repeats import GROUP_BYTES, Rule, anchors, counted, pieces, runs_of, slices, symbols, whole_groups

#: Bits of an anchor's hash that travel, and bits of a text's place in its bundle.
BITS, PLACE = 40, 16
BUCKETS = 512
#: Bytes of contexts that a task gathers before it merges and sends them.
HELD_BYTES = 32 << 20
TEXT_LEVEL = 6


def squeezed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers of one length, as compressed planes of bytes."""
    planes = [np.ascontiguousarray(c.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return len(columns[0]).to_bytes(4, "little") + pa.compress(b"".join(planes), "zstd", asbytes=True)


def unsqueezed(data: bytes, many: int) -> list[np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n * many, "zstd"), np.uint8) if n else np.zeros(0, np.uint8)
    return [np.ascontiguousarray(c.T).view(np.int64).ravel() for c in planes.reshape(many, 8, n)]


def packed(batch: pa.RecordBatch) -> bytes:
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=TEXT_LEVEL))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=options) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def bundled(docs: DataFrame) -> DataFrame:
    """Rows (bundle, data): the rows of ``docs`` in order, in compressed bundles that a task that runs again makes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << (62 - PLACE - 22)
        for part, *_ in steps(batches):
            for at in range(0, len(part), 1 << PLACE):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed(part.slice(at, 1 << PLACE))], pa.binary())], ["bundle", "data"])
                number += 1

    return docs.mapInArrow(run, "bundle bigint, data binary")


class Texts:
    """The texts of a bundle with their anchors: place, 64-bit hash, row, first and last window."""

    def __init__(self, rule: Rule, data: bytes):
        part = unpacked(data)
        self.version, salt = (np.asarray(part.column(part.schema.get_field_index(n))) for n in ("v", "salt"))
        self.salt = salt.view(np.uint64)
        self.data, offsets = text_bytes(part.column(part.schema.get_field_index("text")))
        values, self.at, self.begin, self.end = symbols(rule.unit, self.data, offsets)
        self.prefix = prefix_hashes(values)
        self.place, gram, self.row, self.s0, self.s1 = anchors(self.prefix, self.at, rule.length, rule.k)
        self.gram = (mixed(gram ^ self.salt[self.row]) >> np.uint64(64 - BITS)).astype(np.int64)


def starts_of(*columns: np.ndarray) -> np.ndarray:
    """Where rows begin that differ from the one before."""
    first = np.zeros(len(columns[0]), bool)
    first[:1] = True
    for c in columns:
        first[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(first)


def bucket_edges(gram: np.ndarray, buckets: int) -> list[int]:
    """Where each bucket begins among hashes in order; the last edge is the end."""
    return np.searchsorted(gram, -(-(np.arange(buckets + 1) << BITS) // buckets)).tolist()


def told_anchors(bundles: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """Rows (bucket, bundle, data): hashes of anchors (differences), and twice their contexts in the bundle, plus one if several versions have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = Texts(rule, data)
                context = span_hashes(t.prefix, t.s0, t.s1 + rule.length) ^ (t.place - t.s0).astype(np.uint64)
                version = t.version[t.row]
                order = np.lexsort((context, version, t.gram))
                gram, version, context = t.gram[order], version[order], context[order]
                begin = starts_of(gram, version, context)
                gram, version = gram[begin], version[begin]
                begin = starts_of(gram)
                count = np.diff(np.append(begin, len(gram)))
                several = version[begin] != version[begin + count - 1]
                gram, about = gram[begin], 2 * count + several
                edges = bucket_edges(gram, buckets)
                have = [b for b in range(buckets) if edges[b] < edges[b + 1]]
                blobs = [squeezed(np.diff(gram[edges[b] : edges[b + 1]], prepend=0), about[edges[b] : edges[b + 1]]) for b in have]
                yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array([number] * len(have), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "bundle", "data"])

    return bundles.mapInArrow(run, "bucket int, bundle bigint, data binary")


def repeated_anchors(told: DataFrame, fit: int) -> DataFrame:
    """Rows (bundle, data): the anchors that others may share, in order (differences), with the level of their prefix."""

    def run(table: pa.Table) -> pa.Table:
        bundle, blobs = np.asarray(table["bundle"]), [unsqueezed(x, 2) for x in table["data"].to_pylist()]
        gram = np.concatenate([np.cumsum(x[0]) for x in blobs])
        about = np.concatenate([x[1] for x in blobs])
        bundle = np.repeat(bundle, [len(x[0]) for x in blobs])
        order = np.argsort(gram, kind="stable")
        gram, about, bundle = gram[order], about[order], bundle[order]
        begin = starts_of(gram)
        size = np.diff(np.append(begin, len(gram)))
        shared = np.repeat((size > 1) | (about[begin] & 1 > 0), size)
        level = np.repeat(np.searchsorted([fit, 4 * fit, 16 * fit], np.add.reduceat(about >> 1, begin)), size)
        gram, level, bundle = gram[shared], level[shared], bundle[shared]
        order = np.argsort(bundle, kind="stable")
        gram, level, bundle = gram[order], level[order], bundle[order]
        begin = starts_of(bundle)
        cuts = [*begin.tolist(), len(bundle)]
        blobs = [squeezed(np.diff(gram[a:b], prepend=0), level[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table([pa.array(bundle[begin]), pa.array(blobs, pa.binary())], ["bundle", "data"])

    return told.groupBy("bucket").applyInArrow(run, "bundle bigint, data binary")


NUMBERS = ("key", "v", "n", "left", "k")
SENT = "bucket int, bundle bigint, data binary, places binary, content binary"


def sent_contexts(held: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    """Rows of contexts with all their places and their text (no bundle), and of runs of windows known to be shared (of a bundle)."""

    def rows(bucket: list, bundle: list, *blobs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(bundle, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], [x.split()[0] for x in SENT.split(", ")])

    def merged(found: list[dict], texts: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        p = {n: np.concatenate([f[n] for f in found]) for n in found[0]}
        order = np.lexsort((p["start"], p["doc"], p["v"], p["content"]))
        p = {n: c[order] for n, c in p.items()}
        head = starts_of(p["content"], p["v"])  # one row is sent for each context of a version
        many = np.diff(np.append(head, len(order)))
        new = starts_of(p["content"][head])
        nth = np.arange(len(head)) - np.repeat(new, np.diff(np.append(new, len(head))))
        known, sent, many = np.repeat(nth >= 2, many), head[nth < 2], many[nth < 2]
        doc, start = p["doc"][~known], p["start"][~known]
        at = np.cumsum(many) - many
        by_key = np.argsort(p["key"][sent].view(np.uint64), kind="stable")
        sent, many, at = sent[by_key], many[by_key], at[by_key]
        content = pa.concat_arrays(texts).take(pa.array(order[sent]))
        data, offsets = text_bytes(content)
        edges = bucket_edges((p["key"][sent].view(np.uint64) >> np.uint64(64 - BITS)).astype(np.int64), buckets)
        have = [(b, slice(edges[b], edges[b + 1])) for b in range(buckets) if edges[b] < edges[b + 1]]
        numbers = [squeezed(*(p[n][sent[x]] for n in NUMBERS), many[x], np.diff(offsets[x.start : x.stop + 1])) for _, x in have]
        places = [squeezed(doc[y], start[y]) for y in (ranges(at[x], many[x]) for _, x in have)]
        contents = [pa.compress(data[offsets[x.start] : offsets[x.stop]].tobytes(), "zstd", asbytes=True) for _, x in have]
        yield rows([b for b, _ in have], [None] * len(have), numbers, places, contents)
        if known.any():
            bundles, blobs = by_bundle(p["doc"][known], p["start"][known], p["n"][known])
            none = [None] * len(blobs)
            yield rows([b % buckets for b in bundles], bundles, blobs, none, none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, texts, size = [], [], 0
        for batch in batches:
            for number, data, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not wanted:
                    continue
                told = [unsqueezed(x, 2) for x in wanted]
                gram, level = np.concatenate([np.cumsum(x[0]) for x in told]), np.concatenate([x[1] for x in told])
                order = np.argsort(gram)
                gram, level = gram[order], level[order]
                t = Texts(rule, data)
                hit = np.minimum(np.searchsorted(gram, t.gram), len(gram) - 1)
                good = gram[hit] == t.gram
                place, row, s0, s1, level = t.place[good], t.row[good], t.s0[good], t.s1[good], level[hit[good]]
                made = [pieces(rule, t.prefix, *(x[level == e] for x in (place, row, s0, s1)), e, t.salt) for e in np.unique(level).tolist()]
                if not made:
                    continue
                key, content, row, first, n, left, k = (np.concatenate(x) for x in zip(*made, strict=True))
                found.append({"key": key.view(np.int64), "content": content, "doc": (number << PLACE) + row, "v": t.version[row], "start": first - t.at[row], "n": n, "left": left, "k": k})
                open_ = k < rule.length
                texts.append(slices(t.data, np.where(open_, t.begin[first], 0), np.where(open_, t.end[first + n + rule.length - 2], 0)))
                size += texts[-1].nbytes
                if size > HELD_BYTES:
                    yield from merged(found, texts)
                    found, texts, size = [], [], 0
        if found:
            yield from merged(found, texts)

    return held.select("bundle", "data", "wanted").mapInArrow(run, SENT)


def by_bundle(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Runs of windows by bundle: its number, and place in it, first window and windows."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    bundle = doc >> PLACE
    begin = starts_of(bundle)
    cuts = [*begin.tolist(), len(doc)]
    return bundle[begin].tolist(), [squeezed(doc[a:b] & ((1 << PLACE) - 1), start[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def shared_windows(rule: Rule, numbers: list[bytes], places: list[bytes], contents: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs (doc, start, n) of windows that texts of other versions have, in the groups of a bucket."""
    numbers = [unsqueezed(x, len(NUMBERS) + 2) for x in numbers]
    data = b"".join(pa.decompress(x, int(of[-1].sum()), "zstd", asbytes=True) for x, of in zip(contents, numbers, strict=True))
    *columns, many, size = (np.concatenate(x) for x in zip(*numbers, strict=True))
    columns = dict(zip(NUMBERS, columns, strict=True))
    end = np.cumsum(size)
    data = np.frombuffer(data, np.uint8)
    docs, starts = (np.concatenate(x) for x in zip(*(unsqueezed(x, 2) for x in places), strict=True))
    at = np.cumsum(many) - many
    for k in np.unique(columns["k"]).tolist():
        mine = np.flatnonzero(columns["k"] == k)
        for some in whole_groups(columns["key"][mine], size[mine] + 64, many[mine]):
            some = mine[some]
            some = some[np.argsort(columns["key"][some], kind="stable")]
            key, v, n, left = (columns[x][some] for x in ("key", "v", "n", "left"))
            group = np.unique(key, return_inverse=True)[1]
            where, offset = np.nonzero(counted(rule, slices(data, end[some] - size[some], end[some]), left, n, group, some, v, k))
            if not len(where):
                continue
            count = many[some[where]]
            places = ranges(at[some[where]], count)
            doc, first = docs[places], starts[places] + np.repeat(left[where] - offset, count)
            doc, _, start, n = runs_of(doc, np.zeros(len(doc), np.int64), first)
            yield doc, start, n


def shared_runs(contexts: DataFrame, rule: Rule) -> DataFrame:
    """Rows (bundle, data): runs of windows that are shared."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bundles, blobs = ([r[n] for r in rows if r["bundle"] is not None] for n in ("bundle", "data"))
        groups = [[r[n] for r in rows if r["bundle"] is None] for n in ("data", "places", "content")]
        runs = list(shared_windows(rule, *groups)) if groups[0] else []
        if runs:
            more = by_bundle(*(np.concatenate(x) for x in zip(*runs, strict=True)))
            bundles, blobs = bundles + more[0], blobs + more[1]
        return pa.table([pa.array(bundles, pa.int64()), pa.array(blobs, pa.binary())], ["bundle", "data"])

    return contexts.groupBy("bucket").applyInArrow(run, "bundle bigint, data binary")


def with_runs(docs: DataFrame, rule: Rule, fit: int | None = None) -> DataFrame:
    """Every row of ``docs`` with ``found``: the runs (v, start, n) of its windows that a text of another version with the same salt has.

    ``docs`` has row, v and salt (numbers, not null), text and further columns, in this order.  ``fit`` replaces the rule's number of contexts in a group.
    """
    assert rule.counts == "shared"
    buckets = max(1, min(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bundles = bundled(docs.sortWithinPartitions("salt", "v", "row")).repartition("bundle")
    again = repeated_anchors(told_anchors(bundles, rule, buckets), fit or rule.fit())
    wanted = again.groupBy("bundle").agg(F.collect_list("data").alias("wanted"))
    # left joins, as an inner one filters the numbers and so makes another exchange of the texts
    held = bundles.join(wanted.hint("shuffle_hash"), "bundle", "left")
    runs = shared_runs(sent_contexts(held, rule, buckets), rule).groupBy("bundle").agg(F.collect_list("data").alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = unpacked(data)
                row, start, n = (np.concatenate(x) for x in zip(*(unsqueezed(x, 3) for x in found), strict=True)) if found else [np.zeros(0, np.int64)] * 3
                order = np.lexsort((start, row))
                row, start, n = row[order], start[order].astype(np.int32), n[order].astype(np.int32)
                versions = np.asarray(part.column(part.schema.get_field_index("v")))[row]
                flat = pa.StructArray.from_arrays([pa.array(versions), pa.array(start), pa.array(n)], ["v", "start", "n"])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(part))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*part.schema.names, "found"])

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in docs.dtypes)
    return bundles.join(runs.hint("shuffle_hash"), "bundle", "left").select("data", "found").mapInArrow(run, f"{kinds}, found array<struct<v: bigint, start: int, n: int>>")
