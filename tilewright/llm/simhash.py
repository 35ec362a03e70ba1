"""Operator 11, SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint has bit j set if over half of a text's shingle hashes have.  Two fingerprints within D = 3 bits are found
so: the 64 bits are grouped into four blocks of 16 that hold correlated bits, and blocks into partitions.  If partition i
has a threshold t_i, -1 standing for "not asked", and the t_i + 1 add up to D + 1, then fingerprints within D bits are
within t_i bits in some partition i.  Each fingerprint gets thresholds of its own by dynamic programming on
estimated candidate counts: the counts of all values of each block (at most 4 x 2**16 numbers, whatever the input)
say how many fingerprints lie within t bits, so a fingerprint does not ask where its value is common.  It
is then looked up under all values within t_i bits of its own, and what is found is verified by the whole
fingerprint.  The number of partitions (four, three or two) is the one with the least estimated work over all fingerprints:
wider partitions cost more probes and return fewer candidates, which pays on large tables.

Equal fingerprints are one node.  A group (partition, value) with over PAIRS pairs is not compared in one task: its rows
go on to four groups each by the value of a quarter of the bits that are not yet equal (one quarter must be
equal), level by level; where 20 bits or fewer are left, every asking fingerprint looks up the at most
1,351 values near it.  So no pair is lost and no task compares all pairs of a large group.  Links leave a task as a spanning
forest, not as all pairs.

Defined cases: a null or empty text and one without words has fingerprint 0, which links like any other; with one or
two words the whole sequence is hashed; rows with a null id have a fingerprint and no component; rows of one id
with different texts are fingerprints of their own that share the id; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, joined_words, lowered, ranges, steps, words, written

BITS, BLOCK, D, SHINGLE, SEED = 64, 16, 3, 3, 42
#: What a probe costs in candidates; pairs that a task compares in one group, and at one time.
PROBE, PAIRS, AT_ONCE = 16.0, 1 << 22, 1 << 22
#: With so few bits left, values are looked up and not compared.
FEW = 20
#: Partitions as groups of blocks.
LAYOUTS = (((0,), (1,), (2,), (3,)), ((0, 1), (2,), (3,)), ((0, 1), (2, 3)))

ONE = np.uint64(1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and its fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            data = lowered(data)
            starts, ends, rows = words(data, offsets)
            count = np.bincount(rows, minlength=len(part))
            at = np.cumsum(count) - count
            many = np.where(count > 0, np.maximum(count - SHINGLE + 1, 1), 0)
            flat, into = joined_words(data, starts, ends)
            raw = flat.tobytes()
            row = np.repeat(np.arange(len(part)), many)
            first = ranges(at, many)
            last = np.minimum(first + SHINGLE, (at + count)[row])
            h = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], SEED) for a, b in zip(into[first].tolist(), (into[last] - 1).tolist(), strict=True)), np.uint64, len(first))
            ones = np.zeros((len(part), BITS), np.int64)
            for i in range(0, len(h), 1 << 16):
                bits = np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                some = row[i : i + (1 << 16)]
                cut = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
                ones[some[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
            prints = ((2 * ones > many[:, None]).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "doc_id bigint, fp bigint")


def taken(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The named bits of each fingerprint, packed; the first becomes the lowest."""
    out = np.zeros(len(prints), np.uint64)
    for j, b in enumerate(bits):
        out |= ((prints >> np.uint64(b)) & ONE) << np.uint64(j)
    return out.astype(np.int64)


def placed_back(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """The inverse of :func:`taken`; other bits are 0."""
    out = np.zeros(len(values), np.uint64)
    for j, b in enumerate(bits):
        out |= ((values.astype(np.uint64) >> np.uint64(j)) & ONE) << np.uint64(b)
    return out


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def near_masks(bits: list[int], most: int) -> list[np.ndarray]:
    """For each t of 0 .. most the masks of exactly t of the bits."""
    return [np.array([mask_of(c) for c in combinations(bits, t)], np.uint64) for t in range(most + 1)]


def uint64s(column: pa.Array) -> np.ndarray:
    return np.asarray(column).astype(np.int64, copy=False).view(np.uint64)


def correlated_blocks(prints: DataFrame) -> list[list[int]]:
    """Four blocks of 16 bits: each grows from a free bit by those that are most correlated with it; over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = np.ascontiguousarray(uint64s(batch.column(0)))
            for i in range(0, len(fp), 1 << 15):
                x = np.unpackbits(fp[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        a, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"])

    both = np.zeros((BITS, BITS))
    # at most 64 x 64 sums
    for r in prints.select("fp").mapInArrow(run, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        both[r.a, r.b] = r.n
    return grouped_bits(both, prints.count())


def grouped_bits(both: np.ndarray, n: int) -> list[list[int]]:
    """Blocks from how many of n fingerprints have both of two bits set."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    phi = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(phi, 0)
    free, blocks = list(range(BITS)), []
    while free:
        rest = np.array(free)
        # the bit with the strongest tie to another one
        block = [int(rest[np.argmax(phi[np.ix_(rest, rest)].max(axis=1))])]
        free.remove(block[0])
        while len(block) < BLOCK:
            rest = np.array(free)
            block.append(int(rest[np.argmax(phi[np.ix_(rest, block)].mean(axis=1))]))
            free.remove(block[-1])
        blocks.append(block)
    return blocks


def value_rings(prints: DataFrame, blocks: list[list[int]]) -> np.ndarray:
    """[block, t, value]: how many fingerprints differ from a value of a block in exactly t of its bits (4 x 4 x 2**16 numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(blocks), 1 << BLOCK), np.int64)
        for batch in batches:
            fp = uint64s(batch.column(0))
            for i, bits in enumerate(blocks):
                total[i] += np.bincount(taken(fp, bits), minlength=1 << BLOCK)
        i, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(v), pa.array(total[i, v])], ["block", "value", "n"])

    rings = np.zeros((len(blocks), D + 1, 1 << BLOCK))
    # at most 4 x 2**16 counts, whatever the number of documents
    found = prints.select("fp").mapInArrow(run, "block bigint, value bigint, n bigint").groupBy("block", "value").agg(F.sum("n").alias("n")).toPandas()
    rings[found["block"], 0, found["value"]] = found["n"]
    values = np.arange(1 << BLOCK)
    for j in range(BLOCK):
        # with bit j: either equal there, or different and one of the t is used up
        shifted = rings[:, :, values ^ (1 << j)]
        rings[:, 1:] += shifted[:, :-1]
    return rings


def estimates(prints: np.ndarray, blocks: list[list[int]], rings: np.ndarray, layout: tuple, n: int) -> np.ndarray:
    """[partition, u, fingerprint]: estimated work with threshold u - 1, 0 for u = 0.

    Counts are exact for a partition of one block; in one of two blocks these are taken as independent.
    """
    out = np.zeros((len(layout), D + 2, len(prints)))
    for i, part in enumerate(layout):
        ring = rings[part[0]][:, taken(prints, blocks[part[0]])]
        for b in part[1:]:
            other = rings[b][:, taken(prints, blocks[b])]
            ring = np.stack([sum(ring[s] * other[t - s] for s in range(t + 1)) / max(n, 1) for t in range(D + 1)])
        width = BLOCK * len(part)
        probes = np.cumsum([len(list(combinations(range(width), t))) if t < 3 else width * (width - 1) * (width - 2) // 6 for t in range(D + 1)])
        out[i, 1:] = np.cumsum(ring, axis=0) + PROBE * probes[:, None]
    return out


def allocate(work: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds [partition, fingerprint] with the least work, and that work: dynamic programming over D + 1 units."""
    m, units, n = work.shape
    best = np.full((units, n), np.inf)
    best[0] = 0
    choice = np.zeros((m, units, n), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for s in range(units):
            for u in range(s + 1):
                cost = best[s - u] + work[i, u]
                less = cost < new[s]
                new[s][less] = cost[less]
                choice[i, s][less] = u
        best = new
    out = np.zeros((m, n), np.int64)
    left = np.full(n, units - 1)
    for i in range(m - 1, -1, -1):
        out[i] = choice[i, left, np.arange(n)] - 1
        left = left - out[i] - 1
    return out, best[-1]


def cheapest_layout(prints: DataFrame, blocks: list[list[int]], rings: np.ndarray, n: int) -> tuple:
    """The layout with the least estimated work, summed over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LAYOUTS))
        for batch in batches:
            fp = uint64s(batch.column(0))
            for at in range(0, len(fp), 1 << 15):
                for i, layout in enumerate(LAYOUTS):
                    some = estimates(fp[at : at + (1 << 15)], blocks, rings, layout, n)
                    # an indexed row a partition is shuffled too
                    total[i] += allocate(some)[1].sum() + PROBE * len(layout) * some.shape[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(LAYOUTS))), pa.array(total)], ["i", "work"])

    found = prints.select("fp").mapInArrow(run, "i bigint, work double").groupBy("i").agg(F.sum("work").alias("work")).collect()
    return LAYOUTS[min(found, key=lambda r: (r.work, r.i)).i] if found else LAYOUTS[0]


def equal_bits(path: int, bits: list[list[int]]) -> list[int]:
    """Bits that the members of a group share: path is a partition, then one of four quarters of the rest at each level.

    Digits to base 8: the last is the partition, those before it are quarters plus one.
    """
    order = [b for part in bits for b in part]
    have = list(bits[path % 8])
    path //= 8
    while path:
        quarter, path = path % 8 - 1, path // 8
        rest = [b for b in order if b not in set(have)]
        have += rest[quarter::4]
    return have


def depth_of(path: int) -> int:
    return 0 if path < 8 else 1 + depth_of(path // 8)


ROWS = "path int, key bigint, asks boolean, seen bigint, fp bigint, node bigint"


def probes(prints: DataFrame, blocks: list[list[int]], rings: np.ndarray, layout: tuple, n: int) -> DataFrame:
    """Rows of all groups: every fingerprint once a partition, and once for each value under which it asks.

    ``seen`` is the fingerprint with the value asked for in place of its own, ``key`` the bits of it that the group shares.
    """
    bits = [[b for i in part for b in blocks[i]] for part in layout]
    masks = [[np.concatenate(near_masks(p, t)) for t in range(D + 1)] for p in ([] if n == 0 else bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(i: int, asks: bool, fp: np.ndarray, seen: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            key = seen & np.uint64(mask_of(bits[i]))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array(key.view(np.int64)), pa.array(np.full(len(fp), asks)), pa.array(seen.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(node)], ["path", "key", "asks", "seen", "fp", "node"])

        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                part = batch.slice(at, 1 << 14)
                fp, node = uint64s(part.column(0)), np.asarray(part.column(1))
                limits, _ = allocate(estimates(fp, blocks, rings, layout, n))
                for i in range(len(layout)):
                    yield out(i, False, fp, fp, node)
                    for t in range(D + 1):
                        mine = np.flatnonzero(limits[i] == t)
                        step = max(1, (1 << 18) // len(masks[i][t]))
                        for j in range(0, len(mine), step):
                            some = mine[j : j + step]
                            seen = (fp[some][:, None] ^ masks[i][t][None, :]).ravel()
                            yield out(i, True, np.repeat(fp[some], len(masks[i][t])), seen, np.repeat(node[some], len(masks[i][t])))

    return prints.select("fp", "node").mapInArrow(run, ROWS)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few links that connect what the links (a, b) connect: every node and the least one it reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            far = label != np.arange(len(nodes))
            return nodes[far], nodes[label[far]]
        label = new


def compared(group: np.ndarray, asks: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside groups, whose rows stand together: every asking row against every indexed one, AT_ONCE pairs at a time."""
    order = np.lexsort((asks, group))
    group, asks, fp, node = group[order], asks[order], fp[order], node[order]
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    held = np.add.reduceat(~asks, begin).astype(np.int64)
    asking = np.flatnonzero(asks)
    of = np.searchsorted(begin, asking, "right") - 1
    first, many = begin[of], held[of]
    total = np.cumsum(many)
    at = 0
    while at < len(asking):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        q = np.repeat(asking[at:end], many[at:end])
        x = ranges(first[at:end], many[at:end])
        hit = (np.bitwise_count(fp[q] ^ fp[x]) <= D) & (node[q] != node[x])
        if hit.any():
            yield node[q[hit]], node[x[hit]]
        at = end


def looked_up(shared: list[int], asks: np.ndarray, seen: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside one group that shares all but FEW bits: asking rows look up every value near them."""
    rest = [b for b in range(BITS) if b not in set(shared)]
    masks = np.concatenate(near_masks(rest, min(D, len(rest))))
    order = np.argsort(fp[~asks])
    values, nodes = fp[~asks][order], node[~asks][order]
    key = np.uint64(mask_of(shared))
    want, mine, own = (seen & key)[asks] | (fp & ~key)[asks], node[asks], fp[asks]
    if not len(values):
        return
    step = max(1, AT_ONCE // len(masks))
    for i in range(0, len(want), step):
        near = (want[i : i + step][:, None] ^ masks[None, :]).ravel()
        at = np.minimum(np.searchsorted(values, near), len(values) - 1)
        q = np.repeat(np.arange(i, min(i + step, len(want))), len(masks))
        hit = values[at] == near
        q, at = q[hit], at[hit]
        hit = (np.bitwise_count(own[q] ^ values[at]) <= D) & (mine[q] != nodes[at])
        if hit.any():
            yield mine[q[hit]], nodes[at[hit]]


def group_links(rows: DataFrame, bits: list[list[int]], few: int) -> DataFrame:
    """Links (a, b) of all groups of rows; groups come in order, and whole ones are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            path, key, seen, fp = np.asarray(table["path"]), np.asarray(table["key"]), uint64s(table["seen"]), uint64s(table["fp"])
            asks, node = np.asarray(table["asks"]), np.asarray(table["node"])
            begin = np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1])))
            group = np.cumsum(begin) - 1
            last = np.array([BITS - len(equal_bits(int(p), bits)) <= few for p in np.unique(path)])[np.searchsorted(np.unique(path), path)]
            found = list(forest_of(compared(group[~last], asks[~last], fp[~last], node[~last]) if (~last).any() else ()))
            for g in np.unique(group[last]).tolist():
                at = np.flatnonzero(group == g)
                found += forest_of(looked_up(equal_bits(int(path[at[0]]), bits), asks[at], seen[at], fp[at], node[at]))
            if found:
                a, b = forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= 1 << 18:
                table = pa.Table.from_batches(held)
                path, key = np.asarray(table["path"]), np.asarray(table["key"])
                # the last group may go on in the next batch
                open_ = int(np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (key[1:] != key[:-1]))))[-1])
                if open_:
                    yield from links(table.slice(0, open_))
                    held = table.slice(open_).to_batches()
        if held:
            yield from links(pa.Table.from_batches(held))

    return rows.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(run, "a bigint, b bigint")


def forest_of(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [forest(a, b) for a, b in links]


def finer(rows: DataFrame, bits: list[list[int]]) -> DataFrame:
    """Rows of groups that are too large, four times each: once for every quarter of the bits that they do not share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, seen = np.asarray(batch.column(0)), uint64s(batch.column(3))
            for p in np.unique(path).tolist():
                at = np.flatnonzero(path == p)
                some = batch.take(pa.array(at))
                for quarter in range(4):
                    longer = p + (quarter + 1) * 8 ** (depth_of(p) + 1)
                    key = seen[at] & np.uint64(mask_of(equal_bits(longer, bits)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), longer, np.int32)), pa.array(key.view(np.int64)), *(some.column(i) for i in range(2, 6))], batch.schema.names)

    return rows.mapInArrow(run, ROWS)


def near_links(prints: DataFrame, most: int = PAIRS, few: int = FEW) -> DataFrame:
    """Links (a, b) that connect the nodes of fingerprints within D bits; prints: distinct (fp, node), in files."""
    n = prints.count()
    blocks = correlated_blocks(prints)
    rings = value_rings(prints, blocks)
    layout = cheapest_layout(prints, blocks, rings, n)
    bits = [[b for i in part for b in blocks[i]] for part in layout]
    rows = written(probes(prints, blocks, rings, layout, n), "probes")
    links = None
    while True:
        asked = F.count(F.when(F.col("asks"), 1))
        large = rows.groupBy("path", "key").agg(asked.alias("q"), F.count(F.when(~F.col("asks"), 1)).alias("x")).where((F.col("q") * F.col("x") > most))
        paths = {r.path for r in large.select("path").distinct().collect()}  # at most 3 x 4 ** levels
        large = written(large.where(F.col("path").isin([p for p in paths if BITS - len(equal_bits(p, bits)) > few])).select("path", "key"), "large")
        more = large.limit(1).count() > 0
        fit = rows.join(large, ["path", "key"], "left_anti") if more else rows
        some = group_links(fit, bits, few)
        links = some if links is None else links.unionByName(some)
        if not more:
            return links
        rows = written(finer(rows.join(large, ["path", "key"], "left_semi").select(*(c.split()[0] for c in ROWS.split(", "))), bits), "finer")


def hexed(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PAIRS, few: int = FEW) -> DataFrame:
    """Per row: doc_id, fingerprint and component_id, the least id that links of at most three differing bits reach."""
    prints = written(fingerprints(docs, id_col, text_col), "prints")
    nodes = written(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "nodes")
    joined = components(near_links(nodes.select("fp", "node"), most, few))
    named = nodes.join(joined, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("c"))
    # rows of one id with different texts: the id ties them together only in what it names, not in links
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(least, "c").select("fp", "component_id")
    return prints.join(named, "fp", "left").select("doc_id", hexed(F.col("fp")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
