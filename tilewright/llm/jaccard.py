"""Operator 2, exact Jaccard join of documents on word n-grams as a metric-space join.

Jaccard distance is a metric, but unrelated documents are all at distance 1 of each other, where a
pivot says nothing.  So the space is cut in two steps, both exact:

1. *Regions.*  All n-grams are put in one fixed order that starts with those of the longest words.  Two
   sets with similarity of at least t share a member among their first n - ceil(t * n) + 1, so each of
   these prefix members that occurs in two different sets makes a region.  Its pivot is its least
   set; regions of the same pivot are one region.  A document is replicated into every region that its
   prefix touches.  Prefixes are longer by a share c - 1, so that a pair shares c of their members, and each
   document leaves out its c - 1 commonest: the least common member of a pair's c is left out by neither.  So
   documents that share no more than a passage mostly touch no region at all.
2. *Voronoi cells.*  Inside a region, members whose locally rarest n-grams occur nowhere else in it
   have no partner.  For the rest, pivots get exact distances to all members in their window: members
   within the distance bound of a pivot are its cell and its component, a member beyond it becomes a
   new pivot, and by the triangle inequality only members whose distances to every common pivot differ
   by the bound at most are compared (the boundary documents of two cells).  This goes on until
   no member is without a cell.  Pairs that are already in one component are not compared again.  A region too large for a
   task is cut into chunks, which meet some of its pivots first and then, in blocks, the members that no link of those joins.

Documents with equal sets are one node from the start, so that copies are never paired.  Links between
nodes become components with partial aggregation in every round.

Defined cases: a null or empty text, or one without words, has an empty set and is linked with nothing; a text
with fewer words than n has its whole word sequence as its one member; rows with a repeated id count as
documents of that id; a null id is reported with a null component; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lowered, mixed, ranges, steps, word_hashes, words, written

#: Share of a set by which prefixes are longer, as 1 / SLACK.
SLACK = 24
#: Members, and n-grams of all members, of a region that one task takes, pivots whose distances are kept for its
#: windows, and pivots that all chunks of a larger region are compared with.
REGION_ROWS, REGION_KEYS, PIVOTS, STARS = 4096, 1 << 22, 64, 16
FIRST = np.uint64(0x5851F42D4C957F2D)


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, ranked: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each row as sorted 64-bit hashes, and row offsets into them.

    ``ranked`` puts n-grams of more bytes of words first, so that each row begins with n-grams that are rare.
    """
    data = lowered(data)
    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=len(offsets) - 1) if len(rows) else np.zeros(len(offsets) - 1, np.int64)
    hashes, sizes = word_hashes(data, starts, ends), ends - starts
    begin = np.concatenate(([0], np.cumsum(count)))
    at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :]) if len(rows) >= n else np.zeros(0, np.int64)
    key, size = np.full(len(at), FIRST), np.zeros(len(at), np.int64)
    for i in range(n):
        key, size = mixed(key ^ hashes[at + i]), size + sizes[at + i]
    short = np.flatnonzero((count > 0) & (count < n))
    owner = np.concatenate((rows[at], short))
    extra, extra_size = np.full(len(short), FIRST), np.zeros(len(short), np.int64)
    for i in range(n - 1):
        on = count[short] > i
        w = begin[short[on]] + i
        extra[on], extra_size[on] = mixed(extra[on] ^ hashes[w]), extra_size[on] + sizes[w]
    key = np.concatenate((key, mixed(extra ^ count[short].astype(np.uint64))))
    order = np.argsort(key)
    if ranked:
        rank = (255 - np.minimum(np.concatenate((size, extra_size)), 255)).astype(np.uint8)
        order = order[np.argsort(rank[order], kind="stable")]
    small = np.uint16 if len(offsets) <= 65536 else np.int64
    order = order[np.argsort(owner[order].astype(small), kind="stable")]
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    key, owner = key[fresh], owner[fresh]
    return key, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(offsets) - 1)))).astype(np.int64)


def set_hashes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(keys), dtype=np.uint64)))
    return mixed((total[at[1:]] - total[at[:-1]]) ^ mixed(np.diff(at).astype(np.uint64)))


def needed(n, percent: int):
    """ceil(percent / 100 * n)."""
    return -(-percent * n // 100)


def _sets(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, n_shingles, s): the size and hash of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            keys, at = shingles(data, offsets, n)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(set_hashes(keys, at).view(np.int64))], ["doc_id", "n_shingles", "s"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, s bigint")


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (g, s, spare): each set's prefix members, and how many of them the set may leave out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in steps(batches):
            keys, at = shingles(data, offsets, n, ranked=True)
            size = np.diff(at)
            hashes, first = np.unique(set_hashes(keys, at), return_index=True)
            keep = size[first] > 0
            hashes, first = hashes[keep], first[keep]
            size = size[first]
            take = np.minimum(size, size - needed(size, percent) + 1 + size // SLACK)
            spare = needed(size, percent) // SLACK
            which = np.repeat(np.arange(len(first)), take)
            picked = keys[np.repeat(at[first], take) + np.arange(len(which)) - np.repeat(np.cumsum(take) - take, take)]
            yield pa.RecordBatch.from_arrays([pa.array(picked.view(np.int64)), pa.array(hashes[which].view(np.int64)), pa.array(spare[which].astype(np.int32))], ["g", "s", "spare"])

    return docs.mapInArrow(run, "g bigint, s bigint, spare int")


class Union:
    """Disjoint sets of 0 .. n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _partners(keys: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """Groups of members that share a member of their locally rarest prefixes; others have no partner."""
    size = np.array([len(k) for k in keys])
    owner = np.repeat(np.arange(len(keys)), size)
    _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    order = np.lexsort((which, count[which], owner))
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    inside = place < np.repeat(size - needed(size, percent) + 1, size)
    which, owner = which[order][inside], owner[order][inside]
    order = np.argsort(which, kind="stable")
    which, owner = which[order], owner[order]
    union = Union(len(keys))
    same = np.flatnonzero(which[1:] == which[:-1])
    for a, b in np.unique(np.stack((owner[same], owner[same + 1]), 1), axis=0).tolist() if len(same) else ():
        union.join(a, b)
    roots = np.array([union.root(i) for i in range(len(keys))])
    order = np.argsort(roots, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(roots[order])) + 1)
    return [g for g in groups if len(g) > 1]


class Region:
    """The sets of one region, with intersection sizes of one set with many.

    N-grams that only one member holds can't be shared.  Those of at least one member in 64 have a bit column each, so that
    a set is a row of bits and an intersection a bitwise "and"; for rarer ones the members that hold them are listed.
    Both take some eight bytes for each n-gram of a member at most.
    """

    def __init__(self, keys: list[np.ndarray], percent: int):
        self.percent = percent
        self.size = np.array([len(k) for k in keys])
        m, at = len(keys), np.concatenate(([0], np.cumsum(self.size)))
        _, which, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        which = which.astype(np.int32)
        often = (count > 1) & (count * 64 >= m)
        column = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        width = -(-int(often.sum()) // 64) * 64
        self.bits = np.zeros((m, width // 64), np.uint64)
        for i in range(m):
            mine = column[which[at[i] : at[i + 1]]]
            row = np.zeros(width, np.uint8)
            row[mine[mine >= 0]] = 1
            self.bits[i] = np.packbits(row).view(np.uint64)
        rare = ((count > 1) & ~often)[which]
        self.rare = which[rare]
        self.rare_at = np.concatenate(([0], np.cumsum(rare)))[at]
        owner = np.repeat(np.arange(m, dtype=np.int32), self.size)[rare]
        order = np.argsort(self.rare, kind="stable")
        self.holders = owner[order]
        self.held = np.searchsorted(self.rare[order], np.arange(len(count) + 1)) if len(order) else None

    def common(self, one: int, many: np.ndarray) -> np.ndarray:
        total = np.zeros(len(many), np.int64)
        rows = max(1, (1 << 17) // max(1, self.bits.shape[1]))
        for i in range(0, len(many), rows):
            total[i : i + rows] = np.bitwise_count(self.bits[many[i : i + rows]] & self.bits[one]).sum(axis=1, dtype=np.int64)
        mine = self.rare[self.rare_at[one] : self.rare_at[one + 1]]
        if len(mine):
            listed = self.holders[ranges(self.held[mine], self.held[mine + 1] - self.held[mine])]
            total += np.bincount(listed, minlength=len(self.size))[many]
        total[many == one] = self.size[one]  # with the n-grams that only it holds
        return total

    def measured(self, one: int, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links and distances of one set to many."""
        both = self.common(one, many)
        union = self.size[one] + self.size[many] - both
        return 100 * both >= self.percent * union, 1 - both / union


def region_links(keys: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Pairs that link, enough of them to join all that the links of the region join."""
    links: list[tuple[int, int]] = []
    if len(keys) < 2:
        return links
    bound = 1 - percent / 100 + 1e-6
    for group in _partners(keys, percent) if len(keys) > 2 else [np.array([0, 1])]:
        region = Region([keys[i] for i in group.tolist()], percent)
        m = len(group)
        union = Union(m)
        cell = np.full(m, -1)
        near: list[np.ndarray] = []
        all_ = np.arange(m)
        # any pivots give windows; members without a cell after PIVOTS of them are compared inside their windows only
        while len(near) < PIVOTS and (left := np.flatnonzero(cell < 0)).size:
            p = int(left[0])
            linked, distance = region.measured(p, all_)
            for y in np.flatnonzero(linked).tolist():
                if union.join(p, y):
                    links.append((int(group[p]), int(group[y])))
            cell[linked & (cell < 0)] = p
            near.append(distance.astype(np.float32))
        if len(near) > 1:
            links += [(int(group[a]), int(group[b])) for a, b in _boundary_links(region, np.array(near), union, bound)]
    return links


def _boundary_links(region: Region, near: np.ndarray, union: Union, bound: float) -> list[tuple[int, int]]:
    """Links between members of different cells whose components are not joined yet."""
    links = []
    m = len(region.size)
    roots = np.array([union.root(i) for i in range(m)])
    for x in range(m):
        if (roots == roots[x]).all():
            continue
        later = np.flatnonzero(roots[x + 1 :] != roots[x]) + x + 1
        small, large = np.minimum(region.size[later], region.size[x]), np.maximum(region.size[later], region.size[x])
        later = later[100 * small >= region.percent * large]
        later = later[(np.abs(near[:, later] - near[:, [x]]) <= bound).all(axis=0)]
        if len(later):
            for y in later[region.measured(x, later)[0]].tolist():
                if union.join(x, y):
                    links.append((x, y))
                    roots[roots == max(roots[x], roots[y])] = min(roots[x], roots[y])
    return links


def _groups(batches: Iterator[pa.RecordBatch], n: int, keys: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Whole groups of rows sorted by their first ``keys`` columns: all columns but the text, and the sets."""
    held: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    for part, data, offsets in steps(batches):
        flat, at = shingles(data, offsets, n)
        rows = np.stack([np.asarray(part.column(i)).astype(np.int64) for i in range(part.num_columns - 1)], 1)
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :keys] != rows[:-1, :keys]).any(axis=1)
        first[0] = not held or (held[-1][-1, :keys] != rows[0, :keys]).any()
        cuts = np.flatnonzero(first).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if a in cuts and held:
                yield np.concatenate(held), sets
                held, sets = [], []
            if b > a:
                held.append(rows[a:b])
                sets += [flat[i:j] for i, j in zip(at[a:b].tolist(), at[a + 1 : b + 1].tolist(), strict=True)]
    if held:
        yield np.concatenate(held), sets


def _region_links(placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (a, b): links of all regions; regions come one after the other, so that a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _groups(batches, n, 1):
            # the pivot first: it is the region's first Voronoi centre
            order = np.argsort(rows[:, 1] != rows[:, 0], kind="stable")
            s = rows[order, 1]
            links = region_links([sets[i] for i in order.tolist()], percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([int(s[x[i]]) for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return placed.select("p", "s", "text").repartition("p").sortWithinPartitions("p").mapInArrow(run, "a bigint, b bigint")


GROUPED = ["p", "chunk", "block", "s", "role", "text"]


def _tasks(rows, keys):
    """How many tasks share so many members with so many n-grams."""
    return F.greatest(F.ceil(rows / REGION_ROWS), F.ceil(keys / REGION_KEYS)).cast("bigint")


def _large_region_links(placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Links of regions that are too large for a task: (p, m members with k n-grams, s, text) in.

    First every chunk of a region is compared with STARS pivots.  Pivots that share a linked member are one component, and
    all that links to the component of the region's own pivot is joined by it.  Only members that do not (mostly
    few) go on: in blocks they meet every chunk of their region, and inside a chunk and a
    block the cells are formed as in a small region.  A task holds at most some two times REGION_ROWS members or REGION_KEYS n-grams.
    """
    chunks = _tasks(F.col("m"), F.col("k"))
    chunk = F.pmod(F.xxhash64("s"), chunks)
    # the region's own pivot, and the members with the least hashes
    order = Window.partitionBy("p").orderBy(F.col("s") != F.col("p"), F.xxhash64("s", F.lit(7)), "s")
    stars = placed.select("p", "s").distinct().withColumn("role", F.row_number().over(order) - 1).where(F.col("role") < STARS)
    stars = placed.join(stars, ["p", "s"]).select("p", F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"), F.lit(0).alias("block"), "s", "role", "text")
    first = placed.select("p", chunk.alias("chunk"), F.lit(0).alias("block"), "s", F.lit(-1).alias("role"), "text").unionByName(stars)

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys in _groups(batches, n, 3):
            mine, role = np.flatnonzero(rows[:, 4] < 0), rows[:, 4]
            if not len(mine):
                continue
            region, mask = Region(keys, percent), np.zeros(len(rows), np.int64)
            for i in np.flatnonzero(role >= 0).tolist():
                mask |= region.measured(i, np.arange(len(rows)))[0].astype(np.int64) << role[i]
            yield pa.RecordBatch.from_arrays([pa.array(rows[mine, 0]), pa.array(rows[mine, 3]), pa.array(region.size[mine]), pa.array(mask[mine])], ["p", "s", "k", "mask"])

    found = first.select(*GROUPED).repartition("p", "chunk").sortWithinPartitions("p", "chunk").mapInArrow(star, "p bigint, s bigint, k bigint, mask bigint")
    found = written(found, "stars")
    bit = lambda j: F.shiftleft(F.lit(1).cast("bigint"), j)
    near = found.groupBy("p").agg(F.array(*(F.coalesce(F.bit_or(F.when(F.col("mask").bitwiseAND(bit(j)) != 0, F.col("mask"))), F.lit(0)) for j in range(STARS))).alias("near"))
    step = lambda reach, i: F.when(reach.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), (i % STARS).cast("int"))) != 0, reach.bitwiseOR(F.element_at("near", (i % STARS + 1).cast("int")))).otherwise(reach)
    near = written(near.select("p", F.aggregate(F.sequence(F.lit(0), F.lit(STARS * STARS - 1)), F.lit(1).cast("bigint"), step).alias("reach")), "reach")
    found = found.join(near, "p").select("p", "s", "k", (F.col("mask").bitwiseAND(F.col("reach")) != 0).alias("linked"))
    left = written(found.where("not linked").select("p", "s", "k").distinct(), "left")
    blocks = written(left.groupBy("p").agg(_tasks(F.count(F.lit(1)), F.sum("k")).alias("blocks")), "blocks")
    open_ = placed.join(blocks, "p")
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1))
    members = open_.select("p", chunk.alias("chunk"), every("blocks").alias("block"), "s", F.lit(0).alias("role"), "text")
    rest = open_.join(left, ["p", "s"], "left_semi").withColumn("chunks", chunks)
    rest = rest.select("p", every("chunks").alias("chunk"), F.pmod(F.xxhash64("s", F.lit(1)), F.col("blocks")).alias("block"), "s", F.lit(1).alias("role"), "text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, keys in _groups(batches, n, 3):
            s, first_of = np.unique(rows[:, 3], return_index=True)
            links = region_links([keys[i] for i in first_of.tolist()], percent)
            yield pa.RecordBatch.from_arrays([pa.array([int(s[x[i]]) for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    met = members.unionByName(rest).select(*GROUPED).repartition("p", "chunk", "block").sortWithinPartitions("p", "chunk", "block").mapInArrow(meet, "a bigint, b bigint")
    return found.where("linked").select(F.col("p").alias("a"), F.col("s").alias("b")).unionByName(met)


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least id that links reach)."""
    docs = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    sets = written(_sets(docs, n), "sets")
    known = docs.where("doc_id is not null")
    prefixes = _prefixes(known, n, percent)
    shared = prefixes.groupBy("g").agg(F.min("s").alias("p"), F.max("s").alias("last"), F.count(F.lit(1)).alias("n")).where("p <> last").drop("last")
    touched = prefixes.join(shared, "g").groupBy("s").agg(F.max("spare").alias("spare"), F.collect_set(F.struct("n", "g", "p")).alias("of"))
    # without the commonest members of a prefix, as many as may be left out
    of = F.sort_array("of", asc=False)
    left = F.slice(of, F.col("spare") + 1, F.greatest(F.size(of) - F.col("spare"), F.lit(0)))
    regions = written(touched.select("s", F.array_distinct(F.transform(left, lambda x: x["p"])).alias("p")), "regions")
    pivots = regions.select(F.explode("p").alias("p")).distinct().select(F.col("p").alias("s"), F.array("p").alias("p"))
    regions = regions.unionByName(pivots).groupBy("s").agg(F.array_distinct(F.flatten(F.collect_list("p"))).alias("p"))
    first = sets.where("n_shingles > 0 and doc_id is not null").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("k"))
    members = regions.join(first, "s")
    of_doc = members.groupBy("doc_id").agg(F.collect_list(F.struct("s", "p")).alias("of"))
    placed = known.join(of_doc.hint("shuffle_hash"), "doc_id").select("text", F.explode("of").alias("of"))
    placed = placed.select(F.explode("of.p").alias("p"), F.col("of.s").alias("s"), "text")
    large = members.select(F.explode("p").alias("p"), "k").groupBy("p").agg(F.count(F.lit(1)).alias("m"), F.sum("k").alias("k")).where(_tasks(F.col("m"), F.col("k")) > 1)
    large = written(large, "large")
    if large.limit(1).count():
        links = _region_links(placed.join(large, "p", "left_anti"), n, percent)
        links = links.unionByName(_large_region_links(placed.join(large, "p"), n, percent))
    else:
        links = _region_links(placed, n, percent)
    joined = components(links)
    named = first.join(joined.withColumnRenamed("node", "s"), "s", "left").select("s", "doc_id", F.coalesce("component", "s").alias("c"))
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_set = named.join(least, "c").select("s", "component_id")
    out = sets.join(of_set, "s", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without those linked to a smaller id; one document of each group stays."""
    dropped = jaccard_components(docs, n, percent, id_col, text_col).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(dropped.withColumnRenamed("doc_id", "dropped_id").hint("shuffle_hash"), F.col(id_col).cast("bigint") == F.col("dropped_id"), "left_anti")
