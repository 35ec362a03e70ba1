"""Operator 13, prefix trie of conversations by truncation peeling.

Every conversation is a sequence of turns, kept as a path: for each depth a 16-byte chained digest of the turns up to
there, so that stripping the last turn is cutting 16 bytes off.  Nodes are peeled from the greatest depth to the root:
at each depth the conversations that end there join the nodes that survive from below, equal paths become one node,
its aggregates are final, and its last turn is stripped.

Rounds of Spark are only spent on nodes with over GROUP conversations (:func:`prefix_trie` finds them from the root
downwards and goes on with their conversations alone).  The subtree below them is cut into groups that share the first turns and hold at most GROUP
conversations; a task peels a group through all its depths.  Above, each depth is one aggregation with partial sums, so a first
turn or a whole conversation that a third of all share is no hot task.  The digest of the ids
that end at a node is taken over chunks of ids in their order; a chunk is 1 MB at most, and a task holds one.

Defined cases: rows with a null conv_id take no part; a null turn comes first, null roles and texts are empty; rows of one
conversation with the same turn are ordered by role, then by the digest of role and text (equal rows count as often as they occur); further
columns are ignored; an empty table gives no rows, not even a root.  A conversation's path is one value of
24 bytes a turn.  Equal 128-bit digests are taken as equal turns.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bytes of a digest, and the most conversations of a group that one task peels.
KEY, GROUP = 16, 4096
CHUNK = 1 << 20


def shared_heads(conv_id: int) -> int:
    """How many turns a conversation takes over from the first of its family of five."""
    return zlib.crc32(str(conv_id).encode()) % 9


def paths(conversations: DataFrame, heads: Callable[[int], int] | None = None, family: int = 5, most: int = 8) -> DataFrame:
    """Per conversation: conv_id, n turns, path (n digests of 16 bytes) and sizes (bytes of each turn's text).

    With ``heads`` each conversation c first takes the first heads(c) (at most ``most``) turns of conversation c - c % family
    in place of as many of its own.  Rows are sorted, and a task holds one conversation's path at a time.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(F.expr(f"cast(conv_id as bigint) - cast(conv_id as bigint) % {family}").alias("base"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("bigint").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        base, head, now = None, [], None
        own = skip = n = 0
        path, sizes, key = bytearray(), [], b""

        def add(digest: bytes, size: int) -> None:
            nonlocal key, n
            key = hashlib.md5(key + digest).digest()
            path.extend(key)
            sizes.append(size)
            n += 1

        for batch in batches:
            for b, c, digest, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if c != now:
                    if now is not None:
                        out.append((now, n, bytes(path), sizes))
                    if b != base:
                        base, head = b, []
                    now, own, n, path, sizes, key = c, 0, 0, bytearray(), [], b""
                    skip = heads(c) if heads and c != b else 0
                    for turn in head[:skip]:
                        add(*turn)
                if c == b and own < most:
                    head.append((digest, size))
                if own >= skip:
                    add(digest, size)
                own += 1
            yield conversations_of(out)
            out = []
        if now is not None:
            yield conversations_of([(now, n, bytes(path), sizes)])

    ordered = turns.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return ordered.select("base", "conv_id", "digest", "size").mapInArrow(run, "conv_id bigint, n bigint, path binary, sizes array<bigint>")


def conversations_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n", "path", "sizes"])


#: A node; ``above`` and ``sizes`` are the path and sizes of its parent where that is peeled later, else null.
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, above binary, sizes array<bigint>"
NAMES = [c.split()[0] for c in NODE.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.list_(pa.int64())]


class Node:
    __slots__ = ("children", "ends", "least", "leaves", "n", "row", "saved")

    def __init__(self, row: int, least: int) -> None:
        self.row, self.least, self.n, self.children, self.leaves, self.saved, self.ends = row, least, 0, 0, 0, 0, []


def digest_of(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def peeled(ids: list[int], lengths: list[int], found: list[bytes], sizes: list[list[int]], cut: int) -> list[tuple]:
    """Nodes of conversations that share their first ``cut`` turns, from the deepest to the one at that depth; longest first."""
    out, below, at = [], [], 0
    for d in range(lengths[0], cut - 1, -1):
        nodes: dict[bytes, Node] = {}
        key = slice((d - 1) * KEY, d * KEY)
        for kid in below:
            node = nodes.get(k := found[kid.row][key])
            if node is None:
                node = nodes[k] = Node(kid.row, kid.least)
            node.n += kid.n
            node.least = min(node.least, kid.least)
            node.children += 1
            node.leaves += kid.leaves
            node.saved += kid.saved
        while at < len(ids) and lengths[at] == d:
            node = nodes.get(k := found[at][key])
            if node is None:
                node = nodes[k] = Node(at, ids[at])
            node.n += 1
            node.least = min(node.least, ids[at])
            node.ends.append(ids[at])
            at += 1
        for kid in below:
            out.append((kid.least, d + 1, nodes[found[kid.row][key]].least, kid.n, kid.children, kid.leaves, kid.saved, digest_of(kid.ends), None, None))
        for node in nodes.values():
            node.leaves = node.leaves or 1
            node.saved += (node.n - 1) * sizes[node.row][d - 1]
        below = list(nodes.values())
    top = below[0]
    out.append((top.least, cut, None, top.n, top.children, top.leaves, top.saved, digest_of(top.ends), found[top.row][: (cut - 1) * KEY], sizes[top.row][: cut - 1]))
    return out


def _key(depth: Column | int) -> Column:
    """The digest of a path at a depth."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.substring("path", ((depth - 1) * KEY + 1).cast("int"), F.lit(KEY))


def _peeled_groups(light: DataFrame) -> DataFrame:
    """Nodes of all groups (conv_id, n, path, sizes, cut); groups come in order, a task holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(group: list[tuple]) -> pa.RecordBatch:
            _, ids, lengths, found, sizes, cuts = map(list, zip(*group, strict=True))
            rows = peeled(ids, lengths, found, sizes, cuts[0])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], NAMES)

        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held and held[0][0] != row[0]:
                    yield nodes(held)
                    held = []
                held.append(row)
        if held:
            yield nodes(held)

    keyed = light.select(_key(F.col("cut")).alias("g"), "conv_id", "n", "path", "sizes", "cut")
    return keyed.repartition("g").sortWithinPartitions("g", F.desc("n"), "conv_id").mapInArrow(run, NODE)


def _ends(ended: DataFrame) -> DataFrame:
    """(path, ends_sha256) of conversations (conv_id, path): ids in order, in chunks, hashed one chunk after the other."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, ids, size = None, 0, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([first]), pa.array([",".join(ids)])], ["path", "first", "ids"])

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (p != path or size > CHUNK):
                    yield chunk()
                    ids = []
                if not ids:
                    path, first, size = p, c, 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, digest = None, None
        done: list[tuple[bytes, str]] = []
        for batch in batches:
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is not None and p == path:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = p, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], ["path", "ends_sha256"])
            done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([digest.hexdigest()])], ["path", "ends_sha256"])

    cut = ended.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(chunks, "path binary, first bigint, ids string")
    return cut.repartition("path").sortWithinPartitions("path", "first").select("path", "ids").mapInArrow(hashed, "path binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per node of the trie of :func:`paths`: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = written(convs, "paths")
    ended, light = [convs.where("n = 0")], []
    rest, depth = convs.where("n > 0"), 0
    while True:
        depth += 1
        keyed = rest.withColumn("g", _key(depth))
        heavy = written(keyed.groupBy("g").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > group).select("g"), "heavy")
        if not heavy.limit(1).count():
            light.append(rest.withColumn("cut", F.lit(depth)))
            break
        light.append(keyed.join(heavy, "g", "left_anti").drop("g").withColumn("cut", F.lit(depth)))
        inside = keyed.join(heavy, "g", "left_semi").drop("g")
        ended.append(inside.where(F.col("n") == depth))
        rest = written(inside.where(F.col("n") > depth), "rest")
    groups = light[0]
    for some in light[1:]:
        groups = groups.unionByName(some)
    nodes = written(_peeled_groups(groups), "nodes")
    out = nodes.where("above is null").drop("above", "sizes")
    open_ = nodes.where("above is not null")
    below = None
    for d in range(depth - 1, -1, -1):
        kids = open_.where(F.col("depth") == d + 1)
        kids = kids if below is None else kids.unionByName(below)
        stop = ended[d].select("path", "conv_id", F.lit(1).cast("bigint").alias("n_convs"), F.lit(0).cast("bigint").alias("kid"), F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"), "sizes")
        merged = kids.select(F.col("above").alias("path"), "conv_id", "n_convs", F.lit(1).cast("bigint").alias("kid"), "n_leaves", "saved_tokens", "sizes").unionByName(stop)
        last = F.coalesce(F.try_element_at("sizes", F.lit(-1)), F.lit(0)) if d else F.lit(0)
        merged = merged.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("kid").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.any_value("sizes").alias("sizes"))
        merged = merged.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1).cast("bigint"))).withColumn("saved_tokens", (F.col("saved_tokens") + (F.col("n_convs") - 1) * last).cast("bigint"))
        none = F.lit(hashlib.sha256(b"").hexdigest())
        here = written(merged.join(_ends(ended[d]), "path", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "depth")
        parents = here.select(F.col("path").alias("above"), F.col("conv_id").alias("parent"))
        joined = kids.drop("parent_conv_id", "sizes").join(parents, "above").withColumnRenamed("parent", "parent_conv_id")
        out = out.unionByName(joined.drop("above"))
        above = F.substring("path", F.lit(1), F.lit(max(d - 1, 0) * KEY))
        below = here.select("conv_id", F.lit(d).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", above.alias("above"), F.slice("sizes", F.lit(1), F.lit(max(d - 1, 0))).alias("sizes"))
    return out.unionByName(below.drop("above", "sizes"))
