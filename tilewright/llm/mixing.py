"""Operator 10, mixing sources to target weights by hierarchical budgets.

Documents hang in a tree (domain, language, source).  A budget of tokens starts at the root and is shared by
weight among the children of each node, level by level.  A node can take no more than its leaves hold (times
the epochs allowed); what a node cannot take goes to its siblings first, by their weights, and
only what all siblings together cannot take is missing at their parent, whose own siblings have taken it
before, since a node's capacity is the sum of its leaves'.  Each share is the water level of its siblings,
found with window functions over the aggregated tree.

A leaf with budget b takes whole epochs of its documents and the shortest prefix, in the last epoch's seeded
order, that reaches the rest of b (the last document is whole).  The order is by MD5 of seed, epoch and id.
Prefix sums are cut by the first digits of the hash, as many as the leaf needs, so a leaf with a third of all rows is no hot task.
Target weights are a table of (level, node, weight); nodes that it does not name weigh alike.

A token is a word ``[^\\x20\\x09-\\x0D]+``.  Defined cases: null languages and sources are nodes named "?"; a document
without words, or with a null id, is not chosen; rows with a repeated id are chosen in the order of their text hash; ties of
the order are broken by id; a weight of 0 takes nothing; with an empty table nothing is chosen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import steps, words, written

TREE = ("domain", "lang", "source")
#: Weights (level, node, weight) where the user gives none; node "*" is any other of the level, and weighs 1 if it is not given.
WEIGHTS = (("lang", "en", 0.4), ("lang", "de", 0.2), ("lang", "fr", 0.2), ("lang", "es", 0.2), ("lang", "*", 0.1))
#: Documents of a leaf that one part of its order has, about.
PART_ROWS = 512
SEED = "7"


def domain() -> Column:
    """The domain of a source where the user gives none: its number modulo 4."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.regexp_extract("source", r"(\d{1,9})$", 1), F.lit("999999999")).cast("bigint") % 4, F.lit(0)).cast("string"))


def weight_table(spark: SparkSession, weights=WEIGHTS) -> DataFrame:
    """Target weights as a table (level, node, weight)."""
    return spark.createDataFrame(list(weights), "level string, node string, weight double")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_: Column | None = None) -> DataFrame:
    """Rows (doc_id, v, domain, lang, source, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in steps(batches):
            _, _, rows = words(data, offsets)
            count = np.bincount(rows, minlength=len(part)) if len(rows) else np.zeros(len(part), np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(count.astype(np.int64))], ["doc_id", "v", *TREE, "tokens"])

    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("v"), F.coalesce(domain() if domain_ is None else domain_, F.lit("d0")).alias("domain"), F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, v bigint, domain string, lang string, source string, tokens bigint").where("tokens > 0 and doc_id is not null")


def shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Add ``alloc``: the share of the parent's ``budget`` of each node with weight ``w`` and capacity ``cap``.

    Sorted by cap / w, the nodes that are filled are a prefix; the others get w times the level.
    """
    order = Window.partitionBy(*parent).orderBy("r", name)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent)
    nodes = nodes.where("w > 0").withColumn("r", F.col("cap") / F.col("w"))
    nodes = nodes.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    nodes = nodes.withColumn("full", F.col("r") <= F.col("level"))
    nodes = nodes.withColumn("rest", F.min(F.when(~F.col("full"), F.struct("r", name, "level"))).over(whole)["level"])
    return nodes.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.col("rest"))).drop("r", "level", "full", "rest")


def weighted(nodes: DataFrame, level: str, weights: DataFrame) -> DataFrame:
    """Nodes with their weight ``w``."""
    mine = weights.where(F.col("level") == level)
    own = mine.where("node <> '*'").groupBy(F.col("node").alias(level)).agg(F.max("weight").alias("_own"))
    other = mine.where("node = '*'").agg(F.max("weight").alias("_other"))  # one row
    return nodes.join(own, level, "left").crossJoin(F.broadcast(other)).withColumn("w", F.coalesce("_own", "_other", F.lit(1.0))).drop("_own", "_other")


def budgets(sizes: DataFrame, share: float, epochs: int, weights: DataFrame | None = None) -> DataFrame:
    """Rows (domain, lang, source, total, n, budget) of the leaves; budgets are whole tokens."""
    weights = weight_table(sizes.sparkSession) if weights is None else weights
    leaves = sizes.groupBy(*TREE).agg(F.sum("tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    leaves = leaves.withColumn("cap", (F.col("total") * epochs).cast("double"))
    leaves = written(leaves, "leaves")
    top = leaves.agg((F.floor(F.sum("total") * share)).cast("double").alias("budget"))
    up: DataFrame | None = None
    for depth, name in enumerate(TREE):
        keys = list(TREE[: depth + 1])
        nodes = weighted(leaves.groupBy(*keys).agg(F.sum("cap").alias("cap")), name, weights)
        # the root's budget is one row
        nodes = nodes.crossJoin(F.broadcast(top)) if up is None else nodes.join(up, keys[:-1])
        up = shared_out(nodes, keys[:-1], name).select(*keys, F.col("alloc").alias("budget"))
    return up.join(leaves, list(TREE)).select(*TREE, "total", "n", F.floor(F.col("budget") + 1e-6).alias("budget"))


def key(epoch: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat_ws("-", F.lit(seed), epoch.cast("string"), F.col("doc_id").cast("string")))


def chosen(sizes: DataFrame, share: float, epochs: int, seed: str = SEED, weights: DataFrame | None = None) -> DataFrame:
    """Rows (doc_id, v, tree, tokens, epoch, start): the documents taken, with the tokens before each in its epoch.

    A leaf's order is cut by the first digits of the hash into parts of about PART_ROWS documents, however large the leaf
    is; sums of parts add up inside groups of parts, and those in the leaf, so that no window holds more than their square roots.
    """
    # at most one row per leaf; Spark broadcasts it only if its file is small enough
    digits = F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") / PART_ROWS) / 4)).cast("int")
    leaves = written(budgets(sizes, share, epochs, weights).withColumn("digits", digits), "budgets")
    rows = sizes.join(leaves, list(TREE)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    rows = rows.withColumn("rest", F.col("budget") - F.col("epoch") * F.col("total")).where("rest > 0")
    rows = rows.withColumn("h", key(F.col("epoch"), seed)).withColumn("part", F.substr("h", F.lit(1), F.col("digits"))).withColumn("group", F.substr("h", F.lit(1), F.ceil(F.col("digits") / 2).cast("int")))
    leaf = [*TREE, "epoch"]
    parts = rows.groupBy(*leaf, "group", "part").agg(F.sum("tokens").alias("n"))
    groups = parts.groupBy(*leaf, "group").agg(F.sum("n").alias("m"))
    groups = groups.withColumn("before", F.sum("m").over(Window.partitionBy(*leaf).orderBy("group")) - F.col("m")).drop("m")
    parts = parts.withColumn("base", F.sum("n").over(Window.partitionBy(*leaf, "group").orderBy("part")) - F.col("n")).drop("n")
    parts = parts.join(groups, [*leaf, "group"]).select(*leaf, "part", (F.col("before") + F.col("base")).alias("base"))
    inside = Window.partitionBy(*leaf, "part").orderBy("h", "doc_id", "v").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, [*leaf, "part"]).withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    return rows.where("start < rest").select("doc_id", "v", *TREE, "tokens", "epoch", "start")


def mix(docs: DataFrame, share: float = 0.8, epochs: int = 2, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", weights: DataFrame | None = None, domain_: Column | None = None) -> DataFrame:
    """One row for each time that a document is taken: doc_id, domain, lang, source, tokens, epoch, start.

    ``weights`` is a table (level, node, weight) for the levels of TREE.
    """
    return chosen(written(sized(docs, id_col, text_col, domain_), "sizes"), share, epochs, seed, weights).drop("v")


def mixed_documents(docs: DataFrame, share: float = 0.8, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", weights: DataFrame | None = None, domain_: Column | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns, that one epoch takes."""
    taken = chosen(written(sized(docs, id_col, text_col, domain_), "sizes"), share, 1, seed, weights).select(F.col("doc_id").alias("taken_id"), F.col("v").alias("taken_v")).distinct()
    same = (F.col(id_col).cast("bigint") == F.col("taken_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("taken_v"))
    return docs.join(taken.hint("shuffle_hash"), same, "left_semi")
