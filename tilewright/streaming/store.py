"""Streams into a tile store and into label statistics, so that a batch that comes again changes nothing.

Spark hands a batch that was not confirmed to ``foreachBatch`` once more, with the same number.  The store keeps the names of
its batches with its commits.  Statistics are kept as sums per batch, in a folder that a repeated batch replaces; sums of different
batches add up, so they are merged when they are read, and folded into one table now and then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

Batch = Callable[[DataFrame, int], None]


def tiles_into(path: str, name: str = "stream") -> Batch:
    """For ``foreachBatch`` on a stream of base tiles: each batch is one committed write of the store; ``name`` tells streams apart."""

    def write(tiles: DataFrame, number: int) -> None:
        store.upsert(tiles, path, batch=f"{name}-{number}")

    return write


SUMS = "label double, n bigint, sx double, sy double"


def labels_into(path: str) -> Batch:
    """For ``foreachBatch`` on a stream of pixels (slide_id, x, y, value): each batch leaves its sums of every label above 0."""

    def write(pixels: DataFrame, number: int) -> None:
        sums = pixels.where("value > 0").groupBy("slide_id", F.col("value").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("sx"), F.sum(F.col("y").cast("double")).alias("sy"))
        sums.write.mode("overwrite").parquet(f"{path}/batches/{number:012d}")

    return write


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished folders inside one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName()) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _sums(spark: SparkSession, path: str, slide: str) -> tuple[DataFrame, int]:
    """The newest merged sums with those of later batches, and the number of the last batch."""
    merged, batches = _numbers(spark, f"{path}/merged"), _numbers(spark, f"{path}/batches")
    upto = merged[-1] if merged else -1
    later = [n for n in batches if n > upto]
    folders = [f"{path}/merged/{upto:012d}"] * bool(merged) + [f"{path}/batches/{n:012d}" for n in later]
    schema = f"slide_id {slide}, {SUMS}"
    return (spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)), max([upto, *later])


def labels_so_far(spark: SparkSession, path: str, slide: str = "string") -> DataFrame:
    """(slide_id, label, cog_x, cog_y, area) over all batches."""
    total = _sums(spark, path, slide)[0].groupBy("slide_id", "label").agg(F.sum("n").alias("area"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    return total.select("slide_id", "label", (F.col("sx") / F.col("area")).alias("cog_x"), (F.col("sy") / F.col("area")).alias("cog_y"), "area")


def fold_labels(spark: SparkSession, path: str, slide: str = "string") -> int:
    """Merge the sums of all batches into one table, which readers take from then on; the number of the last batch in it.

    Only for batches that the stream has confirmed: one that is repeated later is not read again.
    """
    sums, last = _sums(spark, path, slide)
    if last >= 0:
        sums.groupBy("slide_id", "label").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).write.mode("ignore").parquet(f"{path}/merged/{last:012d}")
    return last
