"""Slides, grids, polygons, series and catalogues as plain selections from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def side(spark: SparkSession, sf_dir: str) -> int:
    """Width and height of the grids: they grow with lineitem, at some four rows a cell."""
    return max(16, int((table(spark, sf_dir, "lineitem").count() / 4) ** 0.5))


SIDE = "(SELECT greatest(16, CAST(floor(sqrt(count(*) / 4.0)) AS BIGINT)) FROM lineitem)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse monochrome slides: (slide_id, x, y, value)."""
    li, n = table(spark, sf_dir, "lineitem"), side(spark, sf_dir)
    return li.groupBy(F.col("l_returnflag").alias("slide_id"), (F.col("l_orderkey") % n).alias("x"), (F.col("l_partkey") % n).alias("y")).agg(F.count(F.lit(1)).alias("value"))


GRID = f"SELECT l_returnflag AS slide_id, l_orderkey % {SIDE} AS x, l_partkey % {SIDE} AS y, count(*) AS value FROM lineitem GROUP BY 1, 2, 3"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, n = table(spark, sf_dir, "lineitem"), side(spark, sf_dir)
    return li.select(F.col("l_returnflag").alias("slide_id"), (F.col("l_orderkey") % n).alias("x"), (F.col("l_partkey") % n).alias("y"), F.col("l_linenumber").alias("value"))


LABELLED = f"SELECT l_returnflag AS slide_id, l_orderkey % {SIDE} AS x, l_partkey % {SIDE} AS y, l_linenumber AS value FROM lineitem"


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 5).cast("double").alias("r"), (255 - F.col("l_linenumber") * 20).cast("double").alias("g"), (F.floor("l_extendedprice") % 256).cast("double").alias("b"))


RGB = "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 5 AS DOUBLE) AS r, CAST(255 - l_linenumber * 20 AS DOUBLE) AS g, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS DOUBLE) AS b FROM lineitem"


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One float slide of 8 x 8 tiles, 25 tiles a row."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit("m").alias("slide_id"), F.lit(0).alias("level"), (F.col("vec_id") % 25).alias("tile_x"), F.expr("vec_id div 25").alias("tile_y"), F.lit(8).alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(1).alias("n_channels"), F.col("embedding").alias("samples"))


MOSAIC = "SELECT 'm' AS slide_id, vec_id % 25 * 8 + i % 8 AS x, vec_id // 25 * 8 + i // 8 AS y, CAST(embedding[i + 1] AS DOUBLE) AS value FROM embeddings, range(64) t(i)"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of two levels and two channels in 4 x 8 tiles; the second level is sparse and negative."""
    e = table(spark, sf_dir, "embeddings")
    at = e.select(F.concat(F.lit("s"), (F.col("label") % 2).cast("string")).alias("slide_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("level"), "vec_id", "embedding").where("level = 0 or vec_id % 4 = 0")
    samples = F.transform("embedding", lambda v: v.cast("double") * (1 - 2 * F.col("level")))
    return at.select("slide_id", "level", (F.col("vec_id") % 25).alias("tile_x"), F.expr("vec_id div 25").alias("tile_y"), F.lit(4).alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(2).alias("n_channels"), samples.alias("samples"))


LAYERS = "SELECT 's' || (label % 2) AS slide_id, CAST(l.i AS INT) AS level, vec_id % 25 * 4 + t.i // 2 % 4 AS x, vec_id // 25 * 8 + t.i // 8 AS y, t.i % 2 AS c, CAST(embedding[t.i + 1] AS DOUBLE) * (1 - 2 * l.i) AS value FROM embeddings, range(64) t(i), range(2) l(i) WHERE l.i = 0 OR vec_id % 4 = 0"


def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three slides of unequal size with two channels in 4 x 8 tiles, of which two thirds are absent: base level only."""
    e = table(spark, sf_dir, "embeddings")
    wide = 10 + 5 * (F.col("label") % 3)
    at = e.select(F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("slide_id"), F.lit(0).alias("level"), (F.col("vec_id") % wide).cast("bigint").alias("tile_x"), F.floor(F.col("vec_id") / wide).cast("bigint").alias("tile_y"), "vec_id", "embedding")
    return at.select("slide_id", "level", "tile_x", "tile_y", F.lit(4).alias("tile_w"), F.lit(8).alias("tile_h"), F.lit(2).alias("n_channels"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000).cast("double")).alias("samples"), "vec_id")


_WIDE = "(10 + 5 * (label % 3))"
MOSAICS = f"SELECT 'm' || (label % 3) AS slide_id, vec_id, vec_id % {_WIDE} * 4 + t.i // 2 % 4 AS x, vec_id // {_WIDE} * 8 + t.i // 8 AS y, t.i % 2 AS c, floor(CAST(embedding[t.i + 1] AS DOUBLE) * 1000) AS value FROM embeddings, range(64) t(i)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of suppliers: key, group, label, centre and half sizes."""
    s, n = table(spark, sf_dir, "supplier"), side(spark, sf_dir)
    slide = F.element_at(F.array(*(F.lit(x) for x in "ANR")), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return s.select(slide.alias("slide_id"), F.col("s_suppkey").alias("ann_id"), F.col("s_nationkey").cast("bigint").alias("nation"), (F.col("s_nationkey") + 1).cast("bigint").alias("label"), (F.col("s_suppkey") * 37 % n).alias("cx"), (F.col("s_suppkey") * 53 % n).alias("cy"), (3 + F.col("s_nationkey") % 9).cast("bigint").alias("hx"), (3 + F.col("s_suppkey") % 7).alias("hy"))


BOXES = f"SELECT substr('ANR', CAST(s_suppkey % 3 + 1 AS INT), 1) AS slide_id, s_suppkey AS ann_id, CAST(s_nationkey AS BIGINT) AS nation, CAST(s_nationkey + 1 AS BIGINT) AS label, s_suppkey * 37 % {SIDE} AS cx, s_suppkey * 53 % {SIDE} AS cy, CAST(3 + s_nationkey % 9 AS BIGINT) AS hx, 3 + s_suppkey % 7 AS hy FROM supplier"


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slide_id, ann_id, label, nation, coords): clockwise quads, dealt to the slides of the grid."""
    p = lambda x, y, i: F.struct(F.lit(i).alias("ord"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    c = F.col
    ring = F.array(p(c("cx") - c("hx"), c("cy") - c("hy"), 0), p(c("cx") + c("hx"), c("cy") - c("hy"), 1), p(c("cx") + c("hx") + 2, c("cy") + c("hy"), 2), p(c("cx") - c("hx"), c("cy") + c("hy"), 3))
    return boxes(spark, sf_dir).select("slide_id", "ann_id", "nation", "label", ring.alias("coords"))


CORNERS = f"SELECT slide_id, ann_id, nation, label, 0 AS ord, cx - hx AS x, cy - hy AS y FROM ({BOXES}) UNION ALL SELECT slide_id, ann_id, nation, label, 1, cx + hx, cy - hy FROM ({BOXES}) UNION ALL SELECT slide_id, ann_id, nation, label, 2, cx + hx + 2, cy + hy FROM ({BOXES}) UNION ALL SELECT slide_id, ann_id, nation, label, 3, cx - hx, cy + hy FROM ({BOXES})"


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of customers' orders: (ring, ord, x, y)."""
    o = table(spark, sf_dir, "orders")
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_custkey").alias("ring"), (F.row_number().over(w) - 1).alias("ord"), (F.col("o_orderkey") % 997).cast("double").alias("x"), (F.floor("o_totalprice") % 997).cast("double").alias("y"))


VERTICES = "SELECT o_custkey AS ring, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INT) AS ord, CAST(o_orderkey % 997 AS DOUBLE) AS x, CAST(CAST(floor(o_totalprice) AS BIGINT) % 997 AS DOUBLE) AS y FROM orders"


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vertices(spark, sf_dir).groupBy("ring").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("coords"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series of users: (user, ord, x seconds, y value)."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(w) - 1).alias("ord"), (F.unix_timestamp("ts") - F.lit(1704067200)).cast("double").alias("x"), F.col("value").alias("y"))


SERIES = "SELECT user_id AS key, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS ord, CAST(CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS DOUBLE) AS x, value AS y FROM events"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image instance headers from parts."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 10 == 0, "label").when(F.col("p_partkey") % 10 == 1, "overview").otherwise("volume")
    return p.select(F.col("p_brand").alias("study"), F.col("p_type").alias("series"), F.col("p_partkey").alias("instance"), (F.lit(1024) * F.pow(F.lit(2.0), F.col("p_size") % 4)).cast("bigint").alias("width"), (F.lit(768) * F.pow(F.lit(2.0), F.col("p_size") % 4)).cast("bigint").alias("height"), kind.alias("kind"))


HEADERS = "SELECT p_brand AS study, p_type AS series, p_partkey AS instance, CAST(1024 * pow(2, p_size % 4) AS BIGINT) AS width, CAST(768 * pow(2, p_size % 4) AS BIGINT) AS height, CASE WHEN p_partkey % 10 = 0 THEN 'label' WHEN p_partkey % 10 = 1 THEN 'overview' ELSE 'volume' END AS kind FROM part"
