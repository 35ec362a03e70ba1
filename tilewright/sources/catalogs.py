"""Catalogues of files and of landed JSON pages; label statistics out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from ..plans.iterate import written

EXTENSIONS = ("svs", "tif", "tiff", "mrxs", "ndpi", "vsi", "lif", "dcm", "jp2", "scn", "bif")


def supported(path, extensions: tuple[str, ...] = EXTENSIONS):
    return extension(path).isin(*extensions)


def numbered(paths: DataFrame) -> DataFrame:
    """(id, location, title) with ids from 0 in the order of the paths.

    Ids number a whole listing: paths are sorted by range and written, and counts of the written parts give the offsets.
    """
    part = paths.select("location").distinct().repartitionByRange("location").withColumn("p", F.spark_partition_id())
    part = written(part, "listing")  # the parts stay as they are, whatever plan reads them
    part = part.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("location")) - 1)
    sizes = part.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))  # a row for each part
    return part.join(before, "p").select((F.col("before") + F.col("r")).alias("id"), "location", base_name(F.col("location")).alias("title"))


def catalog_directory(spark: SparkSession, path: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Supported files directly in a folder; contents are not read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", False).load(path).select(F.col("path").alias("location"))
    return numbered(listed.where(supported(F.col("location"), extensions)))


def catalog_filelist(spark: SparkSession, list_path: str, known: DataFrame | None = None, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Supported files named in a text file, one a line; ``known`` (location) keeps those that exist."""
    listed = spark.read.text(list_path).select(F.trim("value").alias("location")).where(supported(F.col("location"), extensions))
    return numbered(listed.join(known, "location", "left_semi") if known is not None else listed)


def json_results(pages: DataFrame, fields: str, column: str = "page") -> DataFrame:
    """Records of landed pages: ``{count, next, results: [..]}``, a bare array, or one object."""
    c = F.trim(F.col(column))
    results = F.when(c.startswith("["), F.from_json(c, f"array<struct<{fields}>>")).when(F.get_json_object(c, "$.results").isNotNull(), F.from_json(F.get_json_object(c, "$.results"), f"array<struct<{fields}>>")).otherwise(F.array(F.from_json(c, f"struct<{fields}>")))
    return pages.select(F.explode(results).alias("r")).select("r.*")


def write_statistics(stats: DataFrame, path: str) -> None:
    """Label,CoGX,CoGY,Area as CSV with a header."""
    stats.select(F.col("label").alias("Label"), F.col("cog_x").alias("CoGX"), F.col("cog_y").alias("CoGY"), F.col("area").alias("Area")).where("Area > 0").write.mode("overwrite").option("header", True).csv(path)
