"""Label statistics and extremes of tiles as they arrive; both are sums, so they are kept incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_pixels(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """Pixel files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def running_label_statistics(pixels: DataFrame) -> DataFrame:
    """Centre of gravity and area of each label so far; for output mode update or complete."""
    return pixels.where("value > 0").groupBy("slide_id", F.col("value").alias("label")).agg(F.avg("x").alias("cog_x"), F.avg("y").alias("cog_y"), F.count(F.lit(1)).alias("area"))


def windowed_counts(events: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Rows by event-time window and key; rows later than the watermark are dropped by Spark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
