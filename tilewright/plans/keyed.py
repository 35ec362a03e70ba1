"""Columns of a slide put on its many rows, without one task for a slide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Into how many parts the rows of a slide are dealt when the smaller side is not broadcast.
PARTS = 32


def per_slide(rows: DataFrame, slides: DataFrame, how: str = "inner", on: tuple[str, ...] = ("slide_id",)) -> DataFrame:
    """``rows`` with the further columns of ``slides``, which has few rows for each key.

    Each row of ``slides`` is repeated for PARTS numbers and rows draw one by the hash of what they hold, so where Spark
    does not find ``slides`` small enough to broadcast, a slide with a third of all rows is spread over PARTS groups.
    """
    simple = [c for c in rows.columns if rows.schema[c].dataType.typeName() not in ("array", "map", "struct", "binary")]
    drawn = rows.withColumn("_part", F.pmod(F.xxhash64(*simple), F.lit(PARTS)).cast("int"))
    spread = slides.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return drawn.join(spread, [*on, "_part"], how).drop("_part")
