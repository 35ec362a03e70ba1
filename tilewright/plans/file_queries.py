"""Queries that write files and read them back, and on small expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import geom, text
from ..operators import raster, vector
from ..sources import annotations, catalogs
from . import fixtures as fx
from .fixtures import LABELLED, MOSAICS
from .iterate import scratch

B = "bigint"


def _folder(s, name: str) -> str:
    return f"{scratch(s)}/{name}-{uuid.uuid4().hex}"


def q_lines(s, d):
    """Distances of points to the line and to the ray through the first edge of a polygon."""
    e = vector.edges(fx.polygons(s, d), "slide_id").where("i = 0")
    p = fx.table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 97 + 1).alias("ann_id"), (F.col("p_partkey") * 31 % 101).cast("double").alias("x"), (F.col("p_partkey") * 17 % 103).cast("double").alias("y"))
    at = [F.col(c) for c in ("ax", "ay", "bx", "by", "x", "y")]
    return p.join(e, "ann_id").select("p_partkey", F.round(geom.line_dist2(*at), 5).alias("line"), F.round(geom.ray_dist2(*at), 5).alias("ray"), geom.is_left(*at).cast(B).alias("side"))


LINES = f"WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ann_id ORDER BY ord) AS r FROM (SELECT ann_id, ord, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM ({fx.CORNERS}) WINDOW w AS (PARTITION BY ann_id ORDER BY ord))) WHERE r = 1), p AS (SELECT p_partkey, p_partkey % 97 + 1 AS ann_id, p_partkey * 31 % 101 AS x, p_partkey * 17 % 103 AS y FROM part), t AS (SELECT *, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / CAST((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay) AS DOUBLE) AS t FROM p JOIN e USING (ann_id)) SELECT p_partkey, round((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by_ - ay)) ** 2, 5) AS line, round((x - ax - greatest(t, 0) * (bx - ax)) ** 2 + (y - ay - greatest(t, 0) * (by_ - ay)) ** 2, 5) AS ray, CAST((bx - ax) * (y - ay) - (x - ax) * (by_ - ay) AS BIGINT) AS side FROM t"


def q_measure_labels(s, d):
    """Lengths and areas as the labels of a viewer show them."""
    q = F.col("l_quantity")
    return fx.table(s, d, "lineitem").groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n")).select("n", geom.measure_text(q * 50).alias("length"), geom.area_text(q * q * 10000).alias("area"))


MEASURE_LABELS = "SELECT count(*) AS n, CASE WHEN l_quantity * 50 > 1000 THEN CAST(round(l_quantity * 50 / 1000, 2) AS VARCHAR) || ' mm' ELSE CAST(round(l_quantity * 50, 2) AS VARCHAR) || ' um' END AS length, CASE WHEN l_quantity * l_quantity * 10000 > 1e6 THEN CAST(round(l_quantity * l_quantity * 10000 / 1e6, 2) AS VARCHAR) || ' mm2' ELSE CAST(round(l_quantity * l_quantity * 10000, 2) AS VARCHAR) || ' um2' END AS area FROM lineitem GROUP BY l_quantity"


def q_strings(s, d):
    p = fx.table(s, d, "part")
    return p.select("p_partkey", text.lowered(F.col("p_brand")).alias("low"), text.raised(F.col("p_name")).alias("high"), text.replaced(F.col("p_type"), "E", "..").alias("dots"))


STRINGS = "SELECT p_partkey, lower(p_brand) AS low, upper(p_name) AS high, replace(p_type, 'E', '..') AS dots FROM part"

_LISTED = "CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE '' END || 'slides/' || p_brand || '/' || p_partkey || (CASE p_partkey % 4 WHEN 0 THEN '.svs' WHEN 1 THEN '.TIF' WHEN 2 THEN '.txt' ELSE '.mrxs' END)"


def q_filelist(s, d):
    """A list of files, one a line; kept are those of a known extension that exist."""
    p = fx.table(s, d, "part")
    path = _folder(s, "list")
    p.select(F.expr(_LISTED).alias("value")).write.text(path)
    known = p.where("p_partkey % 3 <> 1").select(F.trim(F.expr(_LISTED)).alias("location"))
    return catalogs.catalog_filelist(s, path, known)


FILELIST = f"SELECT row_number() OVER (ORDER BY location) - 1 AS id, location, regexp_replace(split_part(location, '/', 3), '\\.[^.]*$', '') AS title FROM (SELECT DISTINCT trim({_LISTED}) AS location FROM part WHERE p_partkey % 3 <> 1) WHERE location NOT LIKE '%.txt'"


def q_directory(s, d):
    """The files of a folder, of which there is one for each part that was written."""
    path = _folder(s, "folder")
    fx.table(s, d, "orders").select("o_orderkey", "o_orderpriority").repartitionByRange(7, "o_orderkey").select(F.col("o_orderpriority").alias("value")).write.text(path)
    found = catalogs.catalog_directory(s, path, ("txt",))
    return found.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.countDistinct("title").alias("titles"))


def q_statistics_csv(s, d):
    path = _folder(s, "statistics")
    catalogs.write_statistics(raster.label_statistics(fx.labelled(s, d)), path)
    back = s.read.option("header", True).csv(path)
    return back.select(F.col("Label").cast(B).alias("label"), F.round(F.col("CoGX").cast("double"), 6).alias("cog_x"), F.round(F.col("CoGY").cast("double"), 6).alias("cog_y"), F.col("Area").cast(B).alias("area"))


def q_detections(s, d):
    """Detections of each slide as one set of points, written as XML and read again."""
    px = raster.to_pixels(fx.mosaics(s, d).drop("vec_id")).where("value > 300 and c = 1").select("slide_id", "x", "y").distinct()
    sets = vector.points_to_annotation(px)
    ring = F.transform("coords", lambda p, i: F.struct(i.cast("int").alias("ord"), p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    made = sets.select("slide_id", F.lit(0).alias("ord"), "name", "type", F.lit(None).cast("string").alias("group_name"), F.lit("#F4FA58").alias("color"), ring.alias("coords"))
    groups = s.createDataFrame([], "slide_id string, name string, parent_name string, color string, attributes map<string,string>")
    xml = annotations.to_xml(made, groups)
    back = annotations.native(xml)[0]
    total = F.aggregate(F.transform("coords", lambda p, i: (i + 1) * (p["x"] * 1000 + p["y"])), F.lit(0.0), lambda a, v: a + v)
    return back.select("slide_id", "name", "type", F.size("coords").cast(B).alias("n"), total.alias("placed"))


DETECTIONS = f"WITH p AS (SELECT DISTINCT slide_id, x, y FROM ({MOSAICS}) WHERE value > 300 AND c = 1), r AS (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY x, y) AS i FROM p) SELECT slide_id, 'Detected nuclei' AS name, 'PointSet' AS type, count(*) AS n, CAST(sum(i * (x * 1000 + y)) AS DOUBLE) AS placed FROM r GROUP BY 1"


QUERIES = {
    "q_lines": (q_lines, LINES),
    "q_measure_labels": (q_measure_labels, MEASURE_LABELS),
    "q_strings": (q_strings, STRINGS),
    "q_filelist": (q_filelist, FILELIST),
    "q_directory": (q_directory, "SELECT CAST(7 AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(6 AS BIGINT) AS last, CAST(7 AS BIGINT) AS titles"),
    "q_statistics_csv": (q_statistics_csv, f"SELECT CAST(value AS BIGINT) AS label, round(avg(x), 6) AS cog_x, round(avg(y), 6) AS cog_y, count(*) AS area FROM ({LABELLED}) WHERE value > 0 GROUP BY slide_id, value"),
    "q_detections": (q_detections, DETECTIONS),
}
