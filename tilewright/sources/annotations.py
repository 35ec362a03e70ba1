"""Annotation files: native XML, ImageScope XML and NDPA in, native XML out.

Files are read whole (one file is one row) and parsed by Spark's ``from_xml`` with an explicit schema; attributes carry
the prefix ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import int_to_hex
from ..functions.geom import nm_to_pixel
from ..functions.text import base_name, extension
from ..operators.vector import accepted_files, stitch_regions
from ..plans.iterate import written

NATIVE = (
    "Annotations struct<Annotation:array<struct<_Name:string,_Type:string,_PartOfGroup:string,_Color:string,Coordinates:struct<Coordinate:array<struct<_Order:int,_X:double,_Y:double>>>>>>, "
    "AnnotationGroups struct<Group:array<struct<_Name:string,_PartOfGroup:string,_Color:string,Attributes:struct<Attribute:array<struct<_Name:string,_Value:string>>>>>>"
)
IMAGESCOPE = "Annotation array<struct<_Id:int,_Name:string,_LineColor:bigint,Regions:struct<Region:array<struct<_Id:int,_Text:string,Vertices:struct<Vertex:array<struct<_X:double,_Y:double>>>>>>>>"
NDPA = "ndpviewstate array<struct<_id:int,title:string,annotation:struct<_type:string,_color:string,pointlist:struct<point:array<struct<x:double,y:double>>>>>>"
READERS = {"native": NATIVE, "imagescope": IMAGESCOPE, "ndpa": NDPA}
COORDS = "array<struct<ord:int,x:double,y:double>>"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, slide_id, ext, xml) of whole files."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("xml"))
    return raw.select("file", base_name(F.col("file")).alias("slide_id"), extension(F.col("file")).alias("ext"), "xml")


def _points(array, order=None, x="_X", y="_Y"):
    """Points in the order of an attribute, or as listed."""
    made = F.transform(array, lambda p, i: F.struct((p[order] if order else i).cast("int").alias("ord"), p[x].alias("x"), p[y].alias("y")))
    return F.array_sort(made).cast(COORDS)


def _document(raw: DataFrame, kind: str) -> Column:
    """What a file holds, as read by :func:`documents` before, or from its XML."""
    return F.col(kind) if kind in raw.columns else F.from_xml("xml", READERS[kind])


def documents(raw: DataFrame) -> DataFrame:
    """Files with their kind, each read once by the reader of its kind and written: (file, slide_id, kind, native, imagescope, ndpa)."""
    read = (F.when(F.col("kind") == kind, F.from_xml("xml", schema)).alias(kind) for kind, schema in READERS.items())
    return written(kind_of(raw).select("file", "slide_id", "kind", *read), "documents")


def native(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) of native XML; a file that names an unknown group is rejected whole."""
    doc = raw.select("slide_id", _document(raw, "native").alias("d"))
    anns = doc.select("slide_id", F.posexplode("d.Annotations.Annotation").alias("ord", "a"))
    anns = anns.select("slide_id", "ord", F.col("a._Name").alias("name"), F.col("a._Type").alias("type"), F.col("a._PartOfGroup").alias("group_name"), F.col("a._Color").alias("color"), _points(F.col("a.Coordinates.Coordinate"), "_Order").alias("coords"))
    groups = doc.select("slide_id", F.explode("d.AnnotationGroups.Group").alias("g"))
    attributes = F.map_from_entries(F.transform(F.coalesce(F.col("g.Attributes.Attribute"), F.array().cast("array<struct<_Name:string,_Value:string>>")), lambda e: F.struct(e["_Name"], e["_Value"])))
    groups = groups.select("slide_id", F.col("g._Name").alias("name"), F.nullif(F.col("g._PartOfGroup"), F.lit("None")).alias("parent_name"), F.col("g._Color").alias("color"), attributes.alias("attributes"))
    return accepted_files(anns, groups), groups


def imagescope(raw: DataFrame) -> DataFrame:
    """Regions (file, group_name, color, ord, name, coords) of ImageScope XML, for ``stitch_regions``."""
    doc = raw.select("file", "slide_id", F.posexplode(_document(raw, "imagescope")["Annotation"]).alias("pos", "a"))
    out = doc.select("file", "slide_id", "pos", F.coalesce(F.nullif(F.col("a._Name"), F.lit("")), F.concat(F.lit("Annotation "), F.col("a._Id"))).alias("group_name"), int_to_hex(F.col("a._LineColor")).alias("color"), F.posexplode("a.Regions.Region").alias("ord", "r"))
    return out.select("file", "slide_id", "pos", "group_name", "color", "ord", F.coalesce("r._Text", F.lit("")).alias("name"), _points(F.col("r.Vertices.Vertex")).alias("coords"))


def ndpa(raw: DataFrame, slides: DataFrame) -> DataFrame:
    """Freehand annotations in pixels; slides: slide_id, offset_x, offset_y (nm), mpp_x, mpp_y, width, height."""
    doc = raw.select("slide_id", F.posexplode(_document(raw, "ndpa")["ndpviewstate"]).alias("pos", "v")).where("v.annotation._type = 'freehand'")
    doc = doc.withColumn("ord", F.row_number().over(Window.partitionBy("slide_id").orderBy("pos")) - 1).join(slides, "slide_id")
    c = F.col
    points = F.transform(c("v.annotation.pointlist.point"), lambda p, i: F.struct(i.cast("int").alias("ord"), nm_to_pixel(p["x"], c("offset_x"), c("mpp_x"), c("width")).alias("x"), nm_to_pixel(p["y"], c("offset_y"), c("mpp_y"), c("height")).alias("y")))
    return doc.select("slide_id", "ord", F.concat_ws("_", "v.title", "ord").alias("name"), F.lit("Polygon").alias("type"), F.lit(None).cast("string").alias("group_name"), c("v.annotation._color").alias("color"), points.cast(COORDS).alias("coords"))


def kind_of(raw: DataFrame) -> DataFrame:
    """Files with ``kind``: native, imagescope or ndpa, by extension and root element.

    XML whose root is ``Annotations`` is ImageScope's, unless it holds coordinates or groups of the native form.
    """
    body = F.regexp_replace("xml", r"(?s)<[?!].*?>", "")
    root = F.regexp_extract(body, r"<([A-Za-z_][\w.-]*)", 1)
    native_parts = F.col("xml").contains("<Coordinate") | F.col("xml").contains("<AnnotationGroups")
    kind = F.when(F.col("ext") == "ndpa", "ndpa").when((F.col("ext") == "xml") & (root == "Annotations") & ~native_parts, "imagescope").when(F.col("ext") == "xml", "native")
    return raw.withColumn("root", root).withColumn("kind", kind)


def to_xml(annotations: DataFrame, groups: DataFrame) -> DataFrame:
    """(slide_id, xml): one native XML document per slide."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit(">"), F.lit("&gt;"))
    tag = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    none = lambda c: F.coalesce(c, F.lit("None"))
    points = F.array_join(F.transform("coords", lambda p, i: tag('<Coordinate Order="', i.cast("string"), '" X="', p["x"].cast("string"), '" Y="', p["y"].cast("string"), '"/>')), "")
    a = annotations.select("slide_id", "ord", tag('<Annotation Name="', esc(F.col("name")), '" Type="', esc(F.col("type")), '" PartOfGroup="', esc(none(F.col("group_name"))), '" Color="', esc(F.col("color")), '"><Coordinates>', points, "</Coordinates></Annotation>").alias("x"))
    a = a.groupBy("slide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "x"))), lambda s: s["x"]), "").alias("a"))
    attributes = F.array_join(F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: tag('<Attribute Name="', esc(e["key"]), '" Value="', esc(e["value"]), '"/>')), "")
    g = groups.select("slide_id", "name", tag('<Group Name="', esc(F.col("name")), '" PartOfGroup="', esc(none(F.col("parent_name"))), '" Color="', esc(F.col("color")), '"><Attributes>', attributes, "</Attributes></Group>").alias("x"))
    g = g.groupBy("slide_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "x"))), lambda s: s["x"]), "").alias("g"))
    both = a.join(g, "slide_id", "full")
    return both.select("slide_id", tag("<Root><Annotations>", F.coalesce("a", F.lit("")), "</Annotations><AnnotationGroups>", F.coalesce("g", F.lit("")), "</AnnotationGroups></Root>").alias("xml"))


def write_annotations(annotations: DataFrame, groups: DataFrame, path: str) -> None:
    """XML documents, one line each, in a folder per slide."""
    to_xml(annotations, groups).write.mode("overwrite").partitionBy("slide_id").text(path)


LIST = ("slide_id", "ord", "name", "type", "group_name", "color", "coords")


def imagescope_list(raw: DataFrame, closing_distance: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) of ImageScope XML: open regions are stitched, each Annotation element is a group."""
    regions = imagescope(raw)
    groups = regions.groupBy("file", "slide_id", "group_name").agg(F.min("pos").alias("pos"), F.first("color").alias("color"))
    stitched = stitch_regions(regions.withColumn("ord", F.col("ord").cast("int")), closing_distance)
    joined = stitched.withColumnRenamed("ord", "place").join(groups, ["file", "group_name"])
    ord_ = F.row_number().over(Window.partitionBy("slide_id").orderBy("pos", "place")) - 1
    anns = joined.select("slide_id", ord_.alias("ord"), "name", F.lit("Polygon").alias("type"), "group_name", "color", "coords")
    none = F.lit(None).cast("string").alias("parent_name")
    return anns, groups.select("slide_id", F.col("group_name").alias("name"), none, "color", F.create_map().cast("map<string,string>").alias("attributes"))


def annotation_lists(raw: DataFrame, slides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) of files of all three kinds, each read by its own reader.

    NDPA coordinates need ``slides`` (see :func:`ndpa`); without it a file of that kind is an error, as is an unknown kind.
    """
    kinds = documents(raw)
    if kinds.where("kind is null" if slides is not None else "kind is null or kind = 'ndpa'").limit(1).count():
        raise ValueError("files of an unknown kind, or NDPA files without a table of slides")
    anns, groups = native(kinds.where("kind = 'native'"))
    more, their_groups = imagescope_list(kinds.where("kind = 'imagescope'"))
    anns, groups = anns.select(*LIST).unionByName(more.select(*LIST)), groups.unionByName(their_groups)
    if slides is not None:
        anns = anns.unionByName(ndpa(kinds.where("kind = 'ndpa'"), slides).select(*LIST))
    return anns, groups


def read_annotations(spark: SparkSession, path: str, slides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(annotations, groups) of all annotation files of a folder."""
    return annotation_lists(files(spark, path), slides)
