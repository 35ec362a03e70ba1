"""Files are read once, and regions that can't be stitched need no Python call for their file."""

from pyspark.sql import functions as F

from tilewright.operators import vector
from tilewright.sources import annotations

SCOPE = '<Annotations><Annotation Id="4" Name="" LineColor="255"><Regions><Region Id="1" Text="r"><Vertices><Vertex X="1" Y="2"/><Vertex X="99" Y="2"/></Vertices></Region></Regions></Annotation></Annotations>'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_read_once(spark):
    raw = spark.createDataFrame([(f"f{i}.xml", f"f{i}", "xml", SCOPE) for i in range(3)], "file string, slide_id string, ext string, xml string")
    anns, groups = annotations.annotation_lists(raw)
    both = plan(anns) + plan(groups)
    assert "from_xml" not in both and "xmltostructs" not in both.lower() and "FlatMapGroupsInPandas" not in both
    assert sorted((r.slide_id, r.name, r.group_name, len(r.coords)) for r in anns.collect()) == [(f"f{i}", "r", "Annotation 4", 2) for i in range(3)]


def test_stitching_with_and_without_partners(spark):
    rows = [("a", "g", 0, "x", [(7, 0.0, 0.0), (8, 50.0, 0.0)]), ("a", "g", 1, "y", [(0, 51.0, 0.0), (1, 0.0, 1.0)]), ("b", None, 0, "z", [(3, 0.0, 0.0), (5, 50.0, 0.0)]), ("b", None, 1, "closed", [(0, 9.0, 9.0)]), ("c", "g", 0, "", [])]
    df = spark.createDataFrame(rows, "file string, group_name string, ord int, name string, coords array<struct<ord:int,x:double,y:double>>")
    got = sorted((r.file, r.ord, r.name, [tuple(p) for p in r.coords]) for r in vector.stitch_regions(df, 5.0).collect())
    assert got == [("a", 0, "x", [(0, 0.0, 0.0), (1, 50.0, 0.0), (2, 51.0, 0.0), (3, 0.0, 1.0)]), ("b", 0, "z", [(0, 0.0, 0.0), (1, 50.0, 0.0)]), ("b", 1, "closed", [(0, 9.0, 9.0)]), ("c", 0, "", [])]
    assert vector.stitch_regions(df, 5.0).where(F.col("group_name").isNull()).count() == 2
