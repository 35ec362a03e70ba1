from pyspark.sql import functions as F

from tilewright.operators import raster, vector
from tilewright.sources import annotations, catalogs
from tilewright.streaming import statistics

NATIVE = '<Root><Annotations><Annotation Name="a" Type="Polygon" PartOfGroup="{g}" Color="#F4FA58"><Coordinates><Coordinate Order="1" X="5" Y="6"/><Coordinate Order="0" X="3" Y="4"/></Coordinates></Annotation></Annotations><AnnotationGroups><Group Name="g" PartOfGroup="None" Color="#00ff00"><Attributes><Attribute Name="k" Value="v"/></Attributes></Group></AnnotationGroups></Root>'
NDPA = '<annotations><ndpviewstate id="1"><title>t</title><annotation type="freehand" color="#ff0000"><pointlist><point><x>1100</x><y>-900</y></point><point><x>100</x><y>100</y></point></pointlist></annotation></ndpviewstate><ndpviewstate id="2"><title>u</title><annotation type="pin" color="#ff0000"/></ndpviewstate></annotations>'


def test_native_files(spark, tmp_path):
    (tmp_path / "one.xml").write_text(NATIVE.format(g="g"))
    (tmp_path / "bad.xml").write_text(NATIVE.format(g="missing"))
    anns, groups = annotations.read_annotations(spark, str(tmp_path))
    rows = anns.collect()
    assert [(r.slide_id, r.name, [(p.ord, p.x, p.y) for p in r.coords]) for r in rows] == [("one", "a", [(0, 3.0, 4.0), (1, 5.0, 6.0)])]
    assert {(r.slide_id, r.name, r.parent_name, r.attributes["k"]) for r in groups.collect()} == {("one", "g", None, "v"), ("bad", "g", None, "v")}
    out = str(tmp_path / "out")
    annotations.write_annotations(anns, groups.where("slide_id = 'one'"), out)
    again = annotations.native(spark.read.text(out).select(F.col("slide_id"), F.col("value").alias("xml")))[0]
    assert again.select("name", "coords").collect() == anns.select("name", "coords").collect()


def test_ndpa(spark):
    raw = spark.createDataFrame([("s", NDPA)], "slide_id string, xml string")
    slides = spark.createDataFrame([("s", 100.0, 100.0, 0.5, 0.5, 200.0, 100.0)], "slide_id string, offset_x double, offset_y double, mpp_x double, mpp_y double, width double, height double")
    got = [(r.name, [(p.x, p.y) for p in r.coords]) for r in annotations.ndpa(raw, slides).collect()]
    assert got == [("t_0", [(102.0, 48.0), (100.0, 50.0)])]


def test_catalogues(spark, tmp_path):
    for n in ("b.svs", "a.tif", "c.txt"):
        (tmp_path / n).write_text("x")
    got = catalogs.catalog_directory(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r.id, r.title) for r in got] == [(0, "a"), (1, "b")]
    (tmp_path / "list.txt").write_text("/x/q.svs\n/x/p.svs\n/x/n.doc\n")
    known = spark.createDataFrame([("/x/q.svs",)], "location string")
    assert [r.title for r in catalogs.catalog_filelist(spark, str(tmp_path / "list.txt"), known).collect()] == ["q"]


def test_json_pages(spark):
    pages = spark.createDataFrame([('{"count":2,"next":null,"results":[{"id":1},{"id":2}]}',), ('[{"id":3}]',), ('{"id":4}',)], "page string")
    assert sorted(r.id for r in catalogs.json_results(pages, "id:bigint").collect()) == [1, 2, 3, 4]


def test_statistics_csv_and_detections(spark, tmp_path):
    px = spark.createDataFrame([("s", 1, 2, 3), ("s", 3, 2, 3), ("s", 0, 0, 0)], "slide_id string, x bigint, y bigint, value int")
    catalogs.write_statistics(raster.label_statistics(px), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].asDict() == {"Label": "3", "CoGX": "2.0", "CoGY": "2.0", "Area": "2"}
    assert vector.points_to_annotation(px.select("slide_id", "x", "y")).first().name == "Detected nuclei"


def test_running_statistics(spark, tmp_path):
    schema = "slide_id string, x bigint, y bigint, value int"
    src = str(tmp_path / "in")
    spark.createDataFrame([("s", 1, 1, 2), ("s", 3, 1, 2)], schema).write.parquet(src)
    stream = statistics.running_label_statistics(statistics.arriving_pixels(spark, src, schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    spark.createDataFrame([("s", 5, 1, 2)], schema).write.mode("append").parquet(src)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("again").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.label, r.cog_x, r.area) for r in spark.table("again").collect()] == [(2, 3.0, 3)]
