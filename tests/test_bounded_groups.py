"""Groups that are one string or one task stay bounded as the tables grow."""

from pyspark.sql import functions as F

from tilewright.plans import shape_queries, table_queries


def spied(monkeypatch, owner, name):
    """The first arguments that a function is called with."""
    seen, f = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda df, *a: (seen.append(df), f(df, *a))[1])
    return seen


def most(df, column, mark):
    return df.select(F.max(F.size(F.split(column, mark)) - 1)).first()[0]


def test_xml_files(spark, sf, monkeypatch):
    base = sf.replace("sf0.001", "sf0.01")
    seen = spied(monkeypatch, table_queries.xml, "imagescope")
    table_queries.q_imagescope(spark, base)
    assert most(seen[0], "xml", "<Region ") <= 50
    seen = spied(monkeypatch, table_queries.xml, "native")
    table_queries.q_xml_roundtrip(spark, base)
    assert most(seen[0], "xml", "<Annotation ") <= 50


def test_stitched_files(spark, sf, monkeypatch):
    seen = spied(monkeypatch, shape_queries.vector, "stitch_regions")
    shape_queries.q_stitch(spark, sf.replace("sf0.001", "sf0.01"))
    assert seen[0].groupBy("file").count().agg(F.max("count")).first()[0] <= 50


def test_worklists(spark, sf, monkeypatch):
    seen = spied(monkeypatch, table_queries.catalog, "worklist_items")
    table_queries.q_worklist_lists(spark, sf.replace("sf0.001", "sf0.1"))
    assert most(seen[0], "images", ",") < 4000
