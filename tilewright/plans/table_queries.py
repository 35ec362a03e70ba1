"""Queries on catalogues, worklists, paths, texts and documents of records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import catalog, overlay
from ..sources import annotations as xml
from ..sources import catalogs
from ..streaming.statistics import windowed_counts
from . import fixtures as fx
from .fixtures import HEADERS, VERTICES

B = "bigint"


def _levels(s, d):
    return fx.table(s, d, "part").where("p_size % 4 >= 0").select(F.col("p_brand").alias("slide_id"), (F.col("p_size") % 6).alias("level"), F.pow(F.lit(2.0), F.col("p_size") % 6).alias("downsample")).distinct()


def q_best_level(s, d):
    req = fx.table(s, d, "part").select(F.col("p_brand").alias("slide_id"), F.col("p_partkey").alias("request"), (F.col("p_retailprice") % 40 / 1.7).alias("downsample"))
    return overlay.best_level(_levels(s, d), req).select("request", F.col("level").cast(B).alias("level"))


BEST = "WITH l AS (SELECT DISTINCT p_brand AS slide_id, p_size % 6 AS level, pow(2.0, p_size % 6) AS d FROM part), r AS (SELECT p_partkey AS request, p_brand, p_retailprice % 40 / 1.7::DOUBLE AS q FROM part), n AS (SELECT request, q, level, row_number() OVER (PARTITION BY request ORDER BY abs(d - q), level DESC) AS k FROM r JOIN l ON slide_id = p_brand) SELECT request, CAST(CASE WHEN q < 1 THEN 0 ELSE level END AS BIGINT) AS level FROM n WHERE k = 1"


def q_overlay(s, d):
    h = fx.headers(s, d)
    slides = h.groupBy(F.col("study").alias("slide_id")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    results = h.select(F.col("study").alias("slide_id"), F.col("instance").alias("result_id"), "width", (F.col("height") + F.when(F.col("instance") % 3 == 0, 1).otherwise(0)).alias("height"))
    return overlay.overlay(slides, results).select("slide_id", "result_id", F.col("scale").cast(B).alias("scale"), F.col("level_offset").cast(B).alias("level_offset"))


OVERLAY = f"WITH h AS ({HEADERS}), s AS (SELECT study, max(width) AS w, max(height) AS hh FROM h GROUP BY 1), r AS (SELECT study, instance, width AS rw, height + CASE WHEN instance % 3 = 0 THEN 1 ELSE 0 END AS rh FROM h) SELECT s.study AS slide_id, instance AS result_id, w // rw AS scale, CAST(round(log2(w // rw)) AS BIGINT) AS level_offset FROM s JOIN r ON r.study = s.study WHERE w % rw = 0 AND hh % rh = 0 AND w // rw = hh // rh"


def q_series(s, d):
    out = catalog.series_levels(fx.headers(s, d))
    return out.select("study", "series", F.col("level").cast(B).alias("level"), "instance", "width", "downsample")


SERIES_SQL = f"WITH v AS (SELECT * FROM ({HEADERS}) WHERE kind = 'volume'), b AS (SELECT study, series, max(width) AS base FROM v GROUP BY 1, 2), n AS (SELECT v.*, CAST(floor(base / CAST(width AS DOUBLE) + 0.5) AS BIGINT) AS downsample FROM v JOIN b ON b.study = v.study AND b.series = v.series) SELECT study, series, dense_rank() OVER (PARTITION BY study, series ORDER BY downsample) - 1 AS level, instance, width, downsample FROM n"


def q_frames(s, d):
    n = fx.table(s, d, "nation")
    levels = n.select(F.col("n_name").alias("slide_id"), (500 + F.col("n_nationkey") * 37).cast(B).alias("width"), (400 + F.col("n_regionkey") * 91).cast(B).alias("height"))
    pos = fx.table(s, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("slide_id"), (F.col("s_suppkey") % 4 * 128 + 1).alias("x"), (F.col("s_suppkey") % 3 * 128 + 1).alias("y"), F.col("s_suppkey").alias("frame"))
    pos = pos.groupBy("slide_id", "x", "y").agg(F.min("frame").alias("frame"))
    return catalog.frames(levels, pos, 128)


FRAMES = "WITH l AS (SELECT n_nationkey, n_name AS slide_id, 500 + n_nationkey * 37 AS w, 400 + n_regionkey * 91 AS h FROM nation), g AS (SELECT l.slide_id, n_nationkey, a.i AS col, b.i AS row FROM l, range(20) a(i), range(20) b(i) WHERE a.i < ceil(w / 128.0) AND b.i < ceil(h / 128.0)) SELECT slide_id, col, row, min(s_suppkey) AS frame FROM g LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 4 = col AND s_suppkey % 3 = row GROUP BY 1, 2, 3"


def q_series_parts(s, d):
    h = fx.headers(s, d).withColumn("source", F.when(F.col("instance") % 3 > 0, F.expr("instance div 7"))).withColumn("n_frames", F.col("instance") % 5 + 1)
    out = catalog.concatenated(h)
    return out.select("study", "series", "instance", "n_frames", "n_parts", "width")


PARTS = f"SELECT study, series, min(instance) AS instance, CAST(sum(instance % 5 + 1) AS BIGINT) AS n_frames, count(*) AS n_parts, arg_min(width, instance) AS width FROM ({HEADERS}) GROUP BY study, series, CASE WHEN instance % 3 > 0 THEN 's' || (instance // 7) ELSE 'i' || instance END"


def q_associated(s, d):
    return catalog.associated_images(fx.headers(s, d))


def _frame_levels(s, d):
    n = fx.table(s, d, "nation")
    return n.select(F.col("n_name").alias("slide_id"), (500 + F.col("n_nationkey") * 37).cast(B).alias("width"), (400 + F.col("n_regionkey") * 91).cast(B).alias("height"))


def q_full_frames(s, d):
    return catalog.full_frames(_frame_levels(s, d), 128)


FULL_FRAMES = "SELECT n_name AS slide_id, a.i AS col, b.i AS row, CAST(a.i + b.i * ceil((500 + n_nationkey * 37) / 128.0) AS BIGINT) AS frame FROM nation, range(20) a(i), range(20) b(i) WHERE a.i < ceil((500 + n_nationkey * 37) / 128.0) AND b.i < ceil((400 + n_regionkey * 91) / 128.0)"


def q_frame_samples(s, d):
    grid = q_frames(s, d)
    decoded = fx.table(s, d, "supplier").join(fx.table(s, d, "nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("n_name").alias("slide_id"), F.col("s_suppkey").alias("frame"), F.array(*(F.col("s_suppkey") % k for k in (3, 5, 7, 11))).alias("samples"))
    out = catalog.frame_samples(grid, decoded, 4)
    return out.select("slide_id", "col", "row", F.aggregate("samples", F.lit(0.0), lambda t, v: t + v).alias("total"))


def q_numbers(s, d):
    o = fx.table(s, d, "orders")
    listed = text.list_text(F.array(F.col("o_totalprice"), F.col("o_totalprice") / 3), ",", 1)
    return o.select("o_orderkey", text.number_text(F.col("o_totalprice"), 2).alias("fixed"), text.number_text(F.col("o_orderkey")).alias("plain"), listed.alias("listed"), F.round(text.number_text(F.col("o_totalprice") / 7, 3).cast("double"), 3).alias("back"), F.replace(F.lower("o_orderpriority"), F.lit("-"), F.lit("_")).alias("replaced"))


NUMBERS = "SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed, CAST(o_orderkey AS VARCHAR) AS plain, printf('%.1f', o_totalprice) || ',' || printf('%.1f', o_totalprice / 3) AS listed, CAST(printf('%.3f', o_totalprice / 7) AS DOUBLE) AS back, replace(lower(o_orderpriority), '-', '_') AS replaced FROM orders"


def q_annotation_files(s, d):
    # each ring is a file of its own: native, ImageScope or NDPA by its number
    point = lambda x, y: lambda p: F.concat(F.lit(x), p["x"].cast("string"), F.lit(y), p["y"].cast("string"))
    ring = fx.rings(s, d).where(F.size("coords") >= 3)
    name = F.col("ring").cast("string")
    body = lambda open_, x, y, end: F.array_join(F.transform("coords", lambda p, i: F.concat(F.format_string(open_, i), point(x, y)(p), F.lit(end))), "")
    native = F.concat(F.lit('<?xml version="1.0"?><Root><Annotations><Annotation Name="n'), name, F.lit('" Type="Polygon" PartOfGroup="None" Color="#F4FA58"><Coordinates>'), body('<Coordinate Order="%d" ', 'X="', '" Y="', '"/>'), F.lit("</Coordinates></Annotation></Annotations><AnnotationGroups></AnnotationGroups></Root>"))
    scope = F.concat(F.lit('<Annotations MicronsPerPixel="0.5"><Annotation Id="4" Name="" LineColor="255"><Regions><Region Id="1" Text="r'), name, F.lit('"><Vertices>'), body("<Vertex ", 'X="', '" Y="', '"/>'), F.lit("</Vertices></Region></Regions></Annotation></Annotations>"))
    nm = F.concat(F.lit('<annotations><ndpviewstate id="1"><title>t'), name, F.lit('</title><annotation type="freehand" color="#ff0000"><pointlist>'), body("<point>", "<x>", "</x><y>", "</y></point>"), F.lit("</pointlist></annotation></ndpviewstate></annotations>"))
    kind = F.col("ring") % 3
    raw = ring.select(F.concat(F.lit("f"), name, F.when(kind == 2, ".ndpa").otherwise(".xml")).alias("file"), F.concat(F.lit("f"), name).alias("slide_id"), F.when(kind == 2, "ndpa").otherwise("xml").alias("ext"), F.when(kind == 0, native).when(kind == 1, scope).otherwise(nm).alias("xml"))
    slides = raw.select("slide_id", *(F.lit(v).alias(n) for n, v in (("offset_x", 0.0), ("offset_y", 0.0), ("mpp_x", 0.25), ("mpp_y", 0.5), ("width", 1000.0), ("height", 2000.0))))
    anns, groups = xml.annotation_lists(raw, slides)
    out = anns.select("slide_id", "name", F.coalesce("group_name", F.lit("")).alias("group_name"), F.col("ord").cast(B).alias("ord"), F.size("coords").cast(B).alias("n"), F.round(F.aggregate("coords", F.lit(0.0), lambda t, p: t + p["x"] + 2 * p["y"]), 4).alias("total"))
    return out.join(groups.groupBy("slide_id").agg(F.count(F.lit(1)).alias("groups")), "slide_id", "left").withColumn("groups", F.coalesce("groups", F.lit(0).cast(B)))


ANNOTATION_FILES = f"WITH v AS ({VERTICES}), a AS (SELECT ring, count(*) AS n, sum(x) AS x, sum(y) AS y FROM v GROUP BY 1 HAVING count(*) >= 3) SELECT 'f' || ring AS slide_id, CASE ring % 3 WHEN 0 THEN 'n' || ring WHEN 1 THEN 'r' || ring ELSE 't' || ring || '_0' END AS name, CASE ring % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'Annotation 4' ELSE '' END AS group_name, CAST(0 AS BIGINT) AS ord, n, round(CASE WHEN ring % 3 < 2 THEN x + 2 * y ELSE x / 250.0 + n * 500 + 2 * (y / 500.0 + n * 1000) END, 4) AS total, CASE WHEN ring % 3 = 1 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS groups FROM a"


def q_extent(s, d):
    c = fx.table(s, d, "customer")
    t = c.select(F.col("c_mktsegment").alias("slide_id"), (F.col("c_nationkey") % 3).cast(B).alias("index"), (F.col("c_custkey") % 17).alias("tile_x"), (F.col("c_custkey") % 13).alias("tile_y"))
    return catalog.extents(t.where("tile_x + tile_y + index * 5 < 25"), 256)


EXTENT = 'WITH e AS (SELECT c_mktsegment AS slide_id, CAST(c_nationkey % 3 AS BIGINT) AS "index", (max(c_custkey % 17) + 1) * 256 AS width, (max(c_custkey % 13) + 1) * 256 AS height FROM customer WHERE c_custkey % 17 + c_custkey % 13 + c_nationkey % 3 * 5 < 25 GROUP BY 1, 2) SELECT slide_id, "index", width, height FROM (SELECT *, row_number() OVER (PARTITION BY slide_id ORDER BY width * height DESC, "index") AS r FROM e) WHERE r = 1'


def q_levels(s, d):
    c = fx.table(s, d, "customer")
    lv = c.select((F.col("c_custkey") % 300).cast("string").alias("slide_id"), F.expr("c_custkey div 300").alias("level"), (4000 - F.expr("c_custkey div 300") * 700 + F.col("c_nationkey") * 40).cast(B).alias("width"))
    return catalog.valid_levels(lv)


LEVELS = "WITH l AS (SELECT CAST(c_custkey % 300 AS VARCHAR) AS slide_id, c_custkey // 300 AS level, CAST(4000 - c_custkey // 300 * 700 + c_nationkey * 40 AS BIGINT) AS width FROM customer) SELECT * FROM l WHERE slide_id NOT IN (SELECT a.slide_id FROM l a JOIN l b ON a.slide_id = b.slide_id AND a.level < b.level AND NOT EXISTS (SELECT 1 FROM l m WHERE m.slide_id = a.slide_id AND m.level > a.level AND m.level < b.level) WHERE b.width >= a.width)"


def _images(s, d):
    o, c, n = (fx.table(s, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("o_orderkey").cast("string").alias("image_id"), F.col("c_custkey").alias("study_id"), F.col("c_nationkey").cast(B).alias("patient_id"), F.col("n_regionkey").cast(B).alias("region"))


def q_worklist_images(s, d):
    pick = fx.table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("study_id"))
    patients = fx.table(s, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").cast(B).alias("patient_id"))
    wl = fx.table(s, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").cast("string").alias("image_id"))
    return catalog.images_for(_images(s, d), pick, patients, wl).select("image_id", "study_id", "patient_id")


def _items(s, d):
    return fx.table(s, d, "orders").select(F.col("o_orderpriority").alias("worklist_id"), F.col("o_orderkey").cast("string").alias("image_id"))


def q_worklist_add(s, d):
    more = fx.table(s, d, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("new-"), F.col("l_returnflag")).alias("worklist_id"), F.col("l_orderkey").cast("string").alias("image_id"))
    return catalog.worklist_add(_items(s, d), more).groupBy("worklist_id").agg(F.count(F.lit(1)).alias("n"))


def q_worklist_remove(s, d):
    gone = fx.table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("worklist_id"), F.col("o_orderkey").cast("string").alias("image_id"))
    return catalog.worklist_remove(_items(s, d), gone)


def q_worklist_update(s, d):
    new = fx.table(s, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 7 = 0").select(F.col("o_orderpriority").alias("worklist_id"), F.col("o_orderkey").cast("string").alias("image_id"))
    return catalog.worklist_update(_items(s, d), new)


def q_worklist_lists(s, d):
    # a worklist is kept as lists of the images of 4,000 orders at most, so that no string grows with the table
    part = F.concat_ws("/", "worklist_id", F.expr("cast(image_id as bigint) div 4000"))
    lists = catalog.worklist_lists(_items(s, d).where("length(image_id) > 0").withColumn("worklist_id", part))
    back = catalog.worklist_items(lists).groupBy("worklist_id").agg(F.count(F.lit(1)).alias("back"))
    both = lists.select("worklist_id", F.length("images").alias("chars"), "n").join(back, "worklist_id")
    # the lists of a worklist are joined by commas
    whole = both.groupBy(F.split_part("worklist_id", F.lit("/"), F.lit(1)).alias("worklist_id"))
    return whole.agg((F.sum("chars") + F.count(F.lit(1)) - 1).alias("chars"), F.sum("n").alias("n"), F.sum("back").alias("back"))


def q_visibility(s, d):
    c = catalog.lower_names(fx.table(s, d, "customer").withColumnRenamed("c_name", "C_NAME"))
    c = catalog.require_columns(c, ["c_custkey", "c_name"])
    shown = catalog.visible(c, ["c_name", "c_custkey"])
    return catalog.appended(shown, shown.where("c_custkey < 10")).groupBy("c_name").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("c_custkey"))


def q_sidecar(s, d):
    p = fx.table(s, d, "pages")
    slides = p.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("path"))
    files = p.where("page_id % 2 = 0").select(F.concat(F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"\.[^./]*$", ""), F.lit("_map.xml")).alias("path"))
    return catalog.sidecars(slides, files, "_map").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


SIDECAR = "WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '\\.[^./]*$', '') AS path FROM pages) SELECT a.page_id, count(*) AS n FROM p a JOIN p b ON a.path = b.path AND b.page_id % 2 = 0 GROUP BY 1"


def q_path(s, d):
    u = F.col("url")
    return fx.table(s, d, "pages").select("page_id", text.directory(u).alias("dir"), text.file_name(u).alias("file"), text.base_name(u).alias("base"), text.extension(u).alias("ext"), text.lowest_directory(u).alias("lowest"), text.with_extension(u, "xml").alias("as_xml"), text.with_directory(u, F.lit("/data")).alias("moved"), text.matches(u, "*1*").alias("hit"))


PATH = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(url, '([^/]*)$', 1) AS file FROM pages), q AS (SELECT *, regexp_replace(file, '\.[^.]*$', '') AS base, lower(regexp_extract(file, '\.([^.]*)$', 1)) AS ext, regexp_extract(dir, '([^/]*)$', 1) AS lowest FROM p)
SELECT page_id, dir, file, base, ext, lowest, CASE WHEN dir = '' THEN '' ELSE dir || CASE WHEN dir LIKE '%/' THEN '' ELSE '/' END END || base || '.xml' AS as_xml, '/data/' || file AS moved, contains(file, '1') AS hit FROM q"""


def q_text(s, d):
    c = fx.table(s, d, "customer")
    v = F.concat(F.lit(" \t"), F.col("c_name"), F.lit(" & co;\n"))
    return c.select("c_custkey", text.trim_control(v).alias("trimmed"), text.escape_char(F.col("c_name"), "#").alias("escaped"), text.unescape_char(text.escape_char(F.col("c_name"), "#"), "#").alias("back"), F.size(text.split_regex(F.col("c_name"), "[#0]+")).cast(B).alias("parts"), text.padded_hex(F.col("c_custkey")).alias("hex"), F.element_at(text.parse_list(text.join_list(F.array("c_custkey", "c_nationkey")), "bigint"), 2).alias("second"), F.upper(F.lower("c_mktsegment")).alias("up"))


TEXT = r"""SELECT c_custkey, c_name || ' & co;' AS trimmed, replace(c_name, '#', '&#35;') AS escaped, c_name AS back, CAST(len(regexp_split_to_array(c_name, '[#0]+')) AS BIGINT) AS parts, '0x' || CASE WHEN length(to_hex(c_custkey)) < 4 THEN lpad(lower(to_hex(c_custkey)), 4, '0') ELSE lower(to_hex(c_custkey)) END AS hex, CAST(c_nationkey AS BIGINT) AS second, c_mktsegment AS up FROM customer"""


def q_json_pages(s, d):
    c = fx.table(s, d, "conversations")
    pages = c.groupBy("conv_id").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"), F.lit(None).cast("string").alias("next"), F.collect_list(F.struct("conv_id", "turn", "role")).alias("results"))).alias("page"))
    return catalogs.json_results(pages, "conv_id:bigint,turn:bigint,role:string")


def q_json_fields(s, d):
    e = fx.table(s, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("name"), F.array("user_id", "event_id").alias("ids"), F.lit(None).cast("string").alias("gone")), {"ignoreNullFields": "false"}).alias("j"))
    return e.select("event_id", *text.json_fields(F.col("j"), ["name", "ids", "gone"]))


def q_attrs(s, d):
    e = fx.table(s, d, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"), "event_type")
    return e.select("event_id", text.get_attribute(text.set_attribute(F.col("m"), "type", F.col("event_type")), "type").alias("type"), text.get_attribute(F.col("m"), "k").alias("k"))


def q_described(s, d):
    p = fx.table(s, d, "part").select("p_partkey", F.to_json(F.struct(F.struct(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("brand")).alias("POST")).alias("actions"))).alias("doc"))
    return p.select("p_partkey", F.array_join(text.described_columns(F.col("doc")), ",").alias("columns"))


def q_catalog(s, d):
    p = fx.table(s, d, "part").select(F.concat(F.lit("/slides/"), F.col("p_brand"), F.lit("/s"), F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.when(F.col("p_size") % 3 == 0, ".svs").when(F.col("p_size") % 3 == 1, ".TIF").otherwise(".txt")).alias("location"))
    return catalogs.numbered(p.where(catalogs.supported(F.col("location")))).select(F.col("id").cast(B).alias("id"), "location", "title")


CATALOG = "WITH p AS (SELECT '/slides/' || p_brand || '/s' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || CASE WHEN p_size % 3 = 0 THEN '.svs' WHEN p_size % 3 = 1 THEN '.TIF' ELSE '.txt' END AS location, 's' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS title, p_size FROM part) SELECT row_number() OVER (ORDER BY location) - 1 AS id, location, title FROM p WHERE p_size % 3 < 2"


def _bounded(key, size):
    """The number of the block of ``size`` keys in a row; the number of blocks grows with the table."""
    return F.expr(f"{key} div {size}")


def q_xml_roundtrip(s, d):
    # a slide's rings are spread over files of some 50, so that no file grows with the table
    rings = fx.rings(s, d).select(F.concat_ws("/", F.col("ring") % 10, _bounded("ring", 500)).alias("slide_id"), F.col("ring").cast("int").alias("ord"), F.concat(F.lit("a<"), F.col("ring").cast("string")).alias("name"), F.lit("Polygon").alias("type"), F.when(F.col("ring") % 3 == 0, "None").otherwise("g & h").alias("group_name"), F.lit("#F4FA58").alias("color"), "coords")
    groups = rings.select("slide_id").distinct().select("slide_id", F.lit("g & h").alias("name"), F.lit(None).cast("string").alias("parent_name"), F.lit("#00ff00").alias("color"), F.create_map(F.lit("k"), F.lit('v"1')).alias("attributes"))
    anns, read = xml.native(xml.to_xml(rings, groups))
    back = anns.select("slide_id", "name", "group_name", F.posexplode("coords").alias("pos", "p")).select("slide_id", "name", "group_name", F.col("p.ord").cast(B).alias("ord"), "p.x", "p.y")
    back = back.join(read.select("slide_id", F.element_at("attributes", "k").alias("k")), "slide_id")
    return back.withColumn("slide_id", F.split_part("slide_id", F.lit("/"), F.lit(1)))


XML = f"SELECT CAST(ring % 10 AS VARCHAR) AS slide_id, 'a<' || ring AS name, CASE WHEN ring % 3 = 0 THEN 'None' ELSE 'g & h' END AS group_name, CAST(ord AS BIGINT) AS ord, x, y, 'v\"1' AS k FROM ({VERTICES})"


def q_imagescope(s, d):
    v = fx.rings(s, d)
    point = lambda p: F.concat(F.lit('<Vertex X="'), p["x"].cast("string"), F.lit('" Y="'), p["y"].cast("string"), F.lit('"/>'))
    region = F.concat(F.lit('<Region Id="'), F.col("ring").cast("string"), F.lit('" Text="r"><Vertices>'), F.array_join(F.transform("coords", point), ""), F.lit("</Vertices></Region>"))
    # each f has one XML string for some 50 rings; the rows of an f are put together only as sums
    docs = v.select((F.col("ring") % 10).alias("f"), _bounded("ring", 500).alias("part"), region.alias("r")).groupBy("f", "part").agg(F.array_join(F.collect_list("r"), "").alias("r"))
    raw = docs.select(F.col("f").cast("string").alias("file"), F.col("f").cast("string").alias("slide_id"), F.concat(F.lit('<Annotations><Annotation Id="1" Name="tumour" LineColor="65280"><Regions>'), "r", F.lit("</Regions></Annotation></Annotations>")).alias("xml"))
    out = xml.imagescope(raw)
    return out.select("file", "group_name", "color", F.explode("coords").alias("p")).groupBy("file", "group_name", "color").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p.x"), 4).alias("x"), F.round(F.sum(F.col("p.y") * F.col("p.ord")), 4).alias("y"))


IMAGESCOPE = f"SELECT CAST(ring % 10 AS VARCHAR) AS file, 'tumour' AS group_name, '#00ff00' AS color, count(*) AS n, round(sum(x), 4) AS x, round(sum(y * ord), 4) AS y FROM ({VERTICES}) GROUP BY 1"


def q_windowed_counts(s, d):
    out = windowed_counts(fx.table(s, d, "events"), width="1 day")
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def q_running_levels(s, d):
    lv = overlay.running_level(_levels(s, d).withColumn("level", F.col("level").cast(B)))
    return lv.select("slide_id", "level", "step", F.row_number().over(Window.partitionBy("slide_id").orderBy("level")).cast(B).alias("k"))


QUERIES = {
    "q_best_level": (q_best_level, BEST),
    "q_overlay": (q_overlay, OVERLAY),
    "q_series": (q_series, SERIES_SQL),
    "q_frames": (q_frames, FRAMES),
    "q_series_parts": (q_series_parts, PARTS),
    "q_associated": (q_associated, f"SELECT study, series, kind, min(instance) AS instance FROM ({HEADERS}) WHERE kind <> 'volume' GROUP BY 1, 2, 3"),
    "q_full_frames": (q_full_frames, FULL_FRAMES),
    "q_frame_samples": (q_frame_samples, f"SELECT slide_id, col, row, CAST(CASE WHEN frame IS NULL THEN 1020 ELSE frame % 3 + frame % 5 + frame % 7 + frame % 11 END AS DOUBLE) AS total FROM ({FRAMES})"),
    "q_numbers": (q_numbers, NUMBERS),
    "q_annotation_files": (q_annotation_files, ANNOTATION_FILES),
    "q_extent": (q_extent, EXTENT),
    "q_levels": (q_levels, LEVELS),
    "q_worklist_images": (q_worklist_images, "SELECT CAST(o_orderkey AS VARCHAR) AS image_id, o_custkey AS study_id, CAST(c_nationkey AS BIGINT) AS patient_id FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 5000 AND n_regionkey < 3 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)"),
    "q_worklist_add": (q_worklist_add, "SELECT w AS worklist_id, count(*) AS n FROM (SELECT o_orderpriority AS w, o_orderkey AS i FROM orders UNION SELECT 'new-' || l_returnflag, l_orderkey FROM lineitem WHERE l_linenumber = 1) GROUP BY 1"),
    "q_worklist_remove": (q_worklist_remove, "SELECT o_orderpriority AS worklist_id, CAST(o_orderkey AS VARCHAR) AS image_id FROM orders WHERE o_orderstatus <> 'F'"),
    "q_worklist_update": (q_worklist_update, "SELECT o_orderpriority AS worklist_id, CAST(o_orderkey AS VARCHAR) AS image_id FROM orders WHERE o_orderpriority <> '1-URGENT' OR o_orderkey % 7 = 0"),
    "q_worklist_lists": (q_worklist_lists, "SELECT o_orderpriority AS worklist_id, CAST(sum(length(CAST(o_orderkey AS VARCHAR))) + count(*) - 1 AS BIGINT) AS chars, count(*) AS n, count(*) AS back FROM orders GROUP BY 1"),
    "q_visibility": (q_visibility, "SELECT c_name, CAST(CASE WHEN c_custkey < 10 THEN 2 ELSE 1 END AS BIGINT) AS n, c_custkey FROM customer"),
    "q_sidecar": (q_sidecar, SIDECAR),
    "q_path": (q_path, PATH),
    "q_text": (q_text, TEXT),
    "q_json_pages": (q_json_pages, "SELECT conv_id, turn, role FROM conversations"),
    "q_json_fields": (q_json_fields, "SELECT event_id, event_type AS name, user_id || ',' || event_id AS ids, '' AS gone FROM events"),
    "q_attrs": (q_attrs, "SELECT event_id, event_type AS type, json_extract_string(props, '$.k') AS k FROM events"),
    "q_described": (q_described, "SELECT p_partkey, 'size,brand' AS columns FROM part"),
    "q_catalog": (q_catalog, CATALOG),
    "q_xml_roundtrip": (q_xml_roundtrip, XML),
    "q_imagescope": (q_imagescope, IMAGESCOPE),
    "q_windowed_counts": (q_windowed_counts, "SELECT CAST(floor(epoch(ts) / 86400) * 86400 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "q_running_levels": (q_running_levels, "WITH l AS (SELECT DISTINCT p_brand AS slide_id, CAST(p_size % 6 AS BIGINT) AS level, pow(2.0, p_size % 6) AS d FROM part) SELECT slide_id, level, d / lag(d) OVER w AS step, row_number() OVER w AS k FROM l WINDOW w AS (PARTITION BY slide_id ORDER BY level)"),
}
