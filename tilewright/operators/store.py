"""A multi-resolution tile store that is kept up to date: tiles of all levels, level sizes, extremes of each channel.

Folders of a store: ``tiles`` (by slide, level and block of neighbouring tiles), ``levels`` (slide_id, level, width, height,
downsample), ``slides`` (slide_id, c, min_value, max_value, spacing_x, spacing_y) and ``outside`` (places of tiles beyond their level, which
readers leave out), all three by slide.

Writing base tiles is incremental.  At each level only the parents of changed tiles are computed again, from their changed
and their stored children; only blocks with changed tiles are written again; extremes come from those kept with each
base tile, without its samples.  A store after any writes holds what one write of all its tiles would give.

A batch is first written to a folder of its own, then named by a commit file, then published by replacing the blocks it
touches.  A write that ends before the commit file has no effect; one that ends later is published again by the next call
(:func:`finish`), which gives the same files.  A batch name that has been committed changes nothing, so streams
may repeat a batch.  One writer at a time; readers beside it may see a batch's blocks come one by one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.iterate import steps, written
from . import packed, pyramid
from .raster import level_count

#: About so many tiles along a side of a block near the origin; twice as many at each doubling of the distance from it,
#: up to BLOCK_SAMPLES in a block, so that slides of many small tiles have no folder for each few of them.
BLOCK, BLOCK_SAMPLES = 8, 1 << 22
#: Doublings after which tiles of one sample fill a block.
RINGS = 9

DEFAULTS = {"factor": 2, "max_levels": -1, "interpolation": "linear", "integer": False, "slide": "string"}


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    fs, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, _fs(spark, path)[1]):
        raise FileExistsError(path)


def _settings(spark: SparkSession, path: str) -> dict:
    fs, at = _fs(spark, f"{path}/settings.json")
    file = fs.open(at)
    text = bytes(file.readAllBytes()).decode()
    file.close()
    return json.loads(text)


def create(spark: SparkSession, path: str, **settings) -> None:
    """An empty store; settings are factor, max_levels, interpolation, integer and slide (the type of slide ids)."""
    unknown = set(settings) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    _put(spark, f"{path}/settings.json", json.dumps(DEFAULTS | settings | {"rings": True}))


def _schemas(slide: str) -> dict[str, str]:
    return {
        "tiles": f"slide_id {slide}, level int, block string, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, low array<double>, high array<double>, samples array<double>",
        "levels": f"slide_id {slide}, level int, width bigint, height bigint, downsample double, declared boolean",
        "slides": f"slide_id {slide}, c int, min_value double, max_value double, spacing_x double, spacing_y double",
        "outside": f"slide_id {slide}, level int, tile_x bigint, tile_y bigint",
    }


PARTS = {"tiles": ["slide_id", "level", "block"], "levels": ["slide_id"], "slides": ["slide_id"], "outside": ["slide_id"]}


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    fs, at = _fs(spark, f"{path}/{name}")
    return spark.read.schema(schema).parquet(f"{path}/{name}") if fs.exists(at) else spark.createDataFrame([], schema)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "levels", _schemas(_settings(spark, path)["slide"])["levels"]).drop("declared")


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "slides", _schemas(_settings(spark, path)["slide"])["slides"])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tiles of all levels (slide_id .. samples); filters on slide and level read their folders only."""
    schemas = _schemas(_settings(spark, path)["slide"])
    # a short list of files, so that Spark knows its size
    hidden = _table(spark, path, "outside", schemas["outside"]).where("level >= 0")
    return _table(spark, path, "tiles", schemas["tiles"]).select(*packed.KEYS, "samples").join(hidden, pyramid.PLACE, "left_anti")


def _side(factor: int) -> int:
    return factor * max(1, BLOCK // factor)


def _block(x: str | F.Column, y: str | F.Column, conf: dict):
    """The block of a tile, by its place and size; blocks are whole multiples of the factor, and lie in one ring around the origin.

    Stores without the setting ``rings`` were written with blocks of one size.
    """
    x, y, side = (F.col(x) if isinstance(x, str) else x), (F.col(y) if isinstance(y, str) else y), _side(conf["factor"])
    away = F.greatest(x, -1 - x, y, -1 - y)
    samples = F.col("tile_w").cast("bigint") * F.col("tile_h") * F.col("n_channels")
    ring = F.lit(0)
    for j in range(1, RINGS + 1 if conf.get("rings") else 1):
        ring += ((away >= BLOCK * side * 2 ** (j - 1)) & (samples * (side**2 * 4**j) <= BLOCK_SAMPLES)).cast("int")
    number = lambda c: F.floor(c / (side * F.pow(F.lit(2.0), ring))).cast("bigint").cast("string")
    return F.concat_ws("_", number(y), number(x), F.when(ring > 0, ring.cast("string")))


def _publish(spark: SparkSession, path: str, batch: str, slide: str) -> None:
    for name, schema in _schemas(slide).items():
        staged = spark.read.schema(schema).parquet(f"{path}/staged/{batch}/{name}")
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS[name]).parquet(f"{path}/{name}")
    fs, at = _fs(spark, f"{path}/commits/{batch}.staged")
    fs.rename(at, _fs(spark, f"{path}/commits/{batch}.done")[1])
    fs.delete(_fs(spark, f"{path}/staged/{batch}")[1], True)


def finish(spark: SparkSession, path: str) -> list[str]:
    """Publish batches that were committed but not published; what was staged without a commit is removed."""
    fs, at = _fs(spark, f"{path}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    open_ = sorted(n.removesuffix(".staged") for n in names if n.endswith(".staged"))
    for batch in open_:
        _publish(spark, path, batch, _settings(spark, path)["slide"])
    staged = _fs(spark, f"{path}/staged")[1]
    if fs.exists(staged):
        fs.delete(staged, True)
    return open_


def committed(spark: SparkSession, path: str, batch: str) -> bool:
    fs, at = _fs(spark, f"{path}/commits/{batch}.done")
    return fs.exists(at)


def _extremes(samples: F.Column, n: F.Column, pick) -> F.Column:
    """One extreme of each channel of packed samples."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda c: pick(F.filter(samples, lambda _, i: i % n == c)))


def _changes(base: DataFrame, stored: DataFrame, grown: DataFrame, conf: dict) -> Iterator[DataFrame]:
    """The changed tiles of all levels, written; up to pyramid.STRIDE levels at a time.

    grown: slide_id, _old (last level before, -1 for a new slide) and _new; above its old last level a slide has no tiles yet.
    """
    d, stride = conf["factor"], pyramid.STRIDE
    top = grown.agg(F.max("_new")).first()[0] or 0
    power = F.pow(F.lit(float(d)), F.col("_k"))
    up = lambda c: F.floor(F.col(c) / d).cast("bigint")
    place, size = ["slide_id", "level", "tile_x", "tile_y"], ["tile_w", "tile_h", "n_channels"]
    here = base
    yield base
    for start in range(0, top, stride):
        # all tiles above the changed ones, and above the last level of slides that get new levels
        last = stored.select(*place, *size).join(grown.where((F.col("_old") >= start) & (F.col("_old") < min(start + stride, top)) & (F.col("_old") < F.col("_new"))).select("slide_id", F.col("_old").alias("level")), ["slide_id", "level"], "left_semi")
        seeds = here.select(*place, *size).unionByName(last)
        above = seeds.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(start + stride) - F.col("level"))))
        above = above.select("slide_id", (F.col("level") + F.col("_k")).alias("level"), *(F.floor(F.col(c) / power).cast("bigint").alias(c) for c in ("tile_x", "tile_y")), *size).distinct()
        above = above.join(grown.select("slide_id", "_new"), "slide_id").where("level <= _new").drop("_new")
        # blocks are whole multiples of d, so the children of a tile lie in one block, which prunes folders
        wanted = above.select("slide_id", (F.col("level") - 1).alias("level"), F.col("tile_x").alias("_px"), F.col("tile_y").alias("_py"), *size).withColumn("block", _block(F.col("_px") * d, F.col("_py") * d, conf)).drop(*size)
        kept = stored.where(F.col("level").between(start, start + stride - 1)).withColumn("_px", up("tile_x")).withColumn("_py", up("tile_y")).join(wanted, ["slide_id", "level", "block", "_px", "_py"], "left_semi")
        kept = kept.join(grown.select("slide_id", "_old"), "slide_id").where("level <= _old")
        kept = kept.join(here.select(*place).unionByName(above.select(*place)), place, "left_anti")
        parts = pyramid.pieces(here.unionByName(kept.select(*packed.KEYS, "samples")), d, conf["interpolation"], conf["integer"])
        parts = parts.join(grown.select("slide_id", F.col("_new").alias("_n")), "slide_id").where("level <= _n")
        made = written(pyramid.stacked(parts, d, start, stride, conf["interpolation"], conf["integer"]), "changed")
        yield made
        here = made.where(F.col("level") == start + stride)


def upsert(tiles: DataFrame, path: str, slides: DataFrame | None = None, batch: str | None = None) -> bool:
    """Put base tiles (level 0) at their places; what it needs on its way is deleted at the end.  False if the batch had been committed before.

    slides: slide_id and any of width, height (else a slide is as large as its tiles span), spacing_x, spacing_y.  Of tiles for one place in one batch the one
    with the greater samples counts; all tiles of a slide have one size and one number of channels.
    """
    spark = tiles.sparkSession
    batch = batch or uuid.uuid4().hex
    finish(spark, path)
    if committed(spark, path, batch):
        return False
    with steps(spark):
        _stage(tiles, path, slides, f"{path}/staged/{batch}")
    _put(spark, f"{path}/commits/{batch}.staged", batch)
    _publish(spark, path, batch, _settings(spark, path)["slide"])
    return True


def _stage(tiles: DataFrame, path: str, slides: DataFrame | None, to: str) -> None:
    """Write the blocks, level sizes and extremes that a store gets by these tiles to a folder of their own."""
    spark, conf = tiles.sparkSession, _settings(tiles.sparkSession, path)
    schemas = _schemas(conf["slide"])
    only = F.when(F.col("level") != 0, F.raise_error(F.lit("only tiles of level 0 are written, the others are made from them"))).otherwise(F.col("level"))
    base = packed.keyed(tiles.withColumn("level", only).withColumn("slide_id", F.col("slide_id").cast(conf["slide"])))
    base = base.groupBy("slide_id", "level", "tile_x", "tile_y").agg(F.max(F.struct("tile_w", "tile_h", "n_channels", "samples")).alias("t")).select("slide_id", "level", "tile_x", "tile_y", "t.*")
    base = written(base, "base")
    stored = _table(spark, path, "tiles", schemas["tiles"])
    levels = _table(spark, path, "levels", schemas["levels"])
    extremes = _table(spark, path, "slides", schemas["slides"])

    # a declared size holds and grows with what is declared; else a slide grows with its tiles
    spans = pyramid.sizes_of(base)
    given = slides.withColumn("slide_id", F.col("slide_id").cast(conf["slide"])) if slides is not None else spark.createDataFrame([], f"slide_id {conf['slide']}")
    of = lambda c, kind: F.col(c).cast(kind) if c in given.columns else F.lit(None).cast(kind)
    given = given.select("slide_id", of("width", "bigint").alias("width"), of("height", "bigint").alias("height"), of("spacing_x", "double").alias("spacing_x"), of("spacing_y", "double").alias("spacing_y"))
    named = spans.select("slide_id").unionByName(given.select("slide_id")).distinct()
    none = F.lit(None).cast("bigint")
    every = spans.select("slide_id", F.lit(0).alias("of"), "width", "height", none.alias("level"), F.lit(False).alias("declared"))
    every = every.unionByName(given.select("slide_id", F.lit(1).alias("of"), "width", "height", none.alias("level"), F.lit(False).alias("declared")))
    every = every.unionByName(levels.join(named, "slide_id", "left_semi").select("slide_id", F.lit(2).alias("of"), "width", "height", F.col("level").cast("bigint").alias("level"), "declared"))
    most = lambda of_, c: F.max(F.when(F.col("of") == of_, F.col(c)))
    facts = every.groupBy("slide_id").agg(F.coalesce(F.max("declared"), F.lit(False)).alias("d"), F.coalesce(F.max("level"), F.lit(-1)).cast("int").alias("_old"), *(most(i, c).alias(f"{c}{i}") for i in range(3) for c in ("width", "height")))
    size = lambda c: F.coalesce(F.when(F.col(f"{c}1").isNotNull(), F.greatest(f"{c}1", F.when(F.col("d"), F.col(f"{c}2")))).when(F.col("d"), F.col(f"{c}2")).otherwise(F.greatest(f"{c}0", f"{c}2")), F.lit(0).cast("bigint"))
    sizes = written(facts.select("slide_id", size("width").alias("width"), size("height").alias("height"), "_old", (F.col("d") | F.col("width1").isNotNull()).alias("declared")), "sizes")
    grown = sizes.select("slide_id", "_old", level_count(F.col("width"), conf["factor"], conf["max_levels"]).alias("_new"))

    changed = None
    for one in _changes(base, stored, grown, conf):
        changed = one if changed is None else changed.unionByName(one)
    changed = changed.withColumn("block", _block("tile_x", "tile_y", conf))
    ends = lambda pick: F.when(F.col("level") == 0, _extremes(F.col("samples"), F.col("n_channels"), pick))
    columns = [c.split()[0] for c in schemas["tiles"].split(", ")]
    fresh = changed.withColumn("low", ends(F.array_min)).withColumn("high", ends(F.array_max)).select(*columns)
    places = changed.select("slide_id", "level", "block", "tile_x", "tile_y")
    blocks = places.select("slide_id", "level", "block").distinct()
    rest = stored.join(blocks, ["slide_id", "level", "block"], "left_semi").join(places, ["slide_id", "level", "block", "tile_x", "tile_y"], "left_anti").select(*columns)
    whole = fresh.unionByName(rest).repartition(*PARTS["tiles"]).sortWithinPartitions(*PARTS["tiles"], "tile_y", "tile_x")
    whole.write.mode("overwrite").partitionBy(*PARTS["tiles"]).parquet(f"{to}/tiles")

    table = pyramid.level_table(sizes, conf["factor"], conf["max_levels"]).join(sizes.select("slide_id", "declared"), "slide_id")
    table.write.mode("overwrite").partitionBy("slide_id").parquet(f"{to}/levels")

    # tiles of these slides that readers do not see, by their keys; a row of level -1 replaces the list of a slide that has none
    staged = spark.read.schema(schemas["tiles"]).parquet(f"{to}/tiles")
    keys = [*pyramid.PLACE, "tile_w", "tile_h"]
    whole = staged.select(*keys).unionByName(stored.join(named, "slide_id", "left_semi").join(blocks, ["slide_id", "level", "block"], "left_anti").select(*keys))
    none = named.select("slide_id", F.lit(-1).alias("level"), F.lit(0).cast("bigint").alias("tile_x"), F.lit(0).cast("bigint").alias("tile_y"))
    pyramid.outside(whole, table).unionByName(none).write.mode("overwrite").partitionBy("slide_id").parquet(f"{to}/outside")

    # the extremes that each base tile carries: those just staged, and those of blocks that stay
    new = staged.where("level = 0").select("slide_id", "low", "high")
    stay = stored.where("level = 0").join(named, "slide_id", "left_semi").join(blocks.where("level = 0").drop("level"), ["slide_id", "block"], "left_anti").select("slide_id", "low", "high")
    each = new.unionByName(stay).select("slide_id", F.posexplode(F.arrays_zip("low", "high")).alias("c", "e"))
    found = each.groupBy("slide_id", "c").agg(F.min("e.low").alias("min_value"), F.max("e.high").alias("max_value"))
    spacing = given.groupBy("slide_id").agg(F.max("spacing_x").alias("sx"), F.max("spacing_y").alias("sy"))
    old = extremes.join(named, "slide_id", "left_semi").groupBy("slide_id").agg(F.max("spacing_x").alias("ox"), F.max("spacing_y").alias("oy"))
    found = found.join(spacing, "slide_id", "left").join(old, "slide_id", "left")
    found = found.select("slide_id", "c", "min_value", "max_value", F.coalesce("sx", "ox").alias("spacing_x"), F.coalesce("sy", "oy").alias("spacing_y"))
    found.write.mode("overwrite").partitionBy("slide_id").parquet(f"{to}/slides")


def copy_image(tiles: DataFrame, path: str, size: int = 512, slides: DataFrame | None = None, spacing: tuple[float, float] | None = None, fill: float = 0.0, **settings) -> None:
    """A new store with all base tiles cut to ``size``, whatever their size was, and the levels above made from them.

    ``spacing`` overrides what ``slides`` (slide_id, [width, height, spacing_x, spacing_y]) say.
    """
    spark, base = tiles.sparkSession, tiles.where("level = 0")
    create(spark, path, slide=tiles.schema["slide_id"].dataType.simpleString(), **settings)
    about = slides if slides is not None else pyramid.sizes_of(base)
    if spacing is not None:
        about = about.withColumn("spacing_x", F.lit(float(spacing[0]))).withColumn("spacing_y", F.lit(float(spacing[1])))
    upsert(packed.retiled(base, size, fill), path, about)
