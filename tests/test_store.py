"""The maintained store against one that is written at once, and packed pyramids against arrays."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import packed, pyramid, raster, store
from tilewright.plans.keyed import per_slide
from tilewright.streaming import store as arrivals

TILES = "slide_id string, level int, tile_x bigint, tile_y bigint, tile_w int, tile_h int, n_channels int, samples array<double>"


def tile(slide, x, y, seed, channels=2, w=4, h=4):
    r = random.Random(seed)
    return (slide, 0, x, y, w, h, channels, [float(r.randrange(-50, 200)) for _ in range(w * h * channels)])


def state(spark, path):
    """Everything that readers of a store see."""
    levels = {(r.slide_id, r.level): (r.width, r.height, r.downsample) for r in store.read_levels(spark, path).collect()}
    slides = {(r.slide_id, r.c): (r.min_value, r.max_value, r.spacing_x, r.spacing_y) for r in store.read_slides(spark, path).collect()}
    tiles = {(r.slide_id, r.level, r.tile_x, r.tile_y): list(r.samples) for r in store.read_tiles(spark, path).collect()}
    return tiles, levels, slides


def expected(tiles, factor, levels, integer, interpolation):
    """Level by level in numpy: {(slide, level, x, y): samples}."""
    now = {(s, x, y): np.array(v).reshape(h, w, c) for s, _, x, y, w, h, c, v in tiles}
    out = {(s, 0, x, y): v for (s, x, y), v in now.items()}
    for level in range(1, levels + 1):
        up = {}
        for (s, x, y), v in now.items():
            h, w, c = v.shape
            small = v[::factor, ::factor] if interpolation == "nearest" else v.reshape(h // factor, factor, w // factor, factor, c).mean(axis=(1, 3))
            small = np.trunc(small) if integer and interpolation == "linear" else small
            into = up.setdefault((s, x // factor, y // factor), np.zeros_like(v))
            a, b = y % factor * (h // factor), x % factor * (w // factor)
            into[a : a + h // factor, b : b + w // factor] = small
        now = up
        out |= {(s, level, x, y): v for (s, x, y), v in up.items()}
    return out


@pytest.mark.parametrize("factor,interpolation,integer,stride", [(2, "linear", True, 1), (2, "linear", False, 4), (4, "nearest", False, 2)])
def test_pyramid_of_several_slides_and_channels(spark, factor, interpolation, integer, stride):
    r = random.Random(factor)
    tiles = [tile(s, x, y, (s, x, y).__repr__(), c) for s, n, c in (("a", 9, 2), ("b", 5, 1), ("c", 1, 3)) for x in range(n) for y in range(7) if r.random() < 0.5]
    df = spark.createDataFrame(tiles, TILES).repartition(4)
    sizes = pyramid.sizes_of(df)
    got = {(t.slide_id, t.level, t.tile_x, t.tile_y): np.array(t.samples) for t in pyramid.build_tile_pyramid(df, None, factor, 3, interpolation, integer, stride).collect()}
    width = {t.slide_id: (t.width, t.height) for t in sizes.collect()}
    want = {k: v for k, v in expected(tiles, factor, 3, integer, interpolation).items() if k[2] * 4 < width[k[0]][0] // factor ** k[1] and k[3] * 4 < width[k[0]][1] // factor ** k[1]}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k].ravel()) for k in want)


def test_level_count_follows_the_width(spark):
    got = {r.w: r.n for r in spark.createDataFrame([(w,) for w in (1, 600, 682, 683, 1024, 1025, 1365, 1366, 2048, 2731, 26112)], "w bigint").select("w", raster.level_count(F.col("w")).alias("n")).collect()}
    # halved until at most 1024; one step less if twice that width is nearer to 1024
    def rule(w):
        n, low = 1, w
        while low > 1024:
            low //= 2
            n += 1
        return n - (abs(1024 - low) > abs(1024 - 2 * low)) - 1

    assert got == {w: max(0, rule(w)) for w in got}


def test_retiling_cuts_tiles(spark):
    tiles = [tile("a", x, y, x * 7 + y, 3, 6, 5) for x in range(-1, 3) for y in range(2)]
    df = spark.createDataFrame(tiles, TILES)
    px = lambda t: {(r.slide_id, r.x, r.y, r.c): r.value for r in raster.to_pixels(t).collect()}
    before, again = px(df), px(packed.retiled(df, 7, -99.0))
    assert {k: v for k, v in again.items() if k in before} == before
    assert {v for k, v in again.items() if k not in before} == {-99.0}


def test_any_writes_equal_one_write(spark, tmp_path):
    r = random.Random(1)
    settings = {"max_levels": 3, "integer": True}
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    store.create(spark, many, **settings)
    last = {}
    for step in range(3):
        batch = {}
        for _ in range(r.randrange(3, 8)):
            s, x, y = r.choice(["007", "b c/d"]), r.randrange(12), r.randrange(9)
            batch[(s, x, y)] = tile(s, x, y, r.random())
        last |= batch
        assert store.upsert(spark.createDataFrame(list(batch.values()), TILES), many, batch=f"batch-{step}")
    # a batch that comes again changes nothing
    again = [tile(s, x, y, "other") for s, x, y in batch]
    assert not store.upsert(spark.createDataFrame(again, TILES), many, batch="batch-2")
    store.create(spark, one, **settings)
    store.upsert(spark.createDataFrame(list(last.values()), TILES), one)
    a, b = state(spark, many), state(spark, one)
    assert a == b
    want = expected(last.values(), 2, 3, True, "linear")
    assert all(a[0][k] == list(want[k].ravel()) for k in a[0]) and {k for k in want if k[1] == 0} <= a[0].keys()


def test_a_growing_slide_gets_new_levels(spark, tmp_path):
    """Without a fixed number of levels a wider slide has more; declared sizes hold."""
    path, whole = str(tmp_path / "s"), str(tmp_path / "w")
    slides = spark.createDataFrame([("d", 10, 8, 0.5, 0.25)], "slide_id string, width int, height int, spacing_x double, spacing_y double")
    first, second = [tile("g", 0, 0, 1, 1, 256, 256), tile("d", 0, 0, 2)], [tile("g", 11, 0, 3, 1, 256, 256), tile("d", 2, 1, 4)]
    store.create(spark, path)
    store.upsert(spark.createDataFrame(first, TILES), path, slides)
    assert {r.level for r in store.read_levels(spark, path).where("slide_id = 'g'").collect()} == {0}
    store.upsert(spark.createDataFrame(second, TILES), path)
    assert store.read_levels(spark, path).where("slide_id = 'g'").count() == 3
    assert store.read_levels(spark, path).where("slide_id = 'd' and width = 10 and height = 8").count() == 1
    assert {(r.c, r.spacing_x, r.spacing_y) for r in store.read_slides(spark, path).where("slide_id = 'd'").collect()} == {(0, 0.5, 0.25), (1, 0.5, 0.25)}
    store.create(spark, whole)
    store.upsert(spark.createDataFrame(first + second, TILES), whole, slides)
    assert state(spark, path) == state(spark, whole)


def test_only_touched_blocks_are_written(spark, tmp_path):
    path = str(tmp_path / "s")
    store.create(spark, path, max_levels=1)
    store.upsert(spark.createDataFrame([tile(s, x, 0, x) for s in "ab" for x in range(20)], TILES), path)
    files = lambda: {f.relative_to(path).as_posix() for f in (tmp_path / "s" / "tiles").rglob("*.parquet")}
    before = files()
    store.upsert(spark.createDataFrame([tile("a", 19, 0, "new")], TILES), path)
    gone = {f.rsplit("/", 1)[0] for f in before - files()}
    assert gone == {"tiles/slide_id=a/level=0/block=0_2", "tiles/slide_id=a/level=1/block=0_1"}
    assert not list((tmp_path / "s" / "staged").rglob("*.parquet"))


def test_a_committed_batch_is_published_by_the_next_call(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store.create(spark, path, max_levels=1)
    store.upsert(spark.createDataFrame([tile("a", 0, 0, 1)], TILES), path, batch="x")
    before = state(spark, path)
    # the writer is lost before its commit file: nothing has happened
    with monkeypatch.context() as m:
        m.setattr(store, "_put", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([tile("a", 1, 0, 2)], TILES), path, batch="y")
    assert state(spark, path) == before and store.finish(spark, path) == [] and not list((tmp_path / "s" / "staged").rglob("*.parquet"))
    # it is lost after it: the next call publishes
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert(spark.createDataFrame([tile("a", 1, 0, 2)], TILES), path, batch="y")
    assert state(spark, path) == before
    assert store.finish(spark, path) == ["y"] and store.committed(spark, path, "y")
    assert len(state(spark, path)[0]) == 3


def test_writes_that_are_refused(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError):
        store.create(spark, path, levels=3)
    store.create(spark, path, max_levels=1)
    with pytest.raises(Exception, match="level 0"):
        store.upsert(spark.createDataFrame([("a", 1, 0, 0, 2, 2, 1, [0.0] * 4)], TILES), path)
    with pytest.raises(Exception, match="do not divide"):
        store.upsert(spark.createDataFrame([("a", 0, 0, 0, 3, 3, 1, [0.0] * 9)], TILES), path)
    store.upsert(spark.createDataFrame([], TILES), path)
    assert state(spark, path) == ({}, {}, {})


def test_rows_of_a_slide_are_spread(spark):
    rows = spark.range(1000).select(F.lit("s").alias("slide_id"), "id")
    slides = spark.createDataFrame([("s", 5)], "slide_id string, width int")
    with_width = per_slide(rows, slides)
    assert with_width.columns == ["slide_id", "id", "width"] and with_width.count() == 1000


def test_streams_into_the_store_and_statistics(spark, tmp_path):
    """A batch that Spark hands over once more changes neither the store nor the sums."""
    path, sums = str(tmp_path / "s"), str(tmp_path / "labels")
    store.create(spark, path, max_levels=1)
    px = lambda rows: spark.createDataFrame(rows, "slide_id string, x bigint, y bigint, value int")
    count = arrivals.labels_into(sums)
    for number, rows in [(0, [("s", 1, 2, 3), ("s", 3, 4, 3)]), (1, [("s", 5, 0, 3), ("t", 1, 1, 0)]), (1, [("s", 5, 0, 3), ("t", 1, 1, 0)])]:
        count(px(rows), number)
    want = {("s", 3.0, 3.0, 2.0, 3)}
    assert {tuple(r) for r in arrivals.labels_so_far(spark, sums).collect()} == want
    assert arrivals.fold_labels(spark, sums) == 1
    count(px([("s", 1, 1, 7)]), 2)
    assert {tuple(r) for r in arrivals.labels_so_far(spark, sums).collect()} == want | {("s", 7.0, 1.0, 1.0, 1)}
    # a stream of files of tiles; its second run finds its batches committed
    spark.createDataFrame([tile("s", x, 0, x) for x in range(3)], TILES).write.parquet(str(tmp_path / "in"))

    def run(checkpoint):
        arriving = spark.readStream.schema(TILES).parquet(str(tmp_path / "in"))
        arriving.writeStream.foreachBatch(arrivals.tiles_into(path, "files")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return state(spark, path)

    first = run("one")
    assert {k for k in first[0] if k[1] == 0} == {("s", 0, x, 0) for x in range(3)}
    files = {f for f in (tmp_path / "s" / "tiles").rglob("*.parquet")}
    assert run("two") == first and files == {f for f in (tmp_path / "s" / "tiles").rglob("*.parquet")}
