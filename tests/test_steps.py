"""What operators write on their way has an owner, who deletes it and nothing else."""

import threading
from pathlib import Path

from tilewright.operators import morph
from tilewright.plans.iterate import discard, scratch, steps, written


def files(spark):
    return {p for p in Path(scratch(spark).removeprefix("file://")).rglob("*.parquet")}


def test_an_operator_leaves_nothing_behind(spark):
    px = spark.createDataFrame([("s", x, y, 1.0) for x in range(9) for y in range(700) if x % 2 or y % 5 == 0], "slide_id string, x bigint, y bigint, value double")
    before = files(spark)
    with steps(spark) as folder:
        assert morph.connected_components(px).select("label").distinct().count() == 1
        assert len(files(spark)) > len(before)
        assert Path(folder.removeprefix("file://")).exists()
    assert files(spark) == before and not Path(folder.removeprefix("file://")).exists()


def test_owners_of_two_threads_keep_out_of_each_other(spark):
    ready, done, seen = threading.Event(), threading.Event(), []

    def long():
        with steps(spark):
            frame = written(spark.range(5).toDF("id"))
            ready.set()
            done.wait(60)
            seen.append(frame.count())

    thread = threading.Thread(target=long)
    thread.start()
    ready.wait(60)
    with steps(spark):
        written(spark.range(3).toDF("id"))
    done.set()
    thread.join()
    assert seen == [5]


def test_discard_takes_one_frame_only(spark):
    with steps(spark) as folder:
        a, b = written(spark.range(2).toDF("id")), written(spark.range(3).toDF("id"))
        discard(a)
        assert b.count() == 3 and len(list(Path(folder.removeprefix("file://")).iterdir())) == 1
