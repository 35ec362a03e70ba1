"""Stitching holds the ends of regions in a task, never their points, and joins them as a walk over whole regions does."""

import random

import pytest

from tilewright.operators import vector

SCHEMA = "file string, group_name string, ord int, name string, coords array<struct<ord:int,x:double,y:double>>"


def walked(regions, limit):
    far = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 > limit
    left, out = sorted(regions), []
    while left:
        ord_, name, p = left.pop(0)
        again = bool(p) and far(p[0], p[-1])
        while again:
            again = False
            for k, (_, other_name, q) in enumerate(left):
                if not q or not far(q[0], q[-1]):
                    continue
                if not far(p[-1], q[0]):
                    p = p + q
                elif not far(p[-1], q[-1]):
                    p = p + q[::-1]
                elif not far(p[0], q[-1]):
                    p = q + p
                elif not far(p[0], q[0]):
                    p = q[::-1] + p
                else:
                    continue
                name = name or other_name
                left.pop(k)
                again = far(p[0], p[-1])
                break
        out.append((ord_, name, tuple((i, *xy) for i, xy in enumerate(p))))
    return out


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_same_as_a_walk_over_regions(spark, small_batches):
    r = random.Random(4)
    groups = {}
    for f in range(12):
        for g in ("g", "", None):
            regions = [(i, r.choice(["", "", f"n{i}"]), [(float(r.randrange(60)), float(r.randrange(60))) for _ in range(r.randrange(6))]) for i in range(r.choice([1, 2, 9, 25]))]
            groups[str(f) if f else None, g] = regions
    rows = [(f, g, i, name, [(7 - k, *p) for k, p in enumerate(ps)]) for (f, g), regions in groups.items() for i, name, ps in regions]
    r.shuffle(rows)
    got = [(x.file, x.group_name, x.ord, x.name, tuple(tuple(p) for p in x.coords)) for x in vector.stitch_regions(spark.createDataFrame(rows, SCHEMA).repartition(3), 8.0).collect()]
    key = lambda x: tuple((y is not None, y) for y in x[:3])
    want = [(f, g, *out) for (f, g), regions in groups.items() for out in walked(regions, 64.0)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len(want) < len(rows) - 50


def test_missing_points_and_names(spark):
    rows = [("f", "g", 0, None, [(0, 0.0, 0.0), (1, 50.0, 0.0)]), ("f", "g", 1, None, None), ("f", "g", 2, "n", [(0, 51.0, 0.0), (1, 90.0, 0.0)]), ("f", "g", 3, "", []), ("f", "g", 3, "w", [(0, 91.0, 0.0), (1, 300.0, 0.0)])]
    got = {(r.ord, r.name): r.coords and [p.x for p in r.coords] for r in vector.stitch_regions(spark.createDataFrame(rows, SCHEMA), 5.0).collect()}
    assert got == {(0, "n"): [0.0, 50.0, 51.0, 90.0, 91.0, 300.0], (1, None): None, (3, ""): []}


def test_no_points_go_through_python(spark, monkeypatch):
    df = spark.createDataFrame([("f", "g", i, "", [(0, 10.0 * i, 0.0), (1, 10.0 * i + 9, 0.0)]) for i in range(4)], SCHEMA)
    seen, f = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **b: (seen.append(self.dtypes), f(self, *a, **b))[1])
    assert [len(r.coords) for r in vector.stitch_regions(df, 2.0).collect()] == [8]
    assert seen and all("array" not in kind for kinds in seen for _, kind in kinds)
