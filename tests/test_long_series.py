"""Series that are cut into parts, and segments solved in a task, against one pass over all points."""

import math
import random

import pytest

from tilewright.operators import simplify


def walk(seed, n):
    r = random.Random(seed)
    x, y, out = 0.0, 0.0, []
    for i in range(n):
        x += r.uniform(0, 1.5)
        y = 6 * math.sin(i / 40) + r.uniform(-1, 1) if i % 500 < 400 else y  # with flat stretches
        out.append((i, x, y))
    return out


SERIES = {"a": walk(1, 2600), "b": walk(2, 900), "c": walk(3, 2), "d": [(i, 0.0, 0.0) for i in range(1500)]}


def frame(spark):
    return spark.createDataFrame([(k, *p) for k, ps in SERIES.items() for p in ps], "key string, ord int, x double, y double").repartition(5)


@pytest.mark.parametrize("machine", [simplify.Radial(4.0), simplify.Perpendicular(1.2), simplify.Strip(1.5), simplify.Ray(1.5, 12.0), simplify.Ahead(1.5, 7)], ids=lambda m: type(m).__name__)
def test_parts_keep_what_one_pass_keeps(spark, machine):
    whole = {(r.key, r.ord) for r in simplify.by_machine(frame(spark), machine).collect()}
    parts = [(r.key, r.ord) for r in simplify.by_machine(frame(spark), machine, long=800, part=230).collect()]
    assert len(parts) == len(set(parts)) and set(parts) == whole
    for k, ps in SERIES.items():
        assert {(k, ps[0][0]), (k, ps[-1][0])} <= whole or isinstance(machine, simplify.Perpendicular)
    assert 10 < len([1 for k, _ in whole if k == "a"]) < 2600


def test_segments_of_any_size_give_the_same_points(spark):
    want = {(r.key, r.ord) for r in simplify.douglas_peucker(frame(spark), 1.0).collect()}
    for fit in (3, 200):
        got = [(r.key, r.ord) for r in simplify.douglas_peucker(frame(spark), 1.0, fit=fit).collect()]
        assert len(got) == len(set(got)) and set(got) == want
