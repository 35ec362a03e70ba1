"""Polyline simplification of ordered series: (key, ord, x, y) in, the kept rows out.

Methods whose next key depends on the last one are small machines that look at the points in order; long series run in parts side by side.  Douglas-Peucker
solves segments that fit a task whole, and splits longer ones by rounds over the points of all keys at once.  Series of fewer
than three points, and tolerances of 0, are copied.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geom import segment_dist2
from ..plans.iterate import discard, written


def nth_point(df: DataFrame, n: int) -> DataFrame:
    """Every n-th point and the last."""
    last = F.max("ord").over(Window.partitionBy("key"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("ord")) - 1
    return df.withColumn("_k", place).withColumn("_last", last).where((F.col("_k") % max(n, 1) == 0) | (F.col("ord") == F.col("_last"))).select("key", "ord", "x", "y")


Point = tuple  # (ord, x, y)


class Radial:
    """Points nearer than the tolerance to the last kept one go; first and last stay.  State: the last key."""

    def __init__(self, tol: float) -> None:
        self.limit = tol * tol

    def start(self, p: Point) -> tuple:
        return (p,)

    def step(self, state: tuple, p: Point, last: bool, out: list[Point]) -> tuple:
        a = state[0]
        if last or (a[1] - p[1]) ** 2 + (a[2] - p[2]) ** 2 >= self.limit:
            out.append(p)
            return (p,)
        return state


class Perpendicular:
    """A point nearer than the tolerance to the segment of its neighbours goes, one after the other.  State: the last key and the point that waits for its next one."""

    def __init__(self, tol: float) -> None:
        self.limit = tol * tol

    def start(self, p: Point) -> tuple:
        return (p, None)

    def step(self, state: tuple, p: Point, last: bool, out: list[Point]) -> tuple:
        key, waiting = state
        if waiting is None:
            state = (key, p)
        elif _segment(key[1:], p[1:], waiting[1:]) < self.limit:
            out.append(p)
            state = (p, None)
        else:
            out.append(waiting)
            state = (waiting, p)
        if last and state[1] is not None:
            out.append(state[1])
        return state


class Strip:
    """A strip around the line through a key and its next point; the last point inside it is the next key.  State: key, next point, newest point."""

    def __init__(self, tol: float) -> None:
        self.limit = tol * tol

    def start(self, p: Point) -> tuple:
        return (p, None, p)

    def step(self, state: tuple, p: Point, last: bool, out: list[Point]) -> tuple:
        key, ahead, newest = state
        if ahead is None:
            ahead = p
        elif _line(key[1:], ahead[1:], p[1:]) >= self.limit:
            out.append(newest)
            key, ahead = newest, p
        if last:
            out.append(p)
        return (key, ahead, p)


class Ray:
    """Like a strip, around a ray set by the last point within the lesser tolerance, up to the greater one.  State: key, ray, newest point, whether it is the first point."""

    def __init__(self, low: float, high: float) -> None:
        self.low, self.high = low * low, high * high

    def start(self, p: Point) -> tuple:
        return (p, None, p, True)

    def step(self, state: tuple, p: Point, last: bool, out: list[Point]) -> tuple:
        key, ray, newest, first = state
        d = (p[1] - key[1]) ** 2 + (p[2] - key[2]) ** 2
        if not first and (ray is not None or d >= self.low):
            ray = newest if ray is None else ray
            if not (d < self.high and _line(key[1:], ray[1:], p[1:], 0.0) < self.low):
                out.append(newest)
                key, ray = newest, None
        if last:
            out.append(p)
        return (key, ray, p, False)


class Ahead:
    """The furthest of the next points whose segment keeps all between within the tolerance.  State: the last key and at most ``look_ahead`` points after it."""

    def __init__(self, tol: float, look_ahead: int) -> None:
        self.limit, self.look = tol * tol, look_ahead

    def start(self, p: Point) -> tuple:
        return (p, ())

    def step(self, state: tuple, p: Point, last: bool, out: list[Point]) -> tuple:
        key, window = state[0], (*state[1], p)
        while window and (last or len(window) == self.look):
            to = len(window) - 1
            while to > 0 and max(_segment(key[1:], window[to][1:], q[1:]) for q in window[:to]) >= self.limit:
                to -= 1
            key, window = window[to], window[to + 1 :]
            out.append(key)
        return (key, window)


#: Series of more points are cut into parts of about PART points.
LONG, PART = 1 << 17, 1 << 16


def _plain(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("ord").cast("int").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _points(rows: pd.DataFrame) -> Iterator[Point]:
    rows = rows.sort_values("ord", kind="stable")
    return zip(rows["ord"].tolist(), rows["x"].tolist(), rows["y"].tolist(), strict=True)


def _each_series(df: DataFrame, fn: Callable[[Iterator[Point]], Iterable[Point]], schema: str) -> DataFrame:
    """The points that ``fn`` gives for each key; it gets them one by one in order, so a task need not hold a series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                kind[:] = [batch.schema.field(i).type for i in range(4)]
                yield from zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)

        def packed(kept: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), kind, strict=True)], ["key", "ord", "x", "y"])

        held: list[tuple] = []
        for key, series in groupby(rows(), key=lambda r: r[0]):
            for p in fn(r[1:] for r in series):
                held.append((key, *p))
                if len(held) >= 1 << 14:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    return df.select("key", "ord", "x", "y").repartition("key").sortWithinPartitions("key", "ord").mapInArrow(run, schema)


def _frozen(state):
    """A state as read back from text: lists become tuples."""
    return tuple(_frozen(v) for v in state) if isinstance(state, list) else state


def by_machine(df: DataFrame, machine, long: int = LONG, part: int = PART) -> DataFrame:
    """Rows that a machine keeps, which looks at a key's points in order and remembers a few of them.

    A series of at most ``long`` points is one pass in a task.  Longer ones are cut by range into parts, which tasks run side by side as if
    each began at its first point.  Then every part that was entered in another state is run from both states until they meet, which they mostly do within a
    few keys; where they meet its exit stands, else the part after it is due in the next round.  At the end each
    part gives the rows it keeps from its true entry.
    """
    key = df.schema["key"].dataType.simpleString()
    schema = f"key {key}, ord int, x double, y double"
    plain = _plain(df)

    def rows_of(name, kept: list[Point]) -> pd.DataFrame:
        return pd.DataFrame([(name, *p) for p in kept], columns=["key", "ord", "x", "y"])

    def whole(series: Iterator[Point]) -> Iterator[Point]:
        kept = [next(series)]
        state, waiting = machine.start(kept[0]), None
        for p in series:
            if waiting is not None:
                state = machine.step(state, waiting, False, kept)
                yield from kept
                kept = []
            waiting = p
        if waiting is not None:
            machine.step(state, waiting, True, kept)
        yield from kept

    ends = plain.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("ord").alias("low"), F.max("ord").alias("high")).where(F.col("m") > long)
    ends = written(ends, "long")
    total = ends.agg(F.sum("m")).first()[0]
    if not total:
        return _each_series(plain, whole, schema)
    short = _each_series(plain.join(ends, "key", "left_anti"), whole, schema)
    parts = plain.join(ends.select("key", "low", "high"), "key").repartitionByRange(-(-total // part), "key", "ord").withColumn("part", F.spark_partition_id())
    parts = written(parts, "parts")  # a point's part stays what it is

    def run(rows: pd.DataFrame, entry: str | None, kept: list[Point]) -> tuple:
        high, low = rows["high"].iloc[0], rows["low"].iloc[0]
        state = _frozen(json.loads(entry)) if entry else None
        for p in _points(rows):
            if state is None:
                state = machine.start(p)
                if p[0] == low:
                    kept.append(p)
            else:
                state = machine.step(state, p, p[0] == high, kept)
        return state

    def first(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*name, None, json.dumps(run(rows, None, [])))], columns=["key", "part", "entry", "exit"])

    def again(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        was, entry, high = rows["entry"].iloc[0], rows["next"].iloc[0], rows["high"].iloc[0]
        a, b = _frozen(json.loads(was)) if was else None, _frozen(json.loads(entry))
        for p in _points(rows):
            a = machine.start(p) if a is None else machine.step(a, p, p[0] == high, [])
            b = machine.step(b, p, p[0] == high, [])
            if a == b:
                return pd.DataFrame([(*name, None)], columns=["key", "part", "new"])
        return pd.DataFrame([(*name, json.dumps(b))], columns=["key", "part", "new"])

    def final(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[Point] = []
        run(rows, rows["entry"].iloc[0], kept)
        return rows_of(name[0], kept)

    # one small row for each part
    states = written(parts.groupBy("key", "part").applyInPandas(first, f"key {key}, part int, entry string, exit string"), "states")
    while True:
        before = F.lag("exit").over(Window.partitionBy("key").orderBy("part"))
        linked = states.withColumn("next", before)
        due = written(linked.where(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("entry"))).select("key", "part", "entry", "next"), "due")
        if not due.limit(1).count():
            break
        new = parts.join(due, ["key", "part"]).groupBy("key", "part").applyInPandas(again, f"key {key}, part int, new string")
        moved = linked.join(new, ["key", "part"], "left").select("key", "part", F.coalesce("next", "entry").alias("entry"), F.coalesce("new", "exit").alias("exit"))
        states, old = written(moved, "states"), states
        discard(old)
    return short.unionByName(parts.join(states.select("key", "part", "entry"), ["key", "part"]).groupBy("key", "part").applyInPandas(final, schema))


def radial_distance(df: DataFrame, tol: float) -> DataFrame:
    """See :class:`Radial`."""
    return _plain(df) if tol == 0 else by_machine(df, Radial(tol))


def perpendicular_distance(df: DataFrame, tol: float, repeat: int = 1) -> DataFrame:
    """See :class:`Perpendicular`; repeated on the result, up to ``repeat`` times or until a pass removes nothing of any series."""
    if tol == 0:
        return _plain(df)
    out = by_machine(df, Perpendicular(tol))
    for _ in range(repeat - 1):
        out = written(out, "pass")
        more = written(by_machine(out, Perpendicular(tol)), "pass")
        fewer = more.count() < out.count()
        out = more
        if not fewer:
            break
    return out


def reumann_witkam(df: DataFrame, tol: float) -> DataFrame:
    """See :class:`Strip`."""
    return _plain(df) if tol == 0 else by_machine(df, Strip(tol))


def opheim(df: DataFrame, min_tol: float, max_tol: float) -> DataFrame:
    """See :class:`Ray`."""
    return _plain(df) if min_tol * max_tol == 0 else by_machine(df, Ray(min_tol, max_tol))


def lang(df: DataFrame, tol: float, look_ahead: int) -> DataFrame:
    """See :class:`Ahead`."""
    return _plain(df) if tol == 0 or look_ahead < 2 else by_machine(df, Ahead(tol, look_ahead))


#: Points of a segment that one task solves whole.
FIT = 1 << 16


def _furthest(x: np.ndarray | list, y: np.ndarray | list, a: int, b: int) -> tuple[float, int]:
    """Squared distance and place of the first of the points furthest from the segment a .. b, strictly between its ends."""
    if isinstance(x, list):
        ends = (x[a], y[a]), (x[b], y[b])
        d2, k = max((_segment(*ends, (x[i], y[i])), -i) for i in range(a + 1, b))
        return d2, -k
    vx, vy = x[b] - x[a], y[b] - y[a]
    px, py = x[a + 1 : b], y[a + 1 : b]
    cw, cv = (px - x[a]) * vx + (py - y[a]) * vy, vx * vx + vy * vy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(cw <= 0, 0.0, np.where(cv <= cw, 1.0, cw / cv))
    d2 = (px - x[a] - t * vx) ** 2 + (py - y[a] - t * vy) ** 2
    k = int(d2.argmax())
    return float(d2[k]), a + 1 + k


def _axes(points: list[Point]) -> tuple:
    """Coordinates as arrays, or as lists where arrays would cost more than they save."""
    x, y = [p[1] for p in points], [p[2] for p in points]
    return (x, y) if len(x) < 40 else (np.array(x), np.array(y))


def douglas_peucker(df: DataFrame, tol: float, radial: bool = True, fit: int = FIT) -> DataFrame:
    """Splits at the furthest point while it is further than the tolerance, after a radial pass with the same tolerance.

    Series of at most ``fit`` points are solved whole, one after the other in a task.  In longer ones each point carries the ends of
    its segment, and segments over ``fit`` are split by rounds: a round takes one furthest point of each and hands its points on to the two
    halves by an equi-join on the segment, until the halves fit or close.
    """
    if tol == 0:
        return df.select("key", "ord", "x", "y")
    base = written(_plain(radial_distance(df, tol) if radial else df), "points")
    c, key = F.col, df.schema["key"].dataType.simpleString()
    schema = f"key {key}, ord int, x double, y double"

    def inner(x: np.ndarray | list, y: np.ndarray | list) -> list[int]:
        """Places of the kept points strictly between the first and the last."""
        keep, open_ = [], [(0, len(x) - 1)]
        while open_:
            a, b = open_.pop()
            if b > a + 1:
                d2, k = _furthest(x, y, a, b)
                if d2 > tol * tol:
                    keep.append(k)
                    open_ += [(a, k), (k, b)]
        return sorted(keep)

    def whole(series: Iterator[Point]) -> list[Point]:
        points = list(series)
        if len(points) < 3:
            return points
        at = inner(*_axes(points))
        return [points[0], *(points[i] for i in at), points[-1]]

    long = written(base.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(c("m") > fit), "long")
    if not long.limit(1).count():
        return _each_series(base, whole, schema)
    kept = [_each_series(base.join(long, "key", "left_anti"), whole, schema)]
    w = Window.partitionBy("key")
    pts = written(base.join(long, "key").select("key", "ord", "x", "y", F.row_number().over(w.orderBy("ord")).alias("n"), "m"), "points")

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        """The kept points of one segment, whose ends are among the rows."""
        rows = rows.sort_values("n")
        return rows.iloc[inner(rows["x"].to_numpy(), rows["y"].to_numpy())][["key", "ord", "x", "y"]]

    def all_solved(segments: DataFrame) -> DataFrame:
        """Segments (key, a, b, ord, x, y, n) with the points at their ends."""
        return segments.select("key", "a", "b", "ord", "x", "y", "n").groupBy("key", "a", "b").applyInPandas(solved, schema)

    kept.append(pts.where("n = 1 or n = m").select("key", "ord", "x", "y"))
    ends = lambda i, s: pts.where(i).select("key", c("n").alias(s), c("x").alias(f"{s}x"), c("y").alias(f"{s}y"))
    open_ = pts.where("n > 1 and n < m").drop("m").join(ends("n = 1", "a"), "key").join(ends("n = m", "b"), "key")
    while open_.limit(1).count():
        d2 = segment_dist2(c("ax"), c("ay"), c("bx"), c("by"), c("x"), c("y"))
        far = open_.groupBy("key", "a", "b").agg(F.max(F.struct(d2.alias("d2"), (-c("n")).alias("n"), "x", "y")).alias("f")).where(c("f.d2") > tol * tol)
        split = open_.join(far.select("key", "a", "b", (-c("f.n")).alias("k"), c("f.x").alias("kx"), c("f.y").alias("ky")), ["key", "a", "b"])
        side = lambda s, first: F.when((c("n") < c("k")) == F.lit(first), c(f"{s}")).otherwise
        halves = [side(f"a{e}", True)(c(f"k{e}")).alias(f"a{e}") for e in ("", "x", "y")] + [side(f"b{e}", False)(c(f"k{e}")).alias(f"b{e}") for e in ("", "x", "y")]
        split = written(split.select("key", "ord", "x", "y", "n", *halves, (c("n") == c("k")).alias("top")), "split")
        kept.append(split.where("top").select("key", "ord", "x", "y"))
        rest = split.where("not top").drop("top")
        fits = rest.where(c("b") - c("a") + 1 <= fit)
        at = lambda s: fits.select("key", "a", "b", F.lit(None).cast(pts.schema["ord"].dataType).alias("ord"), c(f"{s}x").alias("x"), c(f"{s}y").alias("y"), c(s).alias("n")).distinct()  # noqa: B023, E731
        kept.append(all_solved(fits.select("key", "a", "b", "ord", "x", "y", "n").unionByName(at("a")).unionByName(at("b"))))
        open_ = rest.where(c("b") - c("a") + 1 > fit)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


def _line(a, b, p, least: float | None = None) -> float:
    """Squared distance to the line through a and b; with ``least`` 0, to the ray from a."""
    vx, vy, wx, wy = b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]
    cv = vx * vx + vy * vy
    t = (wx * vx + wy * vy) / cv if cv else 0.0
    t = t if least is None else max(least, t)
    return (wx - t * vx) ** 2 + (wy - t * vy) ** 2


def _segment(a, b, p) -> float:
    vx, vy, wx, wy = b[0] - a[0], b[1] - a[1], p[0] - a[0], p[1] - a[1]
    cw, cv = wx * vx + wy * vy, vx * vx + vy * vy
    t = 0.0 if cw <= 0 else 1.0 if cv <= cw else cw / cv
    return (p[0] - a[0] - t * vx) ** 2 + (p[1] - a[1] - t * vy) ** 2


def douglas_peucker_n(df: DataFrame, n: int) -> DataFrame:
    """Exactly n points (all, if there are fewer): the furthest point of any segment is added first."""

    def pick(series: Iterator[Point]) -> list[Point]:
        p = list(series)
        if len(p) < 3 or len(p) <= n:
            return p
        keys, heap = {0, len(p) - 1}, []
        x, y = _axes(p)

        def push(a: int, b: int) -> None:
            if b > a + 1:
                d, k = _furthest(x, y, a, b)
                if d > 0:
                    heapq.heappush(heap, (-d, k, a, b))

        push(0, len(p) - 1)
        while heap and len(keys) < n:
            _, k, a, b = heapq.heappop(heap)
            keys.add(k)
            push(a, k)
            push(k, b)
        return [p[i] for i in sorted(keys)]

    key = df.schema["key"].dataType.simpleString()
    return _each_series(_plain(df), pick, f"key {key}, ord int, x double, y double")


def simplify(df: DataFrame, n: int = 0, eps: float = 1.0) -> DataFrame:
    """Exactly n points if n is over 0, else all that the tolerance needs."""
    return douglas_peucker_n(df, n) if n > 0 else douglas_peucker(df, eps)


def positional_errors(original: DataFrame, simplified: DataFrame) -> DataFrame:
    """(key, ord, d2): squared distance of each original point to the simplified segment that it belongs to."""
    w = Window.partitionBy("key").orderBy("ord")
    seg = simplified.select("key", F.col("ord").alias("o"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    at = original.join(seg.select("key", F.col("o").alias("ord"), F.lit(1).alias("k")), ["key", "ord"], "left")
    running = F.max(F.when(F.col("k") == 1, F.col("ord"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = F.col
    out = at.withColumn("o", running).join(seg, ["key", "o"])
    d2 = F.when(c("bx").isNull(), 0.0).otherwise(segment_dist2(c("ax"), c("ay"), c("bx"), c("by"), c("x"), c("y")))
    return out.select("key", "ord", d2.alias("d2"))


def error_statistics(original: DataFrame, simplified: DataFrame) -> DataFrame:
    """(key, max_error, sum_error, mean_error, std_error) of the distances."""
    e = positional_errors(original, simplified).withColumn("e", F.sqrt("d2"))
    return e.groupBy("key").agg(F.max("e").alias("max_error"), F.sum("e").alias("sum_error"), F.avg("e").alias("mean_error"), F.stddev_pop("e").alias("std_error"))
