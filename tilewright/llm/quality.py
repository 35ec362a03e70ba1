"""Operator 3, quality classifier by co-training of a text view and a metadata view.

The text view sees byte pairs (hashed, square roots of their shares) and a few shape figures of the whole text; the metadata
view sees language, source and length as the table gives them.  Both are logistic models.  In each round
every view labels the unlabelled rows of a bounded pool that it is most sure of (by its calibrated score), and the other
view learns from them.  At the end each view is calibrated on labelled rows that it has not learnt from, and the
calibrated views are combined by a third logistic model, so a view that knows nothing has no say.

Fitting uses at most ``FIT_ROWS`` labelled and ``POOL_ROWS`` unlabelled rows (those with the least hashes of their ids),
so its cost does not grow.  Scoring is one pass over all documents without a shuffle.

Defined cases: a null or empty text has the shape of an empty text; null language, source and length are categories of
their own; with fewer than two labelled rows of a class all rows get the share of good ones (1 without labels) and none is
rejected; labels that are null are no labels; an id labelled twice has its greater label, an id with several
documents is fitted on one of them; rows with a null id are scored like others; an empty table gives no rows; further columns are kept aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, prefix_hashes, span_hashes, text_bytes, word_hashes, words

PAIRS, CATEGORIES = 1024, 64
SHAPES = 10
FIT_ROWS, POOL_ROWS, ROUNDS, CONFIDENT, SURE = 3000, 2000, 3, 200, 0.97


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[row, PAIRS + SHAPES] features of whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, PAIRS + SHAPES), np.float32)
    size = np.diff(offsets)
    if not len(data):
        return out
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    code = ((lower[:-1] * np.uint32(257) + lower[1:]) * np.uint32(2654435761)) >> np.uint32(22)
    same = row[1:] == row[:-1]
    counts = np.bincount(row[:-1][same].astype(np.int64) * PAIRS + code[same], minlength=n * PAIRS).reshape(n, PAIRS)
    out[:, :PAIRS] = np.sqrt(counts / np.maximum(size, 1)[:, None])
    share = lambda mask: np.bincount(row[mask], minlength=n) / np.maximum(size, 1)
    starts, ends, rows = words(data, offsets)
    count = np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
    distinct = _distinct(rows, word_hashes(data, starts, ends), n)
    letters = (data >= 65) & (data <= 90)
    shapes = [share(letters), share((data >= 48) & (data <= 57)), share((data > 32) & (data < 48)), share(data == 124), share(data == 33), share(data == 10), distinct / np.maximum(count, 1), np.log1p(count) / 10, np.minimum(size / np.maximum(count, 1), 40) / 10, np.log1p(size) / 12]
    out[:, PAIRS:] = np.stack(shapes, 1)
    return out


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct words of each row."""
    if not len(rows):
        return np.zeros(n, np.int64)
    order = np.argsort(hashes)
    order = order[np.argsort(rows[order], kind="stable")]
    h, r = hashes[order], rows[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[fresh], minlength=n)


def meta_features(lang: pa.Array, source: pa.Array, chars: pa.Array) -> np.ndarray:
    """[row, 2 * CATEGORIES + 2] features of the other columns."""
    n = len(lang)
    out = np.zeros((n, 2 * CATEGORIES + 2), np.float32)
    for k, column in enumerate((lang, source)):
        data, offsets = text_bytes(column)
        value = (span_hashes(prefix_hashes(data), offsets[:-1], offsets[1:]) >> np.uint64(33)).astype(np.int64)
        value = np.where(np.asarray(column.is_null()), 0, 1 + value % (CATEGORIES - 1)).astype(np.int64)
        out[np.arange(n), k * CATEGORIES + value] = 1
    missing = np.asarray(chars.is_null())
    out[:, -2] = missing
    out[:, -1] = np.log1p(np.maximum(np.asarray(pc.fill_null(chars, 0)).astype(np.float64), 0)) / 12
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights (the last is the constant) of a ridge logistic model, by Newton steps with conjugate gradients."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype))).astype(np.float64)
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        g = x.T @ (y - p) - keep * w
        h = np.maximum(p * (1 - p), 1e-6)
        d, r = np.zeros_like(w), g.copy()
        q, rr = r.copy(), r @ r
        for _ in range(40):
            if rr < 1e-10:
                break
            hq = x.T @ (h * (x @ q)) + keep * q
            a = rr / (q @ hq)
            d, r = d + a * q, r - a * hq
            new = r @ r
            q, rr = r + new / rr * q, new
        w += d
        if np.abs(d).max() < 1e-5:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(x.dtype) + w[-1]


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and constant that turn a view's logits into calibrated ones."""
    slope, constant = fitted(z[:, None], y, 0.1)
    if slope < 0:
        slope, constant = 0.0, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    return float(slope), float(constant)


@dataclass
class Model:
    """Weights of both views, of their calibrations (slope, constant) and of the combination; or one share."""

    share: float
    text: np.ndarray | None = None
    meta: np.ndarray | None = None
    scale: np.ndarray | None = None
    both: np.ndarray | None = None

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of good quality: by text, by metadata, combined."""
        if self.text is None:
            return (np.full(len(text), self.share),) * 3
        views = [logits(text, self.text), logits(meta, self.meta)]
        z = np.stack([s[0] * v + s[1] for v, s in zip(views, self.scale, strict=True)], 1)
        return sigmoid(z[:, 0]), sigmoid(z[:, 1]), sigmoid(logits(z, self.both))


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray) -> Model:
    """Fit both views on labelled rows and a pool of unlabelled ones; every fifth labelled row of each class is for calibration, which never sees rows that the views learn from."""
    share = float(y.mean()) if len(y) else 1.0
    if min(y.sum(), len(y) - y.sum()) < 2:
        return Model(share)
    check = np.zeros(len(y), bool)
    for kind in (0, 1):
        check[np.flatnonzero(y == kind)[::5]] = True
    learn = ~check
    views = [(text, pool_text, 0.02), (meta, pool_meta, 1.0)]
    given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in views]
    weights: list[np.ndarray] = []
    for round_ in range(ROUNDS + 1):
        weights = []
        for (x, pool, ridge), (rows, labels) in zip(views, given, strict=True):
            weights.append(fitted(np.vstack((x[learn], pool[rows])), np.concatenate((y[learn], labels)), ridge))
        if round_ == ROUNDS or not len(pool_text):
            break
        told = []
        for (x, pool, _), w in zip(views, weights, strict=True):
            slope, constant = calibrated(logits(x[check], w), y[check])
            p = sigmoid(slope * logits(pool, w) + constant)
            many = CONFIDENT * (round_ + 1)
            order = np.argsort(-p, kind="stable")
            top, low = order[: round(many * share)], order[len(order) - round(many * (1 - share)) :]
            top, low = top[p[top] > SURE], low[p[low] < 1 - SURE]
            told.append((np.concatenate((top, low)), np.concatenate((np.ones(len(top)), np.zeros(len(low))))))
        given = [told[1], told[0]]
    z = np.stack([logits(x[check], w) for (x, _, _), w in zip(views, weights, strict=True)], 1)
    scale = np.array([calibrated(z[:, i], y[check]) for i in range(2)])
    z = z * scale[:, 0] + scale[:, 1]
    return Model(share, weights[0], weights[1], scale, fitted(z, y[check], 0.1))


FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


def _picked(docs: DataFrame, more: list[str] = ()) -> DataFrame:
    kinds = {"doc_id": "bigint", "n_chars": "bigint"}
    return docs.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in FIELDS), *more)


def small_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Like ``steps``, with at most 512 rows, as features are dense."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        row = 0
        while row < len(batch):
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, "right")) - 1)
            end = min(end, len(batch), row + 512)
            yield batch.slice(row, end - row), data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
            row = end


def _features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels (-1: none) of a bounded set of rows, ordered by id hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in small_steps(batches):
            x, m = text_features(data, offsets), meta_features(*part.columns[2:5])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], ["doc_id", "label", "x", "m"])

    got = rows.mapInArrow(run, "doc_id bigint, label int, x binary, m binary").toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(v, np.float32) for v in got["x"].to_pylist()]).reshape(-1, PAIRS + SHAPES)
    m = np.array([np.frombuffer(v, np.float32) for v in got["m"].to_pylist()]).reshape(-1, 2 * CATEGORIES + 2)
    label = np.asarray(got["label"].combine_chunks().fill_null(-1)) if len(got) else np.zeros(0, np.int64)
    order = np.random.default_rng(7).permutation(len(label))
    return x[order], m[order], label[order]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS) -> Model:
    """Fit on bounded samples: FIT_ROWS labelled ids, and POOL_ROWS documents that are not among them."""
    least = lambda df, n: df.withColumn("h", F.xxhash64("doc_id", F.lit(11))).orderBy("h", "doc_id").limit(n).drop("h")
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    ids = _picked(docs).select("doc_id").where("doc_id is not null")
    known = least(ids.distinct().join(known, "doc_id"), fit_rows)
    pool = least(ids.distinct().join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti"), pool_rows).withColumn("label", F.lit(None).cast("int"))
    some = known.unionByName(pool)  # at most fit_rows + pool_rows ids
    # one row for each id, so that the rows are bounded as well
    one = _picked(docs).join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*FIELDS[1:])).alias("d"))
    x, m, y = _features(one.select("doc_id", *(F.col(f"d.{c}") for c in FIELDS[1:]), "label"))
    on = y >= 0
    return co_train(x[on], m[on], y[on].astype(float), x[~on], m[~on])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs' id with p_text, p_meta and p_quality for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in small_steps(batches):
            p = model.scores(text_features(data, offsets), meta_features(*part.columns[2:5]))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.asarray(v, np.float64)) for v in p)], ["doc_id", "p_text", "p_meta", "p_quality"])

    return _picked(docs).mapInArrow(run, "doc_id bigint, p_text double, p_meta double, p_quality double")


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject; one pass without a shuffle."""
    names = docs.columns
    if model.text is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in small_steps(batches):
            p = model.scores(text_features(data, offsets), meta_features(*part.columns[2:5]))[2]
            yield pa.RecordBatch.from_arrays(part.columns[5:], names).filter(pa.array(p >= threshold))

    return _picked(docs, [F.col(c).alias(f"kept_{i}") for i, c in enumerate(names)]).mapInArrow(run, docs.schema)
