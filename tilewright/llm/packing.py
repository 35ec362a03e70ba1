"""Operator 6, best-fit packing: best-two-fit over the histogram of lengths.

Documents become token ids; only a document longer than a sequence is cut, into full pieces and a
rest.  Pieces of one length are interchangeable, so the packing is decided on the histogram of
lengths, which has at most ``capacity`` rows however large the corpus is:

* fill greedily: a bin takes the longest piece that is left, then always the longest that fits;
* best two: take the bin's smallest piece out again and put in two unpacked pieces that fit the
  larger gap more tightly, if there are such two;
* the same bin is made as often as the counts allow, so that the number of steps depends on the
  number of lengths and not on the number of pieces.

The result is a list of bin patterns with counts.  Each piece then finds its place by its rank
among the pieces of its length: ranks come from counts per (bucket of ids, length), which sum up
to offsets, so that a length with very many pieces is no hot task.  Only lengths and counts ever
reach the driver.

Defined cases: a null text has no ids, so its piece holds only the end id; a repeated (id, text)
row is packed as often as it occurs; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lowered, ranges, steps, word_hashes, words, written

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker keeps; the store is emptied when it is full.
KEPT_WORDS = 600_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of words, cut between letters and closing punctuation, and which are plain.

    A plain part holds only Latin-1 letters or only ASCII punctuation without apostrophes; the tokenizer
    takes each as one unit whatever its neighbours are.
    """
    starts, ends, rows = words(data, offsets)
    after = np.append(data[1:], 0) if len(data) else data
    pair = (data == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    small = data | 32
    letter = ((small >= 97) & (small <= 122)) | pair
    letter[1:] |= pair[:-1]
    punct = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57)) & (data != 39)
    letters, puncts = (np.concatenate(([0], np.cumsum(x))) for x in (letter, punct))
    head = letters[ends] - letters[starts]
    plain = (head + puncts[ends] - puncts[starts] == ends - starts) & (letters[starts + head] - letters[starts] == head)
    two = plain & (head > 0) & (head < ends - starts)
    which = np.repeat(np.arange(len(starts)), 1 + two)
    second = np.zeros(len(which), bool)
    second[1:] = which[1:] == which[:-1]
    middle = (starts + head)[which]
    cut = two[which]
    return np.where(second, middle, starts[which]), np.where(cut & ~second, middle, ends[which]), rows[which], plain[which]


def lowered_words(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A-Z to a-z, but for words that may hold the name of a special token, which is not in lower case only."""
    low = lowered(data)
    mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if len(mark):
        starts, ends, _ = words(data, offsets)
        held = np.unique(np.searchsorted(starts, mark, "right") - 1)
        at = ranges(starts[held], (ends - starts)[held])
        low[at] = data[at]
    return low


class WordTokenizer:
    """Ids of whole texts from ids of their white-space separated words.

    The tokenizer drops white space and never joins across it, and it takes letters and punctuation apart, so
    the ids of a text are those of its parts in turn.  Each distinct part of a batch is encoded once, and
    plain parts many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.kept: dict[bytes, bytes] = {}

    def _encode(self, new: list[bytes], plain: list[bool]) -> None:
        encode = self.encoder.encode
        for part in (p for p, q in zip(new, plain, strict=True) if not q):
            self.kept[part] = np.array(encode(part.decode(), add_special_tokens=False).ids, np.uint32).tobytes()
        joint = [p for p, q in zip(new, plain, strict=True) if q]
        for at in range(0, len(joint), 256):
            some = joint[at : at + 256]
            coded = encode(b" ".join(some).decode(), add_special_tokens=False)
            ids = np.array(coded.ids, np.uint32).tobytes()
            ends = (4 * np.cumsum(np.bincount(coded.word_ids, minlength=len(some)))).tolist()
            self.kept.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def _ids(self, found: list[bytes], plain: list[bool]) -> list[bytes]:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        new = [i for i, w in enumerate(found) if w not in kept]
        self._encode([found[i] for i in new], [plain[i] for i in new])
        return [kept[w] for w in found]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of a batch of texts."""
        data = lowered_words(data, offsets)
        starts, ends, rows, plain = word_parts(data, offsets)
        hashes = word_hashes(data, starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        coded = self._ids([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], plain[first].tolist())
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        flat = np.frombuffer(b"".join(coded), np.uint32)
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        ids = flat[ranges(begin[which], sizes[which])]
        per_row = np.bincount(rows, weights=sizes[which], minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_row)))


_tokenizers: dict[str, WordTokenizer] = {}


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every document's ids and end id, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        tokenizer = _tokenizers[path]
        for part, data, offsets in steps(batches):
            ids, at = tokenizer(data, offsets)
            lengths = np.diff(at) + 1
            counts = -(-lengths // capacity)
            row = np.repeat(np.arange(len(part)), counts)
            piece = ranges(np.zeros(len(part), np.int64), counts)
            start = piece * capacity
            length = np.minimum(capacity, lengths[row] - start)
            coded, end = ids.astype("<u4").tobytes(), np.array([END_ID], "<u4").tobytes()
            crc = []
            for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                a, b = int(at[r]) + s, min(int(at[r]) + s + n, int(at[r + 1]))
                value = zlib.crc32(coded[4 * a : 4 * b])
                crc.append(zlib.crc32(end, value) if b - a < n else value)
            ids_of_row = part.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([ids_of_row, *(pa.array(x.astype(np.int64)) for x in (piece, start, length)), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    picked = docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"cast(`{text_col}` as string) as text")
    return picked.mapInArrow(run, "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")


def _largest(left: np.ndarray, most: int) -> int:
    """The greatest length up to ``most`` of which pieces are left, or 0."""
    found = np.flatnonzero(left[1 : most + 1])
    return int(found[-1]) + 1 if len(found) else 0


def _best_two(left: np.ndarray, gap: int) -> tuple[int, int]:
    """Two lengths of pieces that are left with the greatest sum up to ``gap``; (0, 0) if none."""
    have = np.flatnonzero(left[:gap])
    have = have[have > 0]
    if not len(have):
        return 0, 0
    mate = have[np.maximum(np.searchsorted(have, gap - have, "right") - 1, 0)]
    good = have + mate <= gap
    same = good & (mate == have) & (left[have] < 2)
    if same.any():
        for i in np.flatnonzero(same):
            lower = have[:i]
            mate[i] = lower[-1] if len(lower) else 0
            good[i] = len(lower) > 0
    total = np.where(good, have + mate, -1)
    best = int(total.argmax())
    return (int(have[best]), int(mate[best])) if total[best] > 0 else (0, 0)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths, how often) that hold exactly the given pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    bins: list[tuple[tuple[int, ...], int]] = []
    while left.any():
        pattern: list[int] = []
        gap = capacity
        while length := _largest(left, gap):
            pattern.append(length)
            left[length] -= 1
            gap -= length
        if gap and len(pattern) > 1:
            wide = gap + pattern[-1]
            two = _best_two(left, wide)
            if sum(two) > pattern[-1]:
                left[pattern.pop()] += 1
                for length in two:
                    pattern.append(length)
                    left[length] -= 1
                    wide -= length
                while length := _largest(left, wide):
                    pattern.append(length)
                    left[length] -= 1
                    wide -= length
        lengths, need = np.unique(pattern, return_counts=True)
        more = int((left[lengths] // need).min())
        left[lengths] -= more * need
        bins.append((tuple(pattern), more + 1))
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length."""
    spark = pieces.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = written(pieces, "pieces")
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).alias("bucket")
    counted = pieces.groupBy(bucket, "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, at = [], dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, times in best_two_fit(histogram, capacity):
        offset = 0
        for length in sorted(set(pattern), reverse=True):
            per = pattern.count(length)
            slots.append((length, at[length], at[length] + per * times, per, offset, sequence))
            at[length] += per * times
            offset += per * length
        sequence += times
    #: At most a few rows for each length and pattern; lengths are at most ``capacity``.
    plan = spark.createDataFrame(slots, "length bigint, low bigint, high bigint, per bigint, base bigint, first bigint")
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    ranked = pieces.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["bucket", "length"]).withColumn("rank", F.col("before") + F.col("r"))
    lows = plan.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "high", "per", "base", "first"))).alias("slots"))
    # written: at most ``capacity`` rows whose size Spark knows, and a plain shuffle that it can split if it has to
    lows = written(lows, "slots")
    placed = ranked.join(lows, "length").withColumn("slot", _slot("slots", "rank"))
    k = F.col("rank") - F.col("slot.low")
    return placed.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", (F.col("slot.first") + F.floor(k / F.col("slot.per"))).alias("sequence_id"), (F.col("slot.base") + (k % F.col("slot.per")) * F.col("length")).alias("offset"))


def _slot(slots: str, rank: str):
    """The slot whose range holds the rank; a length has a slot for each pattern that uses it."""
    found = F.filter(F.col(slots), lambda s: (s["low"] <= F.col(rank)) & (F.col(rank) < s["high"]))
    return F.element_at(found, 1)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut, tokenise and pack; one row per piece."""
    return pack(pieces_of(docs, path or tokenizer_path(), capacity, id_col, text_col), capacity)
