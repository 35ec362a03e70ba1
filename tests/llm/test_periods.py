"""Periodic runs against a version that tries every period at every word."""

import hashlib
import random
import re

import numpy as np
import pytest

from tilewright.llm import periods
from tilewright.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1) if j == i else j
    return sorted((s, q, n) for (s, n), q in found.items())


def collapsed(w):
    gone = set()
    runs = brute(w)
    for s, q, n in runs:
        gone |= set(range(s + q, s + n))
    return [(s, n, q) for s, q, n in runs], " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    r = random.Random(7)
    out = [None, "", " \n\t ", "a", "a " * 5, "a " * 6, "a a a a a a b", "x y " * 4, "x y " * 3 + "x", "ab ab\nab  ab ab ab"]
    for _ in range(150):
        k = r.choice([1, 2, 3, 6])
        w = [r.choice("abcdef"[:k]) for _ in range(r.randrange(1, 70))]
        if r.random() < 0.6:
            p = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
            at = r.randrange(len(w))
            w[at:at] = p * r.randrange(2, 8) + p[: r.randrange(len(p))]
        out.append(" ".join(w))
    # an alternation inside an alternation, and a document that one word fills
    out += [("a b " * 6 + "c ") * 5, "w " * 3000, " ".join(f"w{i % 700}" for i in range(3000)), " ".join(f"u{i}" for i in range(4000))]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "r") for i, t in enumerate(texts())] + [(3, "a b " * 9, 0, None), (3, "a b " * 9, 0, None), (None, "c " * 8, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, runs bigint, kept string").repartition(3)


def test_runs_and_kept_text(docs):
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.kept) for r in periods.collapse_runs(docs).collect()), key=repr)
    want = sorted(((r.doc_id, *collapsed(WORD.findall(r.text or ""))) for r in docs.collect()), key=repr)
    assert got == want


def test_query_rebuilds_and_digests(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op12_periodic_runs"](spark, str(tmp_path)).where("doc_id <> 3").collect()}
    repeated = 0
    for i, t in enumerate(texts()):
        if i == 3:
            continue
        w = WORD.findall(t or "")
        if cut := periods.planted(i, len(w)):
            a, p = cut
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
            repeated += 1
        runs, kept = collapsed(w)
        r = got[i]
        assert r.n_runs == len(runs) and r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (best[1] * 1000 // best[2] if best[1] else None)
    assert repeated > 5


def test_equal_hashes_fall_back_to_comparing(monkeypatch):
    w = np.array([1, 2] * 5 + [1, 3] * 6)
    want = periods.lag_scan(w).tolist()
    monkeypatch.setattr(periods, "span_hashes", lambda prefix, a, b: np.zeros(len(a), np.uint64))
    assert periods.lag_scan(w).tolist() == want == [[0, 11, 2], [10, 12, 2]]


def test_chunks_of_anchors_agree(monkeypatch):
    r = random.Random(2)
    w = np.array([r.randrange(2) for _ in range(900)])
    want = [(s, n, q) for s, q, n in brute(w.tolist())]
    monkeypatch.setattr(periods, "AT_ONCE", 7)
    found = periods.lag_scan(w)
    assert sorted(map(tuple, found.tolist())) == sorted(want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert periods.run_digests(periods.collapse_runs(none)).collect() == []
