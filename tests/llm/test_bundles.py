"""The bundled search of windows that texts of different versions share: brute force, one order of its own, little disk."""

import os
import random

import pyarrow as pa
import pytest

from tilewright.llm import bundles, pages

DATA = "/root/testdata/sf0.1"


def random_texts(seed):
    """Rows (row, v, salt, text): copies, passages that few or many quote, repeats inside a text, empty and short ones."""
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdé") for _ in range(rng.randint(8, 40))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        rows.append((i, rng.randint(0, 60), rng.randint(0, 2), rng.choice(" \n").join(parts)))
    return rows + [(200 + i, v, salt, text) for i, (_, v, salt, text) in enumerate(rows[:20])] + rows[:3]


def covered(text, found):
    out = set()
    for _, start, n in found:
        out.update(range(start, start + n - 1 + pages.RUN))
    assert not out or max(out) < len(text.split())
    return sorted(out)


@pytest.mark.parametrize(("seed", "fit", "parts"), [(1, None, 1), (2, 1, 5), (3, 3, 40), (4, 10, 3)])
def test_runs_are_those_of_brute_force(spark, seed, fit, parts):
    rows = random_texts(seed)
    windows = {}
    for _, v, salt, text in rows:
        words = text.split()
        for s in range(len(words) - pages.RUN + 1):
            windows.setdefault((salt, *words[s : s + pages.RUN]), set()).add(v)
    want = []
    for row, _, salt, text in rows:
        words = text.split()
        runs = [(0, s, 1) for s in range(len(words) - pages.RUN + 1) if len(windows[(salt, *words[s : s + pages.RUN])]) > 1]
        want.append((row, text, covered(text, runs)))
    docs = spark.createDataFrame(rows, "row bigint, v bigint, salt bigint, text string").repartition(parts)
    got = [(r.row, r.text, covered(r.text, r.found)) for r in bundles.with_runs(docs, pages.RULE, fit).collect()]
    assert sorted(got) == sorted(want) and any(x[2] for x in want)


def test_bundles_do_not_depend_on_the_order_of_rows(spark):
    rows = random_texts(5)
    numbers = [sorted((r.bundle, bytes(r.data)) for r in bundles.bundled(spark.createDataFrame(x, "row bigint, v bigint, salt bigint, text string").coalesce(1).sortWithinPartitions("salt", "v", "row")).collect()) for x in (rows, rows[::-1])]
    assert numbers[0] == numbers[1]


def test_numbers_come_back(spark):
    for n in (0, 1, 1000):
        a, b = ([random.randint(-(1 << 62), 1 << 62) for _ in range(n)] for _ in range(2))
        assert [x.tolist() for x in bundles.unsqueezed(bundles.squeezed(*(pa.array(x, pa.int64()).to_numpy() for x in (a, b))), 2)] == [a, b]


def test_disk_of_the_search(spark, tmp_path):
    def used():
        folders = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
        folders.append(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
        return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for top in folders for d, _, files in os.walk(top) for f in files}

    before = used()
    pages.main_text(spark.read.parquet(f"{DATA}/pages.parquet")).write.parquet(str(tmp_path / "out"))
    wrote = sum(size for file, size in used().items() if file not in before)
    assert 0 < wrote < 1.5 * os.path.getsize(f"{DATA}/pages.parquet")
