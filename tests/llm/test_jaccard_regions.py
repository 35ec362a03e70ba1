import random

import numpy as np
import pytest

from tilewright.llm import jaccard

from .test_operators import linked


def joined(n, links):
    up = jaccard.Union(n)
    for a, b in links:
        up.join(a, b)
    return [up.root(i) for i in range(n)]


def brute(keys, percent):
    some = [set(k.tolist()) for k in keys]
    links = [(i, j) for i in range(len(keys)) for j in range(i) if 100 * len(some[i] & some[j]) >= percent * len(some[i] | some[j])]
    return joined(len(keys), links)


def equidistant(members, shared, own):
    """Sets that all share the same members and no others, so that any two are equally far apart."""
    return [np.array([*range(shared), *range(10**6 + i * own, 10**6 + (i + 1) * own)], np.uint64) for i in range(members)]


@pytest.mark.parametrize("members", [3, 40, 300])
def test_intersections(members):
    r = np.random.default_rng(members)
    # some members are in most sets, some in few of them, some in one
    keys = [np.unique(np.concatenate((r.integers(0, 90, 60), r.integers(100, 100 + members * 20, 50), [10**9 + i]))).astype(np.uint64) for i in range(members)]
    region = jaccard.Region(keys, 85)
    for one in range(0, members, 7):
        many = r.permutation(members)[: max(1, members // 2)]
        assert region.common(one, many).tolist() == [len(np.intersect1d(keys[one], keys[i])) for i in many]


def test_members_as_far_from_each_other():
    keys = equidistant(300, 17_000, 3_000)  # 0.74 of each pair
    assert jaccard.region_links(keys, 85) == []
    # two of them are near each other, past the pivots
    keys[250] = np.unique(np.concatenate((keys[290][:19_500], keys[250][-500:])))
    assert jaccard.region_links(keys, 85) == [(250, 290)]


def test_more_cells_than_pivots(monkeypatch):
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    r = random.Random(4)
    keys = []
    for group in range(12):
        base = [*range(300), *range(1000 * (group + 1), 1000 * (group + 1) + 60)]
        for _ in range(r.randrange(1, 6)):
            for _ in range(14):
                base[r.randrange(len(base))] = r.randrange(10**6, 10**9)
            keys.append(np.array(sorted(set(base)), np.uint64))
    r.shuffle(keys)
    assert joined(len(keys), jaccard.region_links(keys, 85)) == brute(keys, 85)


def test_regions_of_many_words(spark, monkeypatch):
    r = random.Random(18)
    base = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(r.choice([0, 1, 5, 9, 16])):
            words[r.randrange(400)] = f"n{i}x{r.randrange(99)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "REGION_KEYS", 3000)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 85).collect()}
    assert got == linked(rows, 4, 85)
