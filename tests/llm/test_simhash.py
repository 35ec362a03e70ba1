"""SimHash fingerprints and components against a version that compares all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tilewright.llm import simhash
from tilewright.llm.common import components, written
from tilewright.llm.queries import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def reached(prints):
    """Least node that links of at most three bits reach; prints: {node: fingerprint}."""
    label = dict.fromkeys(prints)
    for start in sorted(prints):
        if label[start] is not None:
            continue
        label[start], stack = start, [start]
        while stack:
            x = stack.pop()
            for y in prints:
                if label[y] is None and (prints[x] ^ prints[y]).bit_count() <= 3:
                    label[y] = start
                    stack.append(y)
    return label


def texts():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "ÀB", "X" * 200]
    out = [None, "", " \n", "one", "One", "two words", "three Words here", "a a a a a", "w1 " * 5000]
    for _ in range(12):
        base = [r.choice(vocab) for _ in range(r.choice([4, 30, 400]))]
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(r.choice([1, 1, 3])):
                near[r.randrange(len(near))] = r.choice(vocab)
            out.append("  ".join(near).upper() if r.random() < 0.3 else "\t".join(near))
    return out


def test_query_against_all_pairs(spark, tmp_path):
    rows = [(i * 2 + 1, t, i, "x") for i, t in enumerate(texts())]
    rows += [(rows[12][0], rows[12][1], 0, None), (None, "one", 5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, fp bigint, node string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in queries()["op11_simhash_near_dedup"](spark, str(tmp_path)).collect()]
    prints = {i: fingerprint(t) for i, t, *_ in rows if i is not None}
    label = reached(prints)
    want = [(i, f"{fingerprint(t):016x}", label.get(i)) for i, t, *_ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert len(set(label.values())) < len(label) - 15


def clustered(seed, n):
    """Fingerprints in dense balls, chains and at random, some bits tied to each other."""
    r = random.Random(seed)
    out = {r.getrandbits(64) for _ in range(n // 4)}
    for centre in [r.getrandbits(64) for _ in range(4)]:
        for _ in range(n // 8):
            out.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(5))}))
    at = 0
    for _ in range(n // 8):
        out.add(at)
        at ^= sum({1 << r.randrange(64) for _ in range(r.choice([3, 4]))})
    tied = 0xFF00FF00FF00FF00
    out |= {(tied if r.random() < 0.5 else 0) ^ sum({1 << r.randrange(64) for _ in range(6)}) for _ in range(n // 8)}
    return sorted(x - (1 << 64) if x >> 63 else x for x in out)


@pytest.mark.parametrize("most,few,layout", [(1 << 22, 20, None), (300, 20, None), (40, 30, 2), (5, 30, None), (60, 20, 1)])
def test_links_of_dense_groups(spark, monkeypatch, most, few, layout):
    """Groups are compared whole, cut by quarters, or looked up; the components are the same."""
    prints = clustered(most, 700)
    if layout is not None:
        monkeypatch.setattr(simhash, "cheapest_layout", lambda *_: simhash.LAYOUTS[layout])
    df = written(spark.createDataFrame([(x, x) for x in prints], "fp bigint, node bigint").repartition(3))
    got = {r.node: r.component for r in components(simhash.near_links(df, most, few)).collect()}
    want = {a: b for a, b in reached({x: x & (1 << 64) - 1 for x in prints}).items()}
    groups = {}
    for a, b in want.items():
        groups.setdefault(b, []).append(a)
    want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
    assert got == want


def test_allocation_is_the_cheapest_and_adds_up():
    r = np.random.default_rng(1)
    for m in (2, 3, 4):
        work = np.cumsum(r.integers(0, 50, (m, simhash.D + 2, 30)), axis=1).astype(float)
        work[:, 0] = 0
        got, cost = simhash.allocate(work)
        assert (got.sum(axis=0) == simhash.D + 1 - m).all() and got.min() >= -1
        for x in range(30):
            best = min(sum(work[i, u, x] for i, u in enumerate(us)) for us in np.ndindex(*[simhash.D + 2] * m) if sum(us) == simhash.D + 1)
            assert cost[x] == best == sum(work[i, got[i, x] + 1, x] for i in range(m))


def test_blocks_hold_correlated_bits():
    r = np.random.default_rng(3)
    x = r.integers(0, 2, (4000, 64))
    x[:, 40] = x[:, 3]
    x[:, 17] = 1 - x[:, 3]
    x[:, 60] = x[:, 21]
    blocks = simhash.grouped_bits((x.T @ x).astype(float), len(x))
    assert sorted(sum(blocks, [])) == list(range(64)) and {len(b) for b in blocks} == {16}
    of = {b: i for i, block in enumerate(blocks) for b in block}
    assert of[3] == of[40] == of[17] and of[21] == of[60]


def test_rings_count_what_lies_near(spark):
    prints = clustered(9, 200)
    df = written(spark.createDataFrame([(x, x) for x in prints], "fp bigint, node bigint"))
    blocks = simhash.correlated_blocks(df)
    rings = simhash.value_rings(df, blocks)
    values = simhash.taken(np.array(prints).view(np.uint64), blocks[1])
    for v in (int(values[0]), 5, 65535):
        for t in range(4):
            assert rings[1, t, v] == sum((int(x) ^ v).bit_count() == t for x in values)


def test_empty_table(spark):
    assert simhash.simhash_components(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
