"""The trie of conversations against one that is built from all prefixes."""

import hashlib
import random
import zlib

import pytest

from tilewright.llm import tries
from tilewright.llm.queries import queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    # as in the module: equal turns by role, then by the digest of role and text
    order = lambda t: (t[0], t[1], hashlib.md5(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest())
    own = {c: [x[1:] for x in sorted(t, key=order)] for c, t in convs.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + t[h:]
    return out


def trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        under = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        leaves = sum(not any(len(r) == len(q) + 1 and r[:-1] == q for r in members) for q in under)
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in under), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    r = random.Random(13)
    out = []
    for c in range(-7, 60):
        if c % 11 == 3:
            continue
        for t in range(r.choice([1, 2, 4, 9, 14])):
            out.append((c, t, r.choice(["user", "assistant"]), r.choice(["a", "Été", "bb", ""])))
    out += [(100 + i, t, "user", "same") for i in range(40) for t in range(3)]  # copies
    out += [(200 + 5 * i, t, "system", "first" if t == 0 else f"x{i}") for i in range(30) for t in range(2)]  # one first turn
    out += [(1000, t, "user", str(t // 90)) for t in range(300)]  # a long one, and one that leaves it late
    out += [(1005, t, "user", str(t // 90)) for t in range(280)]
    out += [(7, None, None, None), (7, None, "user", "null turn"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "assistant", "tie"), (8, 1, "user", "eit")]
    out += [(None, 0, "user", "no conversation"), (2000, 0, None, None), (33333, 0, "user", "one turn")]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conversations"))
    data = [(*r, i, "x") for i, r in enumerate(rows())]
    spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, n bigint, path string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    return path


def found(df):
    assert sorted(df.columns) == sorted(NAMES)
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def test_query_against_all_prefixes(spark, table):
    assert found(queries()["op13_conversation_trie"](spark, table)) == trie(rebuilt(rows()))


@pytest.mark.parametrize("group", [25, 6])
def test_common_prefixes_are_peeled_by_rounds(spark, table, group, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK", 9)
    convs = tries.paths(spark.read.parquet(f"{table}/conversations.parquet"), tries.shared_heads)
    assert found(tries.prefix_trie(convs, group)) == trie(rebuilt(rows()))


def test_empty_and_turnless(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert tries.prefix_trie(tries.paths(none)).collect() == []
    # the first of its family is absent and it takes more turns from it than it has
    c = next(x for x in range(1, 100) if x % 5 and tries.shared_heads(x) > 1)
    one = spark.createDataFrame([(c, 0, "user", "gone")], "conv_id bigint, turn bigint, role string, text string")
    assert found(tries.prefix_trie(tries.paths(one, tries.shared_heads))) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
