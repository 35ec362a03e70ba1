"""Exchange of labels, weights, the perceptual hash and odd rows, operator by operator and stage by stage."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import media, mixing, packing, pages, quality


def views(rng, n, noise):
    """Rows whose metadata view tells the class, and whose text view does so with noise."""
    y = (rng.random(n) < 0.5).astype(float)
    meta = np.stack((y + 0.05 * rng.standard_normal(n), rng.standard_normal(n)), 1).astype(np.float32)
    text = rng.standard_normal((n, 40)).astype(np.float32)
    text[:, 0] += (2 * y - 1) * noise
    return text, meta, y


def test_views_teach_each_other(monkeypatch):
    rng = np.random.default_rng(1)
    text, meta, y = views(rng, 60, 1.2)
    pool_text, pool_meta, _ = views(rng, 1500, 1.2)
    held_text, held_meta, held_y = views(rng, 2000, 1.2)
    right = lambda m: ((m.scores(held_text, held_meta)[0] >= 0.5) == (held_y == 1)).mean()
    taught = right(quality.co_train(text, meta, y, pool_text, pool_meta))
    monkeypatch.setattr(quality, "ROUNDS", 0)
    alone = right(quality.co_train(text, meta, y, pool_text, pool_meta))
    assert taught >= alone + 0.03  # pseudo-labels of the metadata view help the text view


def test_combination_follows_the_view_that_knows():
    rng = np.random.default_rng(2)
    text, meta, y = views(rng, 400, 0.0)
    model = quality.co_train(text, meta, y, text[:0], meta[:0])
    held_text, held_meta, held_y = views(rng, 500, 0.0)
    p_text, p_meta, p = model.scores(held_text, held_meta)
    for q in (p_meta, p):
        assert ((q >= 0.5) == (held_y == 1)).mean() > 0.97
    assert abs(((p_text >= 0.5) == (held_y == 1)).mean() - 0.5) < 0.1
    # calibrated: of rows given p some share p is good
    assert abs(p.mean() - held_y.mean()) < 0.05


def test_few_labels_reject_nothing(spark, odd):
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.good_documents(odd, quality.fit(odd, labels)).count() == odd.count()


def test_perceptual_hash_brute_force():
    rng = np.random.default_rng(3)
    for height in (1, 3, 32, 50, 97):
        pixels = rng.integers(0, 256, (height, 192), dtype=np.uint8)
        edge = lambda n, i: i * n // 32
        mean = np.zeros((32, 32))
        for i in range(32):
            for j in range(32):
                y0, x0 = edge(height, i), edge(192, j)
                mean[i, j] = pixels[y0 : max(edge(height, i + 1), y0 + 1), x0 : max(edge(192, j + 1), x0 + 1)].astype(float).mean()
        low = [round(sum(mean[i, j] * math.cos(math.pi * (2 * i + 1) * u / 64) * math.cos(math.pi * (2 * j + 1) * v / 64) for i in range(32) for j in range(32)), 3) for u in range(8) for v in range(8)]
        middle = float(np.median(low[1:]))
        want = sum((1 << (63 - k)) for k, x in enumerate(low) if x > middle)
        got = int(media.perceptual_hash(pixels), 16)
        assert bin(got ^ want).count("1") <= 1  # rounding at the median


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null texts and columns, ties, very long texts, clashing names."""
    r = random.Random(6)
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(60_000))
    rows = [(1, "one two three four five six", "en", "src1"), (1, "one two three four five six", "en", "src1"), (1, "other words of the same id", None, None), (2, long, "de", "src2"), (3, None, "en", "src1"), (4, "", None, "src9"), (None, "a text without an id here", "fr", "src3"), (None, None, None, None), (5, "x" * 200_000, "es", "src1"), (6, "one two three four five six\nseven", "en", "src1")]
    rows += [(10 + i, f"line number {i % 3} with some six words\nshared line of quite a few words", "en", "src1") for i in range(8)]
    rows = [(*x, len(x[1]) if x[1] else None, -1, "v", 0.5, 7) for x in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, length bigint, domain string, budget double, piece int").repartition(3)


def test_packing_of_odd_rows(odd):
    got = packing.pack_documents(odd).toPandas()
    assert got.doc_id.isna().sum() == 2 and (got.doc_id == 1).sum() == 3
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all() and packed.groupby("sequence_id").length.sum().max() <= 2048
    long = got[got.doc_id == 2].sort_values("piece")
    assert list(long.start) == [2048 * i for i in range(len(long))] and (long.length[:-1] == 2048).all()


def test_media_of_odd_rows(odd):
    got = media.to_media(odd).collect()
    assert len(got) == odd.count()
    assert sorted(str((r.n_bytes, r.payload_sha256, r.tail_crc32)) for r in got) == sorted(str((len(t), hashlib.sha256(media.payload_of(t)).hexdigest(), zlib.crc32(media.payload_of(t)[-16:]))) for t in ((r.text or "").encode() for r in odd.collect()))


def test_scores_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, int(i in (1, 2, 10, 11)), 0) for i in (1, 2, 4, 5, 10, 11, 12, 13)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd, labels)
    assert model.text is not None
    got = quality.scored(odd, model).toPandas()
    assert len(got) == odd.count() and got[["p_text", "p_meta", "p_quality"]].apply(lambda c: c.between(0, 1).all()).all()
    assert quality.scored(odd.limit(0), model).count() == 0
    assert quality.fit(odd.limit(0), labels).text is None


def test_mixing_of_odd_rows(odd):
    got = mixing.mix(odd, 0.9, 2).toPandas()
    assert got.doc_id.notna().all() and (got.tokens > 0).all()
    for _, leaf in got.sort_values("start").groupby(["domain", "lang", "source", "epoch"]):
        assert (leaf.tokens.cumsum() - leaf.tokens == leaf.start).all()


@pytest.mark.parametrize("part_rows", [512, 1])
def test_target_weights_brute_force(spark, monkeypatch, part_rows):
    """Water levels level by level, with weights for domains, languages and sources."""
    monkeypatch.setattr(mixing, "PART_ROWS", part_rows)
    r = random.Random(5)
    rows = [(i, "w " * r.choice([1, 4, 9]), r.choice(["en", "de"]), r.choice(["a", "b", "c"])) for i in range(400)]
    rows += [(1000 + i, "w " * 5, "en", "rare") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    weights = [("domain", "x", 3.0), ("domain", "y", 1.0), ("lang", "en", 1.0), ("lang", "*", 4.0), ("source", "rare", 50.0)]
    got = mixing.mix(df, 0.5, 1, weights=mixing.weight_table(spark, weights), domain_=F.when(F.col("source") == "c", "y").otherwise("x")).toPandas()
    given = {(a, b): w for a, b, w in weights}
    leaves: dict = {}
    for _, t, lang, source in rows:
        key = ("y" if source == "c" else "x", lang, source)
        leaves[key] = leaves.get(key, 0) + len(t.split())

    def shared(budget, nodes):
        """nodes: name -> (weight, capacity)"""
        out, left = {}, dict(nodes)
        while left:
            level = budget / sum(w for w, _ in left.values())
            full = {n for n, (w, c) in left.items() if c <= w * level + 1e-9}
            if not full:
                return out | {n: w * level for n, (w, _) in left.items()}
            for n in full:
                out[n] = left.pop(n)[1]
                budget -= out[n]
        return out

    def below(path, budget):
        depth = len(path)
        if depth == 3:
            return {path: budget}
        names = {k[depth] for k in leaves if k[:depth] == path}
        level = mixing.TREE[depth]
        nodes = {n: (given.get((level, n), given.get((level, "*"), 1.0)), sum(v for k, v in leaves.items() if k[: depth + 1] == (*path, n))) for n in names}
        return {k: v for n, b in shared(budget, nodes).items() for k, v in below((*path, n), b).items()}

    want = below((), sum(leaves.values()) // 2)
    for key, budget in want.items():
        mine = got[(got.domain == key[0]) & (got.lang == key[1]) & (got.source == key[2])]
        taken = int(mine.tokens.sum())
        # the shortest prefix that reaches the budget
        assert taken >= math.floor(budget + 1e-6) and taken - (mine.sort_values("start").tokens.iloc[-1] if len(mine) else 0) < budget + 1e-6 if budget >= 1 else taken <= 9


def test_pages_of_odd_rows(spark):
    rows = [(1, "http://h/1", "<article>one</article>", "x"), (1, "http://h/1", "<article>two</article>", "y"), (None, None, "<p>free", "z"), (None, "http://h/2", None, None), (7, "http://h/3", "<p>" + "word " * 100_000, "q")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text[:9], r.n_chars) for r in pages.main_text(df).collect())
    assert got == [(0, "", 0), (0, "free", 4), (1, "one", 3), (1, "two", 3), (7, "word word", 499_999)]
    assert pages.main_text(df.limit(0)).count() == 0


DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, odd, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    got = stage(spark, docs, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == docs.columns
        assert {r.doc_id for r in got.collect()} <= {r.doc_id for r in docs.collect()}
    else:
        assert got.where("doc_id is not null").select("doc_id").distinct().count() == docs.where("doc_id is not null").select("doc_id").distinct().count()
    assert stage(spark, spark.createDataFrame([], DOC), sf).count() == 0


def test_run_leaves_only_what_its_result_reads(spark, sf, tmp_path, monkeypatch):
    from tilewright.plans import iterate

    monkeypatch.setattr(iterate, "scratch", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["pieces", "slots", "stage"]
    with iterate.steps(spark):
        assert corpus_pipeline.run(spark, sf).count() > 0
    assert len(list(tmp_path.iterdir())) == 3


def test_line_stage_brute_force(spark, odd, sf):
    """Runs of lines of six words or more that occur earlier go; a document of nothing else goes."""
    docs = odd.where("doc_id >= 10").select("doc_id", "text", "lang", "source", "n_chars")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, sf).collect()}
    assert got == {10: "line number 0 with some six words\nshared line of quite a few words", 11: "line number 1 with some six words", 12: "line number 2 with some six words"}


def test_mixing_stage_takes_whole_documents_in_seeded_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.mixing_to_weights(spark, docs, sf).collect()}
    taken = mixing.mix(docs, 0.8, 1).toPandas()
    assert kept == set(taken.doc_id)
    rows = docs.toPandas()
    rows["tokens"] = rows.text.fillna("").str.split().str.len()
    rows["domain"] = "d" + (rows.source.str.extract(r"(\d+)$")[0].astype(float).fillna(999999999) % 4).astype(int).astype(str)
    for key, leaf in taken.groupby(["domain", "lang", "source"]):
        mine = rows[(rows.domain == key[0]) & (rows.lang == key[1]) & (rows.source == key[2]) & (rows.tokens > 0)]
        order = sorted(mine.doc_id, key=lambda i: (hashlib.md5(f"7-0-{i}".encode()).hexdigest(), i))
        assert order[: len(leaf)] == list(leaf.sort_values("start").doc_id)
