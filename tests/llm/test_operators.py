"""Each operator against brute force on small tables with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import columns, jaccard, lines, media, mixing, packing, pages, quality, substrings, topk
from tilewright.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["Été", "ß", "naïve,", "x" * 300]
    base = [[r.choice(vocab) for _ in range(r.choice([1, 3, 60, 140]))] for _ in range(24)]
    shared = [r.choice(vocab) for _ in range(70)]
    out = []
    for b in base:
        if r.random() < 0.5:
            at = r.randrange(len(b) + 1)
            b = b[:at] + shared[r.randrange(10) :] + b[at:]
        out.append(" ".join(w + ("\n" if r.random() < 0.1 else "") for w in b))
    out += [out[3], out[3], out[5].upper(), out[5] + " tail", out[7].replace("w1 ", "w2 ", 1), "", "  \n\n ", "one", "a b c", "A b C", "y " * 4000, "ab" * 400]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    t = texts()
    rows = [(i * 3, x, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(x) if i % 7 else None, i, -1, "k") for i, x in enumerate(t)]
    rows.append((999, None, None, None, None, 0, 0, None))
    # extra columns with names that the operators use inside
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, v bigint, found int, name string").repartition(3)


def pairs(docs):
    return sorted((r.doc_id, r.text or "") for r in docs.collect())


def test_substrings(docs):
    first, want = {}, {}
    for i, t in pairs(docs):
        w = WORD.findall(t)
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    for i, t in pairs(docs):
        w = WORD.findall(t)
        gone = np.zeros(len(w), bool)
        for j in range(len(w) - 49):
            if first[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept)
    for fit in (None, 3, 2, 1):
        got = {r[0]: tuple(r[1:]) for r in substrings.dedup_substrings(docs, fit=fit).collect()}
        assert got == want
    assert sum(v[1] for v in want.values()) > 100


def test_bytes(docs):
    seen, want = set(), {}
    for i, t in pairs(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 99):
            if b[j : j + 100] in seen:
                gone[j : j + 100] = True
            seen.add(b[j : j + 100])
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    for fit in (None, 3, 2, 1):
        got = {r[0]: (*r[1:5], bytes(r[5])) for r in columns.dedup_bytes(docs, fit=fit).collect()}
        assert got == want


def test_rounds_of_insertion():
    rng = np.random.default_rng(5)
    cols = rng.integers(97, 100, (60, 12)).astype(np.uint16)
    for i in range(60):  # strings end at different places
        cols[i, rng.integers(3, 13) :] = columns.END
    cols[40:50] = cols[:10]
    group = rng.integers(0, 5, 60)
    rounds = []

    def watch(c, order, segment, lcp):
        rounds.append(c)
        text = lambda i: [int(x) for x in cols[i, c:]]
        assert [(group[i], text(i)) for i in order] == sorted((group[i], text(i)) for i in range(60))
        previous = [i for _, _, i in sorted((group[i], [int(x) for x in cols[i, c + 1 :]], k) for k, i in enumerate(range(60)))]
        assert sorted(segment.tolist()) == sorted(cols[previous, c].tolist())
        for at in range(60):
            want = -1
            if at and group[order[at]] == group[order[at - 1]]:
                a, b = text(order[at - 1]), text(order[at])
                want = next((k for k in range(len(a)) if a[k] != b[k] or a[k] == columns.END), len(a))
            assert lcp[at] == want

    columns.inserted(cols, group, watch=watch)
    assert rounds == list(range(11, -1, -1))


def sets(t, n):
    w = WORD.findall(t.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def linked(pairs_, n, percent):
    s = {i: sets(t, n) for i, t in pairs_}
    up = {i: i for i in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in s:
        for j in s:
            if i < j and s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s[i]), root(i)) for i in s}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(docs, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, n, percent).collect()}
    assert got == linked(pairs(docs), n, percent)
    kept = {r.doc_id for r in jaccard.one_of_each_group(docs, n, percent).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


def test_jaccard_of_large_regions(spark, monkeypatch):
    r = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 6])):
            words[r.randrange(120)] = f"n{i}x{r.randrange(99)}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, " ".join(f"u{i}x{k}" for k in range(50))) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "REGION_ROWS", 7)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, 4, 85).collect()}
    assert got == linked(rows, 4, 85)


def test_region_links_on_chains():
    r = random.Random(2)
    base = list(range(200))
    chain = []
    for step in range(30):
        chain.append(np.array(sorted(set(base)), np.uint64))
        for _ in range(6):
            base[r.randrange(200)] = 1000 + r.randrange(10**9)
    other = [np.array(sorted(r.sample(range(10**6), 150)), np.uint64) for _ in range(10)]
    keys = chain + other
    up = jaccard.Union(len(keys))
    for a, b in jaccard.region_links(keys, 85):
        up.join(a, b)
    want = jaccard.Union(len(keys))
    for i in range(len(keys)):
        for j in range(i):
            k = len(np.intersect1d(keys[i], keys[j]))
            if 100 * k >= 85 * (len(keys[i]) + len(keys[j]) - k):
                want.join(i, j)
    assert [up.root(i) for i in range(len(keys))] == [want.root(i) for i in range(len(keys))]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_lines(docs):
    strip = " \t\n\x0b\x0c\r"
    table = {i: (t.split("\n"), [(k, x.strip(strip), len(WORD.findall(x))) for k, x in enumerate(t.split("\n")) if x.strip(strip)]) for i, t in pairs(docs)}
    seen, want = {}, {}
    runs = lambda nb: ((s, e) for s in range(len(nb)) for e in range(s, min(len(nb), s + 14)) if sum(x[2] for x in nb[s : e + 1]) >= 6)
    for i, (_, nb) in table.items():
        for s, e in runs(nb):
            seen.setdefault(tuple(x[1] for x in nb[s : e + 1]), (i, s))
    for i, (raw, nb) in table.items():
        gone = {nb[k][0] for s, e in runs(nb) if seen[tuple(x[1] for x in nb[s : e + 1])] < (i, s) for k in range(s, e + 1)}
        want[i] = (len(nb), len(gone), "\n".join(x for k, x in enumerate(raw) if k not in gone))
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in lines.dedup_lines(docs).collect()}
    assert got == want
    kept = {r.doc_id: r for r in lines.without_repeated_lines(docs, length_col="n_chars").collect()}
    assert set(kept) == {i for i, (n, g, _) in want.items() if not g or g < n}
    assert all((r.text or "") == want[i][2] for i, r in kept.items() if want[i][1])


def test_top_k_brute_force():
    rng = np.random.default_rng(3)
    for hi in (3, 200, 10**5):
        v = rng.integers(-hi, hi + 1, (300, 9))
        v[100:200] = v[0]
        q = rng.integers(-hi, hi + 1, (70, 9))
        ids, q_ids = rng.permutation(300), np.arange(70)
        got = list(zip(*(x.tolist() for x in topk.search_block(ids, v, q_ids, q, 5))))
        want = [(i, y, -s) for i in range(70) for s, y in sorted((-int(a), int(b)) for a, b in zip(v @ q[i], ids) if b != i)[:5]]
        assert got == want


def test_top_k_table(spark):
    rows = [(i, [float((i * j) % 7 - 3) / 8 for j in range(6)], "x") for i in range(0, 120)] + [(500, None, "x"), (550, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x"), (600, [float("nan")] * 6, "x"), (650, [0.5, 0.5], "x"), (None, [0.0] * 6, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=16).orderBy("query_id", "rank").collect()]
    fine = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows[:120]}
    want = []
    for q in (0, 50, 100):
        best = sorted((-int(v @ fine[q]), i) for i, v in fine.items() if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_top_k_slices_decide(sf, scale):
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf.replace('sf0.001', scale)}/embeddings.parquet").to_pydict()
    v, ids = np.floor(256 * np.array(t["embedding"], float)).astype(np.int64), np.array(t["vec_id"])
    planes, low, _ = topk._slices(v, topk.SLICES)
    valid = np.packbits(np.arange(planes.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    left = [len(topk.boundary_rows(planes, low, q, valid, 5)) for q in v[ids % 50 == 0]]
    assert np.mean(left) <= 0.05 * len(v)


def test_top_k_repeated_ids_and_wide_values(spark):
    rows = [(0, [1.0, 2.0]), (0, [0.5, 2.0]), (1, [3.0, 1.0]), (1, [4.0, 0.0]), (2, [1e7, -1e7]), (50, [1e7, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=3).where("query_id = 0").orderBy("rank").collect()]
    q = (128, 512)  # the least vector of id 0; no row of id 0 is its candidate, both rows of id 1 are
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i]
    best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in fine)[:3]
    assert got == [(0, k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_packing(docs):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack_documents(docs).toPandas().sort_values(["doc_id", "piece"])
    for i, t in pairs(docs):
        ids = encoder.encode(t, add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == i]
        assert mine.length.sum() == len(ids) and list(mine.start) == list(range(0, len(ids), 2048))
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    packed = got.sort_values(["sequence_id", "offset"])
    assert (packed.groupby("sequence_id").length.cumsum() - packed.length == packed.offset).all()
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert packed.sequence_id.nunique() <= -(-packed.length.sum() // 2048) + 1


def test_odd_words():
    from tokenizers import Tokenizer

    encoder, mine = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path())
    r = random.Random(1)
    parts = ["a", "B", "É", "×", "'", "'s", "it's", "!", "...", "12", "<|endoftext|>", "́", "Σ", "—", " ", " ", "\n", "中", "🙂", "\x1c", "İ", "."]
    for t in ("".join(r.choice(parts) for _ in range(12)) for _ in range(2000)):
        data = np.frombuffer(t.encode(), np.uint8)
        assert mine(data, np.array([0, len(data)]))[0].tolist() == encoder.encode(t, add_special_tokens=False).ids


def test_best_two_fit_holds_all_pieces():
    r = random.Random(9)
    counts = {}
    for _ in range(3000):
        n = min(2048, int(r.lognormvariate(6, 1)) + 1)
        counts[n] = counts.get(n, 0) + 1
    left = dict(counts)
    bins = 0
    for pattern, times in packing.best_two_fit(counts):
        assert sum(pattern) <= 2048
        bins += times
        for n in pattern:
            left[n] -= times
    assert not any(left.values()) and bins <= sum(n * c for n, c in counts.items()) / 2048 * 1.02 + 1


def test_media(docs):
    for r in media.to_media(docs).collect():
        t = dict(pairs(docs))[r.id].encode()
        payload = media.payload_of(t)
        assert media.decode_png(bytes(r.media)).tobytes() == payload and r.payload_bytes == len(payload) and len(payload) % 192 == 0
        assert (r.n_bytes, r.payload_sha256, r.tail_crc32) == (len(t), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest()


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    for kind in range(5):
        rows = np.zeros_like(want)
        for y in range(5):
            for x in range(7):
                a = int(want[y, x - 1]) if x else 0
                b = int(want[y - 1, x]) if y else 0
                c = int(want[y - 1, x - 1]) if x and y else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                rows[y, x] = (int(want[y, x]) - (0, a, b, (a + b) // 2, near)[kind]) & 255
        assert (media.unfilter(np.full(5, kind), rows) == want).all()
    image = bytearray(media.encode_png(bytes(range(192))))
    image[-30] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(image))


def test_pages(spark):
    rows = [(i, f"http://h{i % 2}.x/{i}", "<html><nav>Home</nav><article><h1>T &amp; x</h1><p>a  b<br>c<div class='comments'>no</div><p>" + "d" * i + "</article><footer>f") for i in range(6)]
    rows += [(None, None, None), (50, "u", ""), (51, "u", "plain &lt;text&gt;")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == "T & x\n\na b c" + ("\n\n" + "d" * i if i else "") for i in range(6))
    assert got[None] == "" and got[50] == "" and got[51] == "plain <text>"


def test_host_runs(spark):
    menu = "Home About Contact Products Services Careers Press Legal Privacy Terms Imprint Help Login Now"
    rows = [(i, f"http://h{i % 2}.x/{i}", f"<body><div>{menu}</div><div>{' '.join(f'only{i}x{k}' for k in range(20))}</div>") for i in range(4)] + [(9, "http://z.z/", f"<div>{menu}</div>")]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == " ".join(f"only{i}x{k}" for k in range(20)) for i in range(4)) and got[9] == menu


def test_real_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in pages.main_text(df).collect()}
    for r in df.collect():
        body = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")]
        found = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(b for b in found if b)
        assert got[r.page_id] == (want, len(want))


def test_quality(spark, sf):
    base = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    model = quality.fit(docs, train)
    held = quality.scored(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert ((held.p_quality >= 0.5) == (held.quality == 1)).mean() >= 0.97
    assert quality.good_documents(docs, model).columns == docs.columns


def test_quality_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.p_quality for r in quality.scored(docs, quality.fit(docs, none)).collect()} == {1.0}
    one = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (6, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.good_documents(docs, quality.fit(docs, one)).count() == docs.count()


def test_mixing(docs):
    got = mixing.mix(docs, 0.8, 2).toPandas()
    total = sum(len(WORD.findall(t)) for _, t in pairs(docs))
    assert got.tokens.sum() >= int(total * 0.8) - 5
    assert set(got.epoch) <= {0, 1} and not got.duplicated(["doc_id", "epoch"]).any()
    for _, leaf in got.sort_values("start").groupby(["domain", "lang", "source", "epoch"]):
        assert (leaf.tokens.cumsum() - leaf.tokens == leaf.start).all()


EMPTY = [lambda d: substrings.dedup_substrings(d), lambda d: columns.dedup_bytes(d), lambda d: jaccard.jaccard_components(d), lambda d: lines.dedup_lines(d), lambda d: mixing.mix(d), lambda d: packing.pack_documents(d), lambda d: media.to_media(d)]


@pytest.mark.parametrize("k", range(len(EMPTY)))
def test_empty_table(docs, k):
    assert EMPTY[k](docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(1, t), (1, t), (2, t), (None, t), (None, None), (2, t + " more")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for run in EMPTY[:4]:
        out = run(df)
        assert out.count() == 6
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.dedup_substrings(df).collect())
    assert got == [(0, 0, 0), (0, 80, 0), (1, 80, 0), (1, 80, 0), (2, 80, 80), (2, 81, 80)]
