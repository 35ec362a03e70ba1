"""Every page goes through its host's search of repeated runs; the structure checks what it finds."""

from tilewright.llm import pages

WORDS = " ".join(f"w{i}" for i in range(20))


def test_marked_pages_are_searched(spark, monkeypatch):
    rows = [(1, "http://h/a", f"<body><p>{WORDS}</p><article><p>one {WORDS} end</p></article></body>"), (2, "http://h/b", f"<body><article><p>two {WORDS}</p></article></body>"), (3, "http://g/c", "<article><p>three</p></article>"), (4, "http://g/d", "")]
    judged = {}
    search = pages.with_runs

    def spy(docs, *args, **more):
        out = search(docs, *args, **more)
        judged.update({r.page_id: (r.text, r.found) for r in out.collect()})
        return out

    monkeypatch.setattr(pages, "with_runs", spy)
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    # the run that two articles share is found, and stays as their pages mark it as main text
    assert judged.keys() == {1, 2, 3, 4} and judged[1][1] and judged[2][1] and not judged[3][1]
    assert WORDS in judged[2][0]
    assert got == {1: f"one {WORDS} end", 2: f"two {WORDS}", 3: "three", 4: ""}
