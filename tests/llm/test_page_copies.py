"""Pages that are copies of one text, and articles inside boilerplate."""

from tilewright.llm import pages

SCHEMA = "page_id bigint, url string, html string"
MENU = "Home About Contact Products Services Careers Press Legal Privacy Terms Imprint Help Login Now"


def words(name, n=30):
    return " ".join(f"{name}{k}" for k in range(n))


def texts(spark, rows):
    return sorted(((r.page_id, r.url, r.text) for r in pages.main_text(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def test_copies_of_an_unmarked_page_stay(spark):
    page = f"<nav>{MENU}</nav><div>{words('a')}</div>"
    rows = [(1, "http://h/a", page), (2, "http://h/a?utm=1", page), (3, "http://h/print/a", f"<div>{words('a')}</div>"), (4, "http://h/b", f"<div>{words('b')}</div>"), (None, "http://h/a", page)]
    want = {1: "a", 2: "a", 3: "a", 4: "b", None: "a"}
    assert texts(spark, rows) == sorted(((i, u, words(want[i])) for i, u, _ in rows), key=str)


def test_runs_that_copies_share_with_other_pages_go(spark):
    page = f"<div>{MENU}</div><div>{words('a')}</div>"
    rows = [(1, "http://h/a", page), (2, "http://h/a?utm=1", page), (3, "http://h/b", f"<div>{MENU}</div><div>{words('b')}</div>")]
    assert [t for _, _, t in texts(spark, rows)] == [words("a"), words("a"), words("b")]


def test_a_copys_menu_is_searched(spark):
    rows = [(1, "http://h/a", f"<div>{words('a')}</div>"), (2, "http://h/a?utm=1", f"<nav>{MENU}</nav><div>{words('a')}</div>"), (3, "http://h/b", f"<div>{MENU}</div><div>{words('b')}</div>")]
    assert [t for _, _, t in texts(spark, rows)] == [words("a"), words("a"), words("b")]


def main(html):
    return [t for zone, t in pages.blocks(html) if zone == pages.MAIN]


def test_articles_inside_boilerplate():
    assert main("<article>text</article><div class='comments'><div><article>reader</article></div></div>") == ["text"]
    assert main("<aside><article>teaser</article></aside><article>text</article>") == ["text"]
    assert main("<article class='comment'>reader</article><article>text</article>") == ["text"]
    assert main("<nav>menu<article>text</article>") == ["text"]
    assert main("<div class='promo'><article>only</article></div>") == ["only"]


def test_class_words_and_inline_comments():
    assert main("<article><p class='share-prices'>prices rose</p><div class='share-buttons'>Share</div><p>end</p></article>") == ["prices rose", "end"]
    assert main("<article><p>a <span class='comment'>no</span> b</p><pre>x <span class='comment'># y</span></pre></article>") == ["a b", "x # y"]
    assert main("<aside><article class='card'>teaser</article></aside><main><h1>T</h1><section id='commentList'><article>me</article></section></main>") == ["T"]
    assert main("<article class='advert'>buy</article><article>text</article><div class='cookie-banner'>ok</div>") == ["text"]
    assert [z for z, _ in pages.blocks("<div class='site-header'>menu</div><div class='article-header'>title</div>")] == [pages.BOILERPLATE, pages.OPEN]


def test_copies_with_other_menus(spark):
    menu = "Home About Contact Products Services Careers Press Legal Privacy Terms Imprint Help Login Now"
    story = " ".join(f"story{k}" for k in range(40))
    rows = [(1, "http://a.b/1", f"<div>{menu}</div><p>{story}</p>"), (2, "http://a.b/2?print", f"<div>{menu} Back</div><p>{story}</p><p>printed today</p>")]
    rows += [(i, f"http://a.b/{i}", f"<div>{menu}</div><p>{' '.join(f'p{i}x{k}' for k in range(30))}</p><p>he said {' '.join(story.split()[:14])} and then {' '.join(f'q{i}x{k}' for k in range(20))}</p>") for i in (3, 4)]
    rows += [(2, "http://a.b/2?print", rows[1][2]), (None, "http://a.b/5", rows[2][2].replace("p3x", "r9x"))]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "page_id bigint, url string, html string, text string, done int, v int")
    got = sorted((r.page_id or 0, r.text) for r in pages.main_text(df).collect())
    want = {1: story, 2: f"Back\n\n{story}\n\nprinted today"}
    assert [t for i, t in got if i == 1] == [want[1]] and [t for i, t in got if i == 2] == [want[2]] * 2
    for i, t in got:
        if i not in (1, 2):  # the quotation stays
            assert menu not in t and "he said story0" in t and t.count("\n\n") == 1
    assert pages.main_text(df.limit(0)).count() == 0
