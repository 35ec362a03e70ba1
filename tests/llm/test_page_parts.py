"""Parts of pages by structure, role and class; menus and quoted articles on pages without a main part; odd markup in linear time."""

import time

import pytest

from tilewright.llm import pages

WORDS = "the harbour was quiet that morning and nobody had seen the boats come back from the long banks where the fog had been standing for days".split()


def main(html):
    return [t for zone, t in pages.blocks(html) if zone == pages.MAIN]


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, text string")
    return {r.page_id: r.text for r in pages.main_text(df).collect()}


@pytest.mark.parametrize("name", ["user-comments-v2", "notice--info", "adbox", "google-ads", "commentList", "cookie-banner", "ad-slot-3"])
def test_classes_that_say_boilerplate(name):
    assert main(f'<article><p>Kept.</p><div class="{name}"><p>Gone.</p></div><p>Kept too.</p></article>') == ["Kept.", "Kept too."]


@pytest.mark.parametrize("name", ["share-prices", "has-sidebar", "ad-hoc", "no-comments", "cookie-recipes", "notice-period", "readers"])
def test_classes_that_do_not(name):
    assert main(f'<article><div class="{name}"><p>Kept.</p></div></article>') == ["Kept."]


def test_ids_of_headings_name_their_subject():
    assert main('<article><h2 id="notices">Notices</h2><p id="comments">On comments.</p><div id="comments">Gone.</div></article>') == ["Notices", "On comments."]


def test_role_of_a_main_part():
    html = '<div class="top">Top</div><div role="main"><p>One.</p><div><p>Two.</p></div></div><div>After</div>'
    assert main(html) == ["One.", "Two."]
    assert main('<div role="main"><p>One.</p>') == ["One."]


def test_menus_of_unmarked_pages(spark):
    story = " ".join(WORDS)
    one = f'<div><a href="/">Home</a> <a href="/a">About</a> <a href="/n">News</a></div><p>{story}, says <a href="/x">the paper</a>.</p><ul><li><a href="/1">More</a></li><li><a href="/2">Even more</a></li></ul><p>End.</p><p><a href="/s">Source</a></p>'
    assert texts(spark, [("http://h/1", one)])[0] == f"{story}, says the paper.\n\nEnd.\n\nSource"


def test_articles_that_are_quoted_elsewhere_stay(spark):
    story = " ".join(WORDS * 2)
    page = lambda body: f"<html><body><div><p>{body}</p></div></body></html>"
    longer = " ".join(f"word{i}" for i in range(40)) + " " + story + " " + " ".join(f"more{i}" for i in range(90))
    got = texts(spark, [("http://h/1", page(story)), ("http://h/2", page(story)), ("http://h/3", page(longer))])
    assert got == {0: story, 1: story, 2: longer}


@pytest.mark.parametrize("html", ['<p>x</p>' + '<span class="ad">a ' * 55000, '<a "' * 250001, "<!" * 500000, "<" * 1000000, "<div " + "a" * 1000000 + " =x>t", '<div class="ad">' * 65000, "<aside><article>x</article></aside>" * 30000, '<p title="' * 100001, "<article><div>" * 70000, "<!--" * 250000, "&amp" * 250000], ids=range(11))
def test_a_megabyte_of_odd_markup(html):
    began = time.time()
    pages.blocks(html)
    assert time.time() - began < 6  # some ten times what it takes; the quadratic form took many minutes


def test_unclosed_quotes_keep_the_text():
    assert "Kept." in " ".join(main('<article><p>One.</p><a title="x>link</a><p>Kept.</p></article>' ))
