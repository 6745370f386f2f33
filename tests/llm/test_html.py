"""Main text of pages whose marks mislead, of pages without an article element, and of odd ones."""

import time

import pytest

from cairn.llm.html import extract_pages, main_text

LONG = "A sentence of the article that is long enough to be text on any page, and then some more of it."


def around(body):
    return f"<html><body><nav><a href=/>Menu</a></nav>{body}<footer>Imprint of the page, with an address and more</footer></body></html>"


@pytest.mark.parametrize(
    "body, text",
    [
        (f'<article><p title="the hidden cost">Kept paragraph.</p><p>{LONG}</p></article>', f"Kept paragraph.\n{LONG}"),
        (f'<article><p class="notice-period">Four weeks.</p><p class="share-price">12</p><p>{LONG}</p></article>', f"Four weeks.\n12\n{LONG}"),
        (f'<article><p>{LONG}</p></article><section class="readerComments"><article class="comment"><p>{LONG} Not mine.</p></article></section>', LONG),
        (f'<article><p>{LONG}</p></article><article class="comment"><p>{LONG} Not mine.</p></article>', LONG),
        (f'<div class="siteNav"><p>{LONG} Go there.</p></div><article><p>{LONG}</p></article>', LONG),
        (f'<div class="content has-sidebar"><article><p>{LONG}</p></article></div>', LONG),
        (f'<div id="page" class="right-sidebar"><article><p>{LONG}</p></article><div class="sidebar">{LONG} Aside.</div></div>', LONG),
        (f'<div class="post comments-open"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f'<article><p>{LONG}</p><section class="legal">The law.</section><div class="side-by-side">Two.</div></article>', f"{LONG}\nThe law.\nTwo."),
        (f'<article><p>{LONG}</p><div class="ad">Buy {LONG}</div><div class="share"><a href=x>Share</a></div><aside>{LONG}</aside></article>', LONG),
        (f'<form id="frm"><div><article><p>{LONG}</p></article></div></form>', LONG),
        (f'<div class="related"><article><p>{LONG} Elsewhere.</p></article></div><main><p>{LONG}</p><p>End.</p></main>', f"{LONG}\nEnd."),
        # without an article element
        (f"<div><h1>A verse</h1><p>{LONG}</p><ul><li>one</li><li>two</li><li>three</li><li>four</li><li>five</li></ul><p>{LONG}</p><p>The end.</p></div>", f"A verse\n{LONG}\none\ntwo\nthree\nfour\nfive\n{LONG}\nThe end."),
        (f'<div><a href=a>One link</a> <a href=b>another link</a></div><div><p>{LONG}</p></div><div class="cookie-notice">{LONG} Cookies.</div><div id="comments"><p>{LONG} Me too.</p><p>{LONG} I differ.</p></div>', LONG),
        (f'<div class="widget"><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        ("<div><p>Hi.</p></div>", "Hi."),
        (f"<article><header><p>By someone</p></header><p>{LONG}<br>a &lt;b&gt; &#228; &amp;amp;</article>", f"{LONG} a <b> ä &amp;"),
    ],
)
def test_main_text(body, text):
    assert main_text(around(body)) == text


VERSE = "".join(f"<p>line {i}</p>" for i in range(30))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>Hello.</p><p>A little more text.</p><p>x</p>", "Hello.\nA little more text.\nx"),
        (f"<article><p>{LONG}</p><p><a href=x>See the whole list</a></p><p>{LONG}</p></article>", f"{LONG}\nSee the whole list\n{LONG}"),
        (f"<article>{VERSE}</article><p>{LONG[:40]}</p>", "\n".join(f"line {i}" for i in range(30))),
        (f'<main><p>{LONG}</p></main><div class="discussion"><p>{LONG} Not mine.</p></div>', LONG),
    ],
)
def test_short_pages_and_lines_of_links(page, text):
    assert main_text(page) == text


def test_windows_find_the_text_where_no_element_names_it():
    """The same text whether or not elements name the article, between a menu, a side column and a footer of short lines."""
    body = f"<h1>The title of it</h1><p>{LONG}</p><p>Short.</p><ul><li>one</li><li>two</li></ul><p>{LONG} And more.</p>"
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(9))
    page = f"<div><ul>{menu}</ul></div><div>{{}}</div><div><p>12 Oct</p></div><div><p><a href=/>Home</a></p><p>Top</p><p>Imprint</p></div>"
    named = main_text(page.format(f"<article>{body}</article>"))
    assert named == main_text(page.format(f"<div>{body}</div>")) == f"The title of it\n{LONG}\nShort.\none\ntwo\n{LONG} And more."


@pytest.mark.parametrize("page", ["<b></i>" * 100_000, "<textarea>" * 100_000, "<div><b>" + "<b>" * 50_000 + "<p>x" * 50_000, '<a "' * 100_000, '<a x="' * 100_000, "<" * 200_000, "<!--" * 100_000, "<div>" * 100_000 + "x", "<a " + "= " * 200_000])
def test_long_odd_pages_take_linear_time(page):
    began = time.time()
    main_text(page)
    assert time.time() - began < 5


def test_rows_with_nulls_repeats_and_other_columns(spark):
    page = around(f"<article><p>{LONG}</p></article>")
    rows = [(1, "u", page, "t", 1), (1, "u", page, "t", 1), (None, None, page, "t", 1), (2, "u", None, "t", 1), (3, "u", "", None, None)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, LONG, len(LONG)), (1, LONG, len(LONG)), (1, LONG, len(LONG)), (2, "", 0), (3, "", 0)]
