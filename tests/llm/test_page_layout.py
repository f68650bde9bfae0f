from __future__ import annotations

import pytest

from panelyst.llm import pages

INSIDE = "<article><p>one<p>two<div class='share-buttons'>share</div></article>"
COMMENTS = "<div class='post-comments'><article>first!</article></div>"


def rows_of(frame, html, n=4):
    rows = [(k, "http://h.example/", html.replace("one", f"one{k}")) for k in range(n)]
    return {r["page_id"]: r["text"] for r in pages.extract(frame(rows, "page_id long, url string, html string")).collect()}


def text_of(html):
    """With the template of a host whose pages all are like this one: its elements, and the text of its buttons."""
    page = pages.parse(html)
    texts = (pages.text_token(around, text) for around, text in page.blocks if text == "share")
    return pages.main_text(page, frozenset((*(t[:-1] for t in page.tokens), *texts)))


@pytest.mark.parametrize("name", ["site has-sidebar", "no-sidebar", "with-banner", "menu-open", "social-science", "banner"])
def test_a_layout_class_around_the_article_drops_nothing(name):
    assert text_of(f"<body><div class='{name}'>{INSIDE}</div></body>") == "one\ntwo"
    assert text_of(f"<body><div id='{name.split()[-1]}'><main>{INSIDE}</main></div></body>") == "one\ntwo"


def test_what_is_not_around_all_articles_still_goes():
    assert text_of(f"<body><div class='site has-sidebar'>{INSIDE}{COMMENTS}<div class=sidebar>x</div></div></body>") == "one\ntwo"
    assert text_of(f"<body>{INSIDE}{COMMENTS}</body>") == "one\ntwo"
    assert text_of("<body><div>story</div><div class=comments><article>first!</article></div></body>") == "story"


def test_the_query_keeps_such_pages(frame):
    got = rows_of(frame, f"<body><div class='site has-sidebar'>{INSIDE}</div></body>")
    assert got == {k: f"one{k}\ntwo" for k in range(4)}
