from __future__ import annotations

from panelyst.llm import pages


def extracted(frame, htmls):
    rows = [(k, "http://h.example/", html) for k, html in enumerate(htmls)]
    out = pages.extract(frame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in out}


def page(*blocks):
    return f"<html><body><div>Open daily</div>{''.join(blocks)}</body></html>"


def test_copies_on_a_host_count_once(frame):
    """Three pages, two of them copies: their text is on two thirds of the pages, and on half of the distinct ones."""
    got = extracted(frame, [page("<div>the story</div>")] * 2 + [page("<div>another</div>")])
    assert all("the story" in got[k] for k in (0, 1)) and "another" in got[2]
    more = [page("<div>the story</div>")] * 7 + [page(f"<div>tale {k}</div>") for k in range(3)]
    got = extracted(frame, more)
    assert got == {**dict.fromkeys(range(7), "the story"), **{7 + k: f"tale {k}" for k in range(3)}}


def test_equal_support_but_unequal_vectors(frame):
    """A note of two pages is template where its element is on the same two, and text where that is on others."""
    same = ["<section class=x>note</section>", "<section class=x>note</section>", ""]
    other = ["<div>shared</div>", "", "<div>shared</div>"]
    got = extracted(frame, [page(a, b, f"<div>own {k}</div>") for k, (a, b) in enumerate(zip(same, other, strict=True))])
    assert got == {0: "shared\nown 0", 1: "own 1", 2: "shared\nown 2"}
