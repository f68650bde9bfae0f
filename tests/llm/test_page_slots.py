from __future__ import annotations

import random
from collections import Counter

import pytest

from panelyst.llm import pages


def words(rng, n=6):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def site(rng, n, extra=""):
    """Pages of a host with foreign class names, and the main text of each."""
    adverts = [words(rng) for _ in range(3)]
    out = []
    for k in range(n):
        body = [words(rng, 12) for _ in range(rng.randint(2, 5))]
        comments = "".join(f"<div class=kommentar><p>{words(rng)}</div>" for _ in range(rng.randint(1, 4)))
        related = f"<div class=related-work><p>{words(rng)} see also {k}</div>" if k % 7 == 0 else ""
        html = (
            f"<body><div class=kopf>Willkommen</div><article><h1>{body[0]}</h1>"
            f"<div class=werbung>{rng.choice(adverts)}</div>{''.join(f'<p>{p}' for p in body[1:])}{related}"
            f"<section id='social-science'><p>{words(rng)} {k}</section>"
            f"<div class=kommentare><h3>Kommentare</h3>{comments}</div>{extra}</article><div class=fuss>Kontakt</div></body>"
        )
        kept = body + [t for t in (related, html[html.index("<section") :]) if t]
        kept = body + [t.split("<p>")[1].split("<")[0] for t in kept[len(body) :]]
        out.append((html, "\n".join(kept)))
    return out


def extracted(frame, rows):
    out = pages.extract(frame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in out}


def test_slots_of_adverts_and_comments_go_whatever_their_names(frame):
    made = site(random.Random(1), 30)
    got = extracted(frame, [(k, f"http://h.example/{k}", html) for k, (html, _) in enumerate(made)])
    assert got == {k: text for k, (_, text) in enumerate(made)}
    without = {k: pages.main_text(pages.parse(html), frozenset()) for k, (html, _) in enumerate(made)}
    assert all(without[k] != got[k] for k in got)  # the template decides


@pytest.mark.parametrize("name", ["related-work", "social-science", "share-economy"])
def test_a_word_in_a_longer_name_drops_nothing_inside_the_article(name):
    html = f"<body><article><p>one</p><section id='{name}'><p>two</section><div class='{name}'>three</div></article></body>"
    assert pages.main_text(pages.parse(html), frozenset()) == "one\ntwo\nthree"


def test_near_copies_on_a_host_are_no_adverts(frame):
    rng = random.Random(2)
    body = [words(rng, 12) for _ in range(6)]
    rows = []
    for k in range(8):
        own = [*body[:5], f"{body[5]} {k}"]
        html = f"<body><nav>menu</nav><article><div class=intro>{own[0]}</div>{''.join(f'<p>{p}' for p in own[1:])}</article></body>"
        rows.append((k, "http://h.example/", html))
    assert extracted(frame, rows) == {k: "\n".join([*body[:5], f"{body[5]} {k}"]) for k in range(8)}


def test_comments_as_articles_in_an_article():
    html = "<body><article><p>one</p><section><article>first!</article></section><p>two</article></body>"
    assert pages.main_text(pages.parse(html), frozenset()) == "one\ntwo"


def test_deep_places_are_told_apart():
    page = pages.parse("<div>" * 40 + "<p>x</p><section><p>y</section>" + "</div>" * 40)
    places = [around[-1].place for around, _ in page.blocks]
    assert len(set(places)) == 2 and max(map(len, places)) < 200
    assert len({t for t in page.tokens if t.endswith("<")}) == 41


def test_classes_agree_with_brute_force(frame):
    """Vectors written out page by page, for hosts of random pages."""
    rng = random.Random(3)
    rows = []
    for k in range(60):
        parts = [f"<div class={c}>{rng.choice(['note', 'x', words(rng)])}</div>" for c in "abc" if rng.random() < 0.8]
        if rng.random() < 0.6:
            parts.append("<section><p>same</p></section>")
        rows.append((k, f"http://{rng.choice('xyz')}.example/", f"<body>{''.join(parts)}</body>"))
    df = frame(rows, "page_id long, url string, html string").select("page_id", "url", "html")
    got = {r["host"]: set(r["places"]) for r in pages.templates(pages.vectors(df)).collect()}
    for name in "xyz":
        distinct = sorted({html for _, url, html in rows if url == f"http://{name}.example/"})
        counts = [Counter({k: n for k, n in pages.page_tokens(pages.parse(html)).items() if k[0] != "#"}) for html in distinct]
        vectors = {t: tuple(c[t] for c in counts) for c in counts for t in c}
        large = {t: v for t, v in vectors.items() if 2 * sum(n > 0 for n in v) >= len(distinct)}
        elements = {t[:-1] for t in large if t.endswith("<") and large.get(f"{t[:-1]}>") == large[t]}
        texts = set()
        for t, v in large.items():
            if t.startswith("="):
                around = t[1:-17]
                inside = [e for e in elements if f"{around}/".startswith(f"{e}/") and large[f"{e}<"] == v]
                if inside or v == (1,) * len(distinct):
                    texts.add(t)
        assert got[f"{name}.example"] == elements | texts
