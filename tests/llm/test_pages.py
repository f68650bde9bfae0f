from __future__ import annotations

import random

from panelyst.llm import pages

ARTICLE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- note --><div class="ad">buy <b>this</b></div>'
    "<article><h1>Head &amp; more</h1><p><b>One  two<br>three<p>f<i>ou</i>r\n five &quot;six&quot;</p>"
    '<div class="comments"><p>first!</p></div><form><input>send</form>tail</article>'
    '<aside>side</aside><div class="cookie-notice">ok?</div><footer>&copy; host</footer></body></html>'
)


def text_of(html, places=frozenset()):
    return pages.main_text(pages.parse(html), places)


def test_article_without_what_is_around_it():
    assert text_of(ARTICLE) == 'Head & more\nOne two three\nfour five "six"\ntail'


def test_markup_that_is_not_well_formed():
    assert text_of("") == ""
    assert text_of("plain   text &lt;b&gt;") == "plain text <b>"
    assert text_of("<article><p>a<p>b<ul><li>c<li>d</ul>e") == "a\nb\nc\nd\ne"
    assert text_of("<article><p>1 < 2 & 3 <script>never closed <p>x") == "1 < 2 & 3"
    assert text_of("<article><p title='a>b'>in</p></article><p>out") == "in"
    assert text_of("</div></p><article>x<!-- never closed <p>y") == "x"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"
    assert text_of("<p title='>" + "<p>x" * 3000).count("x") >= 2999


def test_host():
    assert pages.host("HTTPS://User@WWW.Example.com:80/a?b") == "www.example.com:80"
    assert pages.host(None) == pages.host("") == ""


def generic(rng, k):
    body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(4))}</p>" for _ in range(rng.randrange(1, 4)))
    return f"<html><body><div class=top>Welcome to our site</div><div class=c>{body}</div><div>Open daily</div></body></html>", body


def test_text_that_is_template_goes_where_there_is_no_article(frame):
    rng = random.Random(1)
    made = [generic(rng, k) for k in range(30)]
    rows = [(k, f"http://h.example/{k}", html) for k, (html, _) in enumerate(made)]
    out = pages.extract(frame(rows, "page_id long, url string, html string")).collect()
    want = {k: "\n".join(body.removeprefix("<p>").removesuffix("</p>").split("</p><p>")) for k, (_, body) in enumerate(made)}
    assert {r["page_id"]: r["text"] for r in out} == want


def test_templates_are_classes_of_equal_vectors(frame):
    rows = [(k, "http://a.example/", "<body><nav><ul>" + "<li>x</li>" * k + "</ul></nav><div>t</div></body>") for k in range(1, 9)]
    rows += [(90, "http://a.example/", "<body><section>once</section></body>")]
    df = frame(rows, "page_id long, url string, html string").select("page_id", "url", "html")
    found = {r["host"]: r for r in pages.templates(pages.vectors(df)).collect()}
    places = {p for p in found["a.example"]["places"] if not p.startswith("=")}
    assert places == {"/body", "/body/nav", "/body/nav/ul", "/body/nav/ul/li", "/body/div"}
    assert found["a.example"]["pages"] == 9 and found[pages.ALL]["pages"] == 9


def test_rows(frame):
    rows = [(1, "http://a/x", ARTICLE), (1, "http://a/x", ARTICLE), (None, None, None), (3, "", ""), (4, "http://b", "<article>" + "<p>é " * 20_000)]
    out = pages.extract(frame(rows, "page_id long, url string, html string")).collect()
    by_id = {r["page_id"]: r for r in out}
    assert len(out) == 5 and by_id[None]["text"] == by_id[3]["text"] == "" and by_id[3]["n_chars"] == 0
    assert by_id[4]["n_chars"] == 2 * 20_000 - 1
    assert pages.extract(frame(rows, "page_id long, url string, html string").where("false")).count() == 0
