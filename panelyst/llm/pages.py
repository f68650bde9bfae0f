"""Main text of web pages by templates deduced from equivalence classes of tokens.

A token is an opening or closing tag with its place in the page (the structural elements around it, with their
classes), or a block of text at its place. Of every host and token the vector of occurrences over the host's pages
is kept as a linear fingerprint: the sum, over all pages, of the occurrences times a random number of the page.
Tokens with equal fingerprints occur equally often on every page and form an equivalence class, wherever they stand.
A class on at least half of the pages is large enough to be template if it has a pair of opening and closing tag; the
page itself is such a pair. The elements of these classes, nested by their places, are the template of a host;
between its tokens lie the slots. Copies of a page on a host count as one page.

What the slots hold decides about them:

* Text is template if it lies inside an element of its own class, and goes; text that as many pages have, but others
  than have the elements around it, stays. So does what stands right in the main slot of an article.
* The main slot is the one with the most text of the template's article, of its main part where no article is, or of
  the page.
* A slot in which most text comes back on other pages holds adverts or notices and goes. A slot that pages have
  several times, after the end of their main slot, holds comments or teasers and goes. Neither is judged where the
  text of the main slot comes back as well, as on a host of near-copies.
* Elements that are not part of the template belong to the slot around them.

Tags and roles made for it (nav, footer, aside, form, ...) mark what is outside. English class names serve where the
slots do not tell: outside the article any such word counts, inside it a class or id that is such a word as a whole.

A host with fewer than FEWEST distinct pages has no vectors to compare and takes the template of all pages together;
where those are too few as well, no text is template. Fingerprints and amounts of text are summed like counts, so a
host that holds a third of all pages is no large group.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from base64 import urlsafe_b64encode
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelyst.sources.sinks import materialise

FEWEST = 3
#: Parts that the rows of a host are dealt to where they meet its number of pages.
PARTS = 32
#: Structural elements of a place that are written out; of more, those further out are told by their hash.
DEPTH = 12
PRIME = (1 << 61) - 1
ALL = "*"

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that tokens and places are made of: blocks that hold others.
STRUCTURE = BLOCKS - frozenset("h1 h2 h3 h4 h5 h6 p pre hr dt dd legend caption figcaption summary option".split())
#: What an opening tag ends when it is open, up to the nearest element of the second set.
ENDS = {
    **dict.fromkeys(BLOCKS - frozenset(("html", "body", "head", "button")), (frozenset("p".split()), STRUCTURE)),
    "li": (frozenset(("li", "p")), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd", "p")), frozenset(("dl",))),
    "tr": (frozenset("tr td th p".split()), frozenset(("table",))),
    "td": (frozenset("td th p".split()), frozenset(("tr", "table"))),
    "th": (frozenset("td th p".split()), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
#: Elements, roles and words of class or id names that mark what is not main text.
OUTSIDE_TAGS = frozenset("head nav footer aside form menu button select dialog".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies copyright disclaimer footer masthead menu modal nav navbar navigation newsletter notice notices pager "
    "pagination popup promo promotion related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe toolbar widget".split()
)
MAIN = frozenset(("article", "main"))
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element(NamedTuple):
    tag: str
    label: str
    outside: bool  # by its tag or role
    named: int  # 2 if a class or id is one of OUTSIDE_WORDS, 1 if one is made with such a word, else 0
    place: str  # labels of the structural elements down to this one


class Page(NamedTuple):
    tokens: list[str]
    blocks: list[tuple[tuple[Element, ...], str]]  # the elements around a block of text, and the text


def _element(tag: str, attributes: str, place: str, inside: bool) -> Element:
    """An element at a place, inside an article or not."""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes else {}
    classes = found.get("class", "").split()
    names = (*classes, found.get("id", ""))
    words = {w.lower() for name in names for w in WORD.findall(name)}
    named = 0
    if tag not in ("html", "body", *MAIN) and words & OUTSIDE_WORDS:
        named = 2 if any(name.lower() in OUTSIDE_WORDS for name in names) else 1
    role = found.get("role", "").lower()
    outside = (
        tag in OUTSIDE_TAGS
        or (tag == "header" and not inside)
        or role in OUTSIDE_ROLES
    )
    label = ".".join((tag, *sorted(classes)))
    if tag in STRUCTURE:
        if place.count("/") >= DEPTH:
            place = "/" + hashlib.md5(place.encode("utf-8", "replace")).hexdigest()
        place = f"{place}/{label}"
    return Element(tag, label, outside, named, place)


#: Elements that a task remembers by tag, attributes and place.
REMEMBERED = 50_000


def parse(html: str, met: dict | None = None) -> Page:
    """Tokens and text blocks of a page in order. Markup that is not well formed is read as browsers would.

    ``met`` keeps elements from page to page.
    """
    met = {} if met is None or len(met) > REMEMBERED else met
    stack: list[Element] = []
    tokens: list[str] = []
    blocks: list[tuple[tuple[Element, ...], str]] = []
    pieces: list[str] = []
    at = articles = 0

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((tuple(stack), text))
            pieces.clear()

    def close(upto: int) -> None:
        nonlocal articles
        end_block()
        for e in reversed(stack[upto:]):
            if e.tag in STRUCTURE:
                tokens.append(f"{e.place}>")
                articles -= e.tag in MAIN
        del stack[upto:]

    while (m := MARKUP.search(html, at)) is not None:
        if m.start() > at:
            piece = html[at : m.start()]
            pieces.append(entities.unescape(piece) if "&" in piece else piece)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "br":
            pieces.append(" ")
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}[^>]*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag not in BLOCKS:
            continue  # inline: its text belongs to the block around it
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            else:
                end_block()
            continue
        end_block()
        ends, limit = ENDS.get(tag, (frozenset(), frozenset()))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in ends:
                close(k)
            elif stack[k].tag in limit:
                break
        place = stack[-1].place if stack else ""
        key = (tag, attributes, place, articles > 0)
        e = met.get(key)
        if e is None:
            e = met[key] = _element(*key)
        stack.append(e)
        articles += tag in MAIN
        if tag in STRUCTURE:
            tokens.append(f"{e.place}<")
    if at < len(html):
        pieces.append(entities.unescape(html[at:]))
    close(0)
    return Page(tokens, blocks)


def host(url: str | None) -> str:
    """The host of a URL in lower case, empty without one."""
    rest = (url or "").split("://", 1)[-1]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rsplit("@", 1)[-1].lower()


def text_token(around: tuple[Element, ...], text: str) -> str:
    place = around[-1].place if around else ""
    mark = urlsafe_b64encode(hashlib.md5(text.encode("utf-8", "replace")).digest()[:12]).decode()
    return f"={place}={mark}"


def page_tokens(page: Page) -> dict[str, int]:
    """How often each tag and block of text occurs, and ``#place``: the characters of text right at a place."""
    counts: dict[str, int] = {}
    for token in page.tokens:
        counts[token] = counts.get(token, 0) + 1
    for around, text in page.blocks:
        for token, n in ((text_token(around, text), 1), (f"#{around[-1].place if around else ''}", len(text))):
            counts[token] = counts.get(token, 0) + n
    return counts


def page_counts(pages: DataFrame) -> DataFrame:
    """(host, h1, h2, tokens, counts): the occurrences of each token on each distinct page of a host.

    The token "" stands for the page itself. Equal pages are told by 128 bits of hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict = {}
        for batch in batches:
            out: dict[tuple[str, int, int], dict[str, int]] = {}
            for url, html, h1, h2 in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "h1", "h2")), strict=True):
                key = (host(url), h1, h2)
                if key in out:
                    continue
                out[key] = {"": 1, **page_tokens(parse(html, met))}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in out], pa.string()),
                    pa.array([k[1] for k in out], pa.int64()),
                    pa.array([k[2] for k in out], pa.int64()),
                    pa.array([list(c) for c in out.values()], pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in out.values()], pa.list_(pa.int64())),
                ],
                ["host", "h1", "h2", "tokens", "counts"],
            )

    html = F.coalesce("html", F.lit(""))
    rows = pages.select("url", html.alias("html"), F.xxhash64(html).alias("h1"), F.xxhash64(F.lit(1), html).alias("h2"))
    schema = "host string, h1 long, h2 long, tokens array<string>, counts array<long>"
    return rows.mapInArrow(run, schema).dropDuplicates(["host", "h1", "h2"])


def _summed(counted: DataFrame, frequent: frozenset[str] | None = None) -> DataFrame:
    """(host, token, pages, total, mark) of distinct pages, summed per batch, then overall.

    With ``frequent`` only those blocks of text whose hash ends so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str], list[int]] = {}
            columns = (batch.column(c).to_pylist() for c in ("host", "h1", "tokens", "counts"))
            for h, number, tokens, counts in zip(*columns, strict=True):
                for token, n in zip(tokens, counts, strict=True):
                    if frequent is not None and token[:1] == "=" and token[-2:] not in frequent:
                        continue
                    s = sums.setdefault((h, token), [0, 0, 0])
                    s[0] += 1
                    s[1] += n
                    s[2] += n * (number % PRIME)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in sums], pa.string()),
                    pa.array([t for _, t in sums], pa.string()),
                    pa.array([s[0] for s in sums.values()], pa.int64()),
                    pa.array([s[1] for s in sums.values()], pa.int64()),
                    pa.array([s[2] % PRIME for s in sums.values()], pa.int64()),
                ],
                ["host", "token", "pages", "total", "mark"],
            )

    parts = counted.mapInArrow(run, "host string, token string, pages long, total long, mark long")
    mark = (F.sum(F.col("mark").cast("decimal(38,0)")) % F.lit(PRIME).cast("decimal(38,0)")).cast("long")
    return parts.groupBy("host", "token").agg(F.sum("pages").alias("pages"), F.sum("total").alias("total"), mark.alias("mark"))


def vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, total, mark): occurrences of each token over the distinct pages of a host.

    The token "" stands for the pages themselves, the host ALL for all pages. Of ALL, blocks of text that fewer than
    half of the pages have are of no use and need not be there: blocks are counted by the last two of 64 signs
    of their hash first, and where such a group is on fewer pages than that, so is each block in it.
    """
    counted = materialise(page_counts(pages), "counted")
    everywhere = materialise(counted.dropDuplicates(["h1", "h2"]).withColumn("host", F.lit(ALL)), "everywhere")
    n = everywhere.count()
    token = F.explode(F.filter("tokens", lambda t: t.startswith("="))).alias("token")
    groups = everywhere.select(token).groupBy(F.right("token", F.lit(2)).alias("end")).count()
    frequent = frozenset(r["end"] for r in groups.where(2 * F.col("count") >= n).collect())  # 4,096 groups at most
    return _summed(counted).unionByName(_summed(everywhere, frequent))


def _beside_size(rows: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The rows with their host's ``host_pages``; the rows of a host are dealt out by ``key``, its size goes to each part."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    everywhere = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<bigint>")))
    return dealt.join(everywhere, ["host", "part"]).drop("part")


def templates(found: DataFrame) -> DataFrame:
    """(host, pages, places, slots): the elements of each host's valid classes, by place, and the text inside them.

    A class has the same host, pages, total and mark. It is on at least half of the host's pages and has an element
    with both its tokens. A block of text is its own place. For ``slots`` see :func:`judged_slots`.
    """
    sizes = found.where("token = ''").select("host", F.col("pages").alias("host_pages"))
    large = _beside_size(found, sizes, "token").where("2 * pages >= host_pages and not startswith(token, '#')")
    is_text = F.col("token").startswith("=")
    tag = F.when(~is_text, F.col("token"))
    classes = large.groupBy("host", "pages", "total", "mark").agg(
        F.collect_set(tag).alias("tags"), F.collect_set(F.when(is_text, F.col("token"))).alias("texts")
    )
    opened = F.expr("transform(filter(tags, t -> endswith(t, '<')), t -> left(t, length(t) - 1))")
    closed = F.expr("transform(filter(tags, t -> endswith(t, '>')), t -> left(t, length(t) - 1))")
    root = F.when(F.array_contains("tags", ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    valid = classes.withColumn("elements", F.concat(F.array_intersect(opened, closed), root)).where("size(elements) > 0")
    # the place of a text stands between its two signs; the hash has 16 places
    around = "substring(t, 2, length(t) - 18)"
    nested = F.expr(f"filter(texts, t -> exists(elements, e -> e = '' or {around} = e or startswith({around}, e || '/')))")
    members = valid.select("host", F.explode(F.concat(F.expr("filter(elements, e -> e <> '')"), nested)).alias("place"))
    places = members.groupBy("host").agg(F.collect_set("place").alias("places"))
    none = F.array().cast("array<string>")
    return sizes.join(places, "host", "left").join(judged_slots(found, sizes), "host", "left").select(
        "host",
        F.col("host_pages").alias("pages"),
        F.coalesce("places", none).alias("places"),
        F.coalesce("slots", none).alias("slots"),
    )


def judged_slots(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, slots): the main slot of a host as ``@place``, and the slots that are judged by what they hold.

    ``-place`` holds text that comes back on other pages, ``~place`` comes several times a page. Both are of places
    with a class on at least half of the pages, neither around nor at the main slot. ``=place`` says that the main
    slot's own text comes back; then nothing else is judged.
    """
    kind = F.substring("token", 1, 1)
    again = (F.col("host") != ALL) & (2 * F.col("again") > F.col("texts"))
    place = (
        F.when(kind == "#", F.expr("substring(token, 2)"))
        .when(kind == "=", F.expr("substring(token, 2, length(token) - 18)"))
        .when(F.col("token").endswith("<"), F.expr("left(token, length(token) - 1)"))
    )
    sums = (
        found.select("host", place.alias("place"), kind.alias("kind"), "pages", "total")
        .where("place is not null")
        .groupBy("host", "place")
        .agg(
            F.sum(F.when(F.col("kind") == "#", F.col("total"))).alias("chars"),
            F.sum(F.when(F.col("kind") == "=", F.col("total"))).alias("texts"),
            F.sum(F.when((F.col("kind") == "=") & (F.col("pages") > 1), F.col("total"))).alias("again"),
            F.sum(F.when(F.col("kind") == "/", F.col("pages"))).alias("pages"),
            F.sum(F.when(F.col("kind") == "/", F.col("total"))).alias("times"),
        )
    )
    outside = rf"/({'|'.join(sorted(OUTSIDE_TAGS | {'header'}))})([./]|$)"
    nearest = F.when(F.col("place").rlike(r"/article([./]|$)"), 2).when(F.col("place").rlike(r"/main([./]|$)"), 1).otherwise(0)
    slots = _beside_size(sums, sizes, "place").where("2 * pages >= host_pages")
    main = (
        slots.where((F.col("chars") > 0) & ~F.col("place").rlike(outside))
        .groupBy("host")
        .agg(F.max(F.struct(nearest, "chars", "place", again.alias("again"))).alias("main"))
        .select("host", F.col("main.place").alias("main"), F.coalesce("main.again", F.lit(False)).alias("copied"))
    )
    label = F.element_at(F.split("place", "/"), -1)
    other = slots.join(main, "host").where(
        ~F.col("copied") & ~F.expr("startswith(main || '/', place || '/')") & label.rlike(r"^(div|section|article|ins|li)\.")
    )
    judged = other.select(
        "host",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(again & (F.col("texts") >= FEWEST), F.concat(F.lit("-"), "place")),
                    F.when(2 * F.col("times") >= 3 * F.col("pages"), F.concat(F.lit("~"), "place")),
                )
            )
        ).alias("slot"),
    )
    own = main.select("host", F.concat(F.lit("@"), "main").alias("slot"))
    copied = main.where("copied").select("host", F.concat(F.lit("="), "main").alias("slot"))
    return judged.unionByName(own).unionByName(copied).groupBy("host").agg(F.collect_set("slot").alias("slots"))


Blocks = list[tuple[tuple[Element, ...], str]]


def _article(blocks: Blocks, places: frozenset[str]) -> tuple[list[tuple[tuple[Element, ...], str, int]], bool]:
    """The blocks inside the article or, without one, the main part, each with the elements around that; if it is sure.

    One of the template goes before one that this page alone has. A class such as has-sidebar around all of them tells
    of the layout; of several, those go first whose other elements have no name of what is outside.
    """
    for known, tag in ((True, "article"), (True, "main"), (False, "article"), (False, "main")):
        inside = []
        for around, text in blocks:
            at = next((k for k, e in enumerate(around) if e.tag == tag and (not known or e.place in places)), None)
            if at is not None:
                inside.append((around, text, at))
        if inside:
            shared = len(commonprefix([around[:at] for around, _, at in inside]))
            for most in (0, 1, 2):
                clear = [b for b in inside if all(e.named <= most for e in b[0][shared : b[2]])]
                if clear:
                    named = max((e.named for e in clear[0][0][:shared]), default=0)
                    # inside an element named as outside, or one that only this page has and is named so
                    return clear, named < 2 and (known or most == 0)
    return [], False


def main_text(page: Page, places: frozenset[str], slots: frozenset[str] = frozenset()) -> str:
    """The blocks of the slots that make up the main text, joined by line feeds."""
    near = [(around, text) for around, text in page.blocks if not any(e.outside for e in around)]
    chosen, sure = _article(near, places)
    main = next((s[1:] for s in slots if s[0] == "@"), None)
    copied = f"={main}" in slots

    def goes(around: tuple[Element, ...], text: str, at: int, past: bool) -> bool:
        place = around[-1].place if around else ""
        own = at >= 0 and (copied or place == main)  # the main slot of an article is left whole
        if not own and text_token(around, text) in places:
            return True
        for k, e in enumerate(around[at + 1 :], at + 1):
            if main is not None and f"{main}/".startswith(f"{e.place}/"):
                continue  # around the main slot
            if e.named == 2 or f"-{e.place}" in slots or (past and f"~{e.place}" in slots):
                return True
            if e.tag == "article" and around[at].tag == "article":
                return True  # an article in an article is a comment on it
        return False

    if not sure:  # no article: what has no name of what is outside
        chosen = [(around, text, -1) for around, text in near if not any(e.named for e in around)] or chosen
    last = max((k for k, (around, _, _) in enumerate(chosen) if around and around[-1].place == main), default=len(chosen))
    kept = [text for k, (around, text, at) in enumerate(chosen) if not goes(around, text, at, k > last)]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Character references are decoded, white space inside a block becomes one blank, blocks are joined by a line
    feed. A NULL or empty html, or one without text, gives an empty text. Pages without a URL share the empty
    host. Ids may be NULL and rows may repeat. An empty table gives an empty result.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    found = materialise(templates(materialise(vectors(rows), "vectors")), "templates")
    common = found.where(F.col("host") == ALL).select("places", "slots", "pages").first()  # as large as half of the pages have it
    fallback = ([], [])
    if common:
        many = common[2] >= FEWEST
        fallback = [p for p in common[0] if many or not p.startswith("=")], common[1] if many else []

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host(u) for u in batch.column("url").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts], [*batch.schema.names, "host"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict = {}
        for batch in batches:
            texts = []
            given, held = None, (frozenset(), frozenset())
            for html, *own in zip(*(batch.column(c).to_pylist() for c in ("html", "places", "slots")), strict=True):
                template = fallback if own[0] is None else own
                if template != given:
                    given, held = template, tuple(map(frozenset, template))
                texts.append(main_text(parse(html or "", met), *held))
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), out, pc.utf8_length(out).cast(pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = T.StructType([*rows.schema.fields, T.StructField("host", T.StringType())])
    own = found.where((F.col("pages") >= FEWEST) & (F.col("host") != ALL)).select("host", "places", "slots")
    joined = rows.mapInArrow(name, schema).join(own, "host", "left")
    return joined.select("page_id", "url", "html", "places", "slots").mapInArrow(run, "page_id long, url string, text string, n_chars long")
