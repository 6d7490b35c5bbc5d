"""Main text of web pages by line-block distribution.

Markup is stripped to lines: a block element's begin and end each end a line. Elements
that say themselves that they are no article text (by tag, role, class or id) are left
out, unless they hold the page's article or most of its text. Over the filled lines,
text lengths outside links are summed in a sliding window: where the sums rise from
nothing is a surge, where they fall back a dive. Left-out blocks and the edges of
``article`` and ``main`` count as empty lines, the tags of nested sections do not.

Lines in ``article`` or ``main`` weigh more. Articles with a surge are kept, unless a
stretch outside has more text than any of them; then ``main``, and at last the whole
page, takes their place: all from the first surge to the last dive but lists of links.
Where nothing surges, all text of the same part is kept; so is that of a string
without any markup.

Defined results: a null page counts as empty and has an empty text; broken and
unclosed markup is read as far as it goes; repeated rows repeat; an empty table
gives an empty result. Pages are read one by one inside tasks, each in time in
proportion to its length; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakekin.llm import text as tx

#: Lines in a window, and the text a surge needs.
WINDOW = 3
SURGE = 80
#: Weight of text that the page marks as its article.
MARKED = 4

#: Elements by their part in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title noscript iframe template svg math object canvas audio video noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Of these, forms and headers may also hold the page.
ASIDE = frozenset("head nav header footer aside form button select dialog menu label input option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Roles of page parts that are no article text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Classes and ids that name such parts, alone or joined with each other or with PARTS.
NAMES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted"
    " nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager toc"
    " header masthead topbar footer foot bottombar copyright colophon"
    " sidebar aside widget widgets related recommended recommendations trending"
    " notice cookie cookies consent gdpr disclaimer alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist respond replies reply disqus discussion reactions"
    " share sharing social follow search form skip hidden".split()
)
PARTS = frozenset(
    "site main global top bottom left right primary secondary wrapper wrap container area list box block section bar inner outer"
    " col row item items link links icon icons button buttons btn slot unit title posts articles stories text media holder group"
    " panel module region body".split()
)
#: Words that name a part also beside the word for what it belongs to.
OWNED = frozenset(
    "comment comments commentlist replies disqus sidebar share sharing social related recommended newsletter subscribe"
    " ad ads advert adverts advertisement advertising sponsored promo".split()
)
OWNERS = frozenset("article blog entry page post reader readers this user users".split())
#: Of an article's own.
ARTICLE_NAMES = frozenset("comment comments reply ad promo related".split())
#: Elements never left out for their class: they hold the page or are text themselves.
KEPT = frozenset("html body main article".split())

TOKEN = re.compile(r"<(?:(!--)|([!?])|(/?)([A-Za-z][A-Za-z0-9:-]*))")
#: The rest of a tag; possessive, so that a tag without an end is read once.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT_NAME = re.compile(r"[^a-z]+")
#: A tag that ends itself; the slash of a value without quotes does not.
ENDED = re.compile(r"(?<!\S)/$|[\"']/$|^/$|^[^=]*/$")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Part:
    """A piece of text, the left-out element around it (or 0) and what it stands in."""

    text: str
    size: int
    within: int
    linked: bool
    heading: bool
    running: bool
    mark: int


@dataclass
class Aside:
    """An element left out for its name, with what it holds."""

    around: int
    block: bool
    size: int = 0
    article: int = 0
    main: bool = False


@dataclass
class Line:
    """Text up to the next block boundary."""

    parts: list[Part] = field(default_factory=list)
    #: A left-out block lies here, or an edge of the article.
    cut: bool = False

    def text(self) -> str:
        return " ".join("".join(p.text for p in self.parts).split())

    def own(self) -> int:
        return sum(p.size for p in self.parts if not p.linked)

    def mark(self) -> int:
        """Number of the article, -1 for other text of ``main``, or 0."""
        return next((p.mark for p in self.parts if p.size), 0)


def names(token: str, parts: frozenset[str]) -> bool:
    """Whether a whole class or id is made of words that name a part."""
    words = set(SPLIT_NAME.split(CAMEL.sub(" ", token).lower())) - {""}
    return bool(words & parts) and words <= parts | PARTS or bool(words & OWNED) and words <= OWNED | PARTS | OWNERS


def marks_aside(tag: str, attributes: str, in_article: bool) -> str:
    """``always`` or ``named`` for an element that says that it is no article text."""
    if tag == "header" and in_article:
        return ""
    if tag in ASIDE:
        return "named" if tag in ("form", "header") else "always"
    if not attributes or tag in KEPT and tag != "article":
        return ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return "always"
    if "display:none" in found.get("style", "").lower().replace(" ", ""):
        return "always"
    if found.get("role", "").lower() in ROLES:
        return "named" if found["role"].lower() in ("form", "banner") else "always"
    if tag in HEADINGS:
        return ""
    tokens = f"{found.get('class', '')} {found.get('id', '')}".split()
    return "named" if any(names(t, ARTICLE_NAMES if tag == "article" else NAMES) for t in tokens) else ""


def tokens(html: str) -> Iterator[tuple[str, bool, str, str]]:
    """``(text before, whether it closes, tag, attributes)``; an empty tag for comments and the last text.

    Quotes hide ``>`` until a tag has no end by that rule; the rest of the page is then
    read without regard to quotes, so that no stretch is searched again and again.
    """
    at, before, quotes = 0, 0, True
    while m := TOKEN.search(html, at):
        comment, other, slash, tag = m.groups()
        if tag and quotes:
            rest = REST.match(html, m.end())
            if rest:
                yield html[before : m.start()], bool(slash), tag.lower(), rest[1]
                at = before = skip_raw(html, rest.end(), bool(slash), tag.lower(), rest[1])
                continue
            quotes = False
        stop = html.find("-->" if comment else ">", m.end())
        if stop < 0 and tag:
            break
        if tag:
            yield html[before : m.start()], bool(slash), tag.lower(), html[m.end() : stop]
            at = before = skip_raw(html, stop + 1, bool(slash), tag.lower(), html[m.end() : stop])
            continue
        yield html[before : m.start()], False, "", ""
        at = before = len(html) if stop < 0 else stop + (3 if comment else 1)
    yield html[before:], False, "", ""


def ends_itself(attributes: str) -> bool:
    return attributes.endswith("/") and bool(ENDED.search(attributes))


def skip_raw(html: str, at: int, closing: bool, tag: str, attributes: str) -> int:
    """The place after a tag, or after the end of an element whose content is no text."""
    if closing or tag not in RAW or ends_itself(attributes):
        return at
    over = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
    return over.end() if over else len(html)


def lines(html: str) -> list[Line]:
    """The page's lines in order, empty ones included."""
    out = [Line()]
    # Open elements as (tag, how it is left out, whether it counts as the article).
    stack: list[tuple[str, str, bool]] = []
    # Where each tag, and any block, is open in the stack.
    opened: dict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []
    asides = [Aside(0, False)]
    always = within = article = mains = link = heading = running = articles = 0

    def add(raw: str) -> None:
        if always or not raw:
            return
        text = unescape(raw)
        mark = articles if article else -1 if mains else 0
        size = sum(map(len, text.split()))
        out[-1].parts.append(Part(text, size, within, link > 0, heading > 0, running > 0, mark))
        asides[within].size += size
        asides[within].article += size * (article > 0)

    def close(depth: int) -> None:
        nonlocal always, within, article, mains, link, heading, running
        while len(stack) > depth:
            tag, left_out, counts = stack.pop()
            opened[tag].pop()
            if tag in BLOCKS:
                open_blocks.pop()
            always -= left_out == "always"
            if left_out == "named":
                within = asides[within].around
            article -= counts
            mains -= tag == "main"
            link -= tag == "a"
            heading -= tag in HEADINGS
            running -= tag == "p"
            if counts or tag == "main":
                out[-1].cut = True

    for before, closing, tag, attributes in tokens(html):
        add(before)
        if not tag:
            continue
        if tag in BLOCKS:
            out.append(Line())
        elif tag == "br":
            add(" ")
        if closing:
            if opened[tag]:
                close(opened[tag][-1])
            continue
        if tag in RAW or tag in VOID or ends_itself(attributes):
            continue
        # A new paragraph or item ends an open one; a part that follows the head ends it.
        if tag in BLOCKS and open_blocks:
            around = stack[open_blocks[-1]][0]
            if around == "p" or around == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                close(open_blocks[-1])
            if tag == "body" and opened["head"]:
                close(opened["head"][0])
        left_out = marks_aside(tag, attributes, article > 0 or mains > 0)
        counts = tag == "article" and not left_out
        opened[tag].append(len(stack))
        if tag in BLOCKS:
            open_blocks.append(len(stack))
        stack.append((tag, left_out, counts))
        always += left_out == "always"
        if left_out == "named":
            asides.append(Aside(within, tag in BLOCKS))
            within = len(asides) - 1
        if counts:
            articles += article == 0
            article += 1
        if tag == "main":
            mains += 1
            asides[within].main = True
        link += tag == "a"
        heading += tag in HEADINGS
        running += tag == "p"
        if left_out == "always" and tag in BLOCKS or counts or tag == "main":
            out[-1].cut = True
    return without_asides(out, asides)


def without_asides(page: list[Line], asides: list[Aside]) -> list[Line]:
    """The lines without the elements left out for their names, but for those that hold the page."""
    for a in reversed(asides[1:]):
        around = asides[a.around]
        around.size, around.article, around.main = around.size + a.size, around.article + a.article, around.main or a.main
    whole = asides[0]
    gone, blocks = [False], [False]
    for a in asides[1:]:
        holds = a.main or 2 * a.article > whole.article
        holds = holds or not (whole.article or whole.main) and 2 * a.size > whole.size
        gone.append(gone[a.around] or not holds)
        blocks.append(gone[-1] and (blocks[a.around] or a.block))
    for line in page:
        line.cut = line.cut or any(blocks[p.within] for p in line.parts)
        line.parts = [p for p in line.parts if not gone[p.within]]
    return page


def stretches(lengths: np.ndarray, surge: int) -> list[tuple[int, int]]:
    """Line ranges between each surge of the window sums and the dive after it."""
    sums = np.convolve(lengths, np.ones(WINDOW, np.int64))[WINDOW - 1 :]
    found, i, n = [], 0, len(lengths)
    while i < n:
        if sums[i] < surge or not lengths[i]:
            i += 1
            continue
        start = i
        while i < n and sums[i]:
            i += 1
        # Short lines right before the surge stand in the same stretch.
        while start and sums[start - 1] and lengths[max(0, start - WINDOW) : start].any():
            start -= 1
        found.append((start, i))
    return found


def main_text(html: str) -> str:
    """The blocks of a page's main text, joined by line breaks."""
    # Filled lines, and where something was cut out a window of empty ones.
    page: list[Line] = []
    cut = False
    for line in lines(html):
        cut = cut or line.cut
        if any(p.size for p in line.parts):
            page += [Line() for _ in range(WINDOW * cut)] + [line]
            cut = line.cut
    if not page:
        return ""
    texts = [line.text() for line in page]
    filled = np.array([bool(t) for t in texts], bool)
    own = np.array([line.own() for line in page], np.int64)
    mark = np.array([line.mark() for line in page], np.int64)
    weighted = np.where(mark != 0, MARKED, 1) * own
    size = lambda lengths, found: max((int(lengths[a:b].sum()) for a, b in found), default=0)

    # The articles, or else the main part, unless more text surges outside.
    for region in (mark > 0, mark != 0):
        if not region[filled].any():
            continue
        group = np.where(mark > 0, mark, 0) if (region == (mark > 0)).all() else region.astype(np.int64)
        outside = np.where(region, 0, own)
        if size(outside, stretches(outside, SURGE)) > np.bincount(group[region], own[region]).max():
            continue
        risen = {int(g) for a, b in stretches(np.where(region, weighted, 0), SURGE) for g in group[a:b] if g}
        return "\n".join(t for t, g, r in zip(texts, group, region) if t and r and (not risen or g in risen))

    found = stretches(weighted, SURGE)
    first, last = (found[0][0], found[-1][1]) if found else (0, len(page))
    # A heading next above belongs to the stretch.
    above = [i for i in range(max(0, first - 2 * WINDOW), first) if texts[i]]
    if above and any(p.heading for p in page[above[-1]].parts):
        first = above[-1]
    # Many lines of links alone are lists of other pages.
    loose = [bool(t) and not n and not any(p.running or p.heading for p in line.parts) for t, n, line in zip(texts, own, page)]
    kept, i = [], first
    while i < last:
        stop = i
        while stop < last and loose[stop]:
            stop += 1
        if stop - i < WINDOW:
            stop = max(stop, i + 1)
            kept += [t for t in texts[i:stop] if t]
        i = stop
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.blocks(batch, "html"):
                texts = [main_text(h or "") for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    narrow = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = narrow.schema["page_id"].dataType.simpleString()
    return narrow.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
