"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, less with each level, and a container's
sum is discounted by the share of its text that is in links. The best container is kept with those siblings that score
close to it or are paragraphs of prose; what lies inside but is no part of an article (menus, notices, adverts, forms,
reader comments and the like) is left out by its element or the words of its class, id and role.

Words of a class and forms are only a hint: an element that holds the page's article, or the greater part of what its
paragraphs score, is no such part, and where the hints leave nothing they are not followed.

Defined results. Null or empty html, and pages without text outside elements and roles that never hold an article, give
an empty text. Broken markup is read as browsers do in common cases: an open paragraph ends where a block begins, stray end tags are ignored.
Repeated pages give repeated rows, an empty table none. Whole pages of any length and depth are read without recursion.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "script style noscript template head title nav footer aside button select textarea iframe object svg canvas audio video dialog menu search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words in class or id that mark parts which are no article text.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe subscription signup paywall share sharing social related recommend "
    "recommended recommendations sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead comment comments "
    "commentlist discussion replies disqus respond reactions disclaimer legal login search toolbar hidden skip teaser trending popular".split()
)
#: Those of them that layouts also use in compounds ("overflow-hidden", "with-sidebar"); they count as a whole class or id only.
WHOLE = frozenset("hidden sidebar nav search legal social".split())
#: What a class begins with that says what else a layout has.
LAYOUT = ("has-", "with-", "no-", "has_", "with_", "no_")
#: Those of them whose parts may outweigh the article, and hold articles of their own.
THREADS = frozenset("comment comments commentlist discussion replies disqus respond reactions".split())
HEADERS = frozenset("header topbar".split())
ARTICLE = frozenset("article articlebody main content post entry story text body".split())
SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])").findall
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search
#: Open elements that a start tag ends, up to the element that confines it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr"), "option": ("option",)}
CONFINES = frozenset("ul ol dl table body html article section div main".split())
PROSE = 80
ROWS_PER_BATCH = 256


class _Page(HTMLParser):
    """Elements as parallel lists, and the blocks of text in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.words, self.dropped = [-1], ["#root"], [frozenset()], [False]
        #: Elements whose class, id or being a form says that they are no article text.
        self.doubted: dict[int, frozenset[str]] = {}
        self.open = [0]
        self.links = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[int, str, int]] = []

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                node = next(n for n in reversed(self.open) if self.tag[n] in BLOCKS or n == 0 or n in self.doubted)
                self.blocks.append((node, text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def pop_to(self, depth: int) -> None:
        if self.pieces and any(n in self.doubted for n in self.open[depth:]):
            self.flush()
        for node in self.open[depth:]:
            self.links -= self.tag[node] == "a"
        del self.open[depth:]

    def close_open(self, names: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in names:
                self.pop_to(depth)
            elif tag in CONFINES:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            self.close_open(("p",))
            if tag[0] == "h" and tag[1:].isdigit():
                self.close_open(("h1", "h2", "h3", "h4", "h5", "h6"))
        elif tag == "br" or tag == "hr":
            self.pieces.append(" ")
        if tag in CLOSES:
            self.flush()
            self.close_open(CLOSES[tag])
        if tag in VOID:
            return
        known = dict(attrs)
        above = self.open[-1]
        words = frozenset(w.lower() for key in ("class", "id") for w in SPLIT(known.get(key) or "")) if known else frozenset()
        off = self.dropped[above] or tag in DROPPED or tag == "label" and any(self.tag[n] == "form" for n in self.open)
        doubt = frozenset(["form"]) if tag == "form" else frozenset()
        if known and not off:
            off = (known.get("role") or "").strip().lower() in ROLES or "hidden" in known or (known.get("aria-hidden") or "").lower() == "true" or bool(HIDDEN(known.get("style") or ""))
            if tag not in ("html", "body", "article", "main"):
                names = [w for key in ("class", "id") for w in (known.get(key) or "").split() if not w.lower().startswith(LAYOUT)]
                doubt |= frozenset(w.lower() for name in names for w in SPLIT(name)) & NOISE - WHOLE | {w.lower() for w in names} & WHOLE
        if not off and (tag == "header" or words & HEADERS and tag not in ("html", "body", "article", "main", "h1", "h2")):
            if not any(self.tag[n] in ("article", "main") for n in self.open):
                off = tag == "header"
                doubt |= words & HEADERS
        if (off or doubt) and not self.dropped[above]:
            self.flush()
        if doubt and not off:
            self.doubted[len(self.tag)] = doubt
        self.parent.append(above)
        self.tag.append(tag)
        self.words.append(words)
        self.dropped.append(off)
        self.open.append(len(self.tag) - 1)
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        block = tag in BLOCKS
        if block:
            self.flush()
        for depth in range(len(self.open) - 1, 0, -1):
            here = self.tag[self.open[depth]]
            if here == tag:
                if self.dropped[self.open[depth]]:
                    self.pieces, self.linked = [], 0
                self.pop_to(depth)
                return
            if not block and here in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self.dropped[self.open[-1]]:
            return
        self.pieces.append(data)
        if self.links:
            self.linked += len(data)

    def unknown_decl(self, data: str) -> None:
        pass


def _value(text: str, in_links: int) -> float:
    """Points of a block."""
    prose = 1 - in_links / len(text)
    return (1 + text.count(",") + min(len(text) / 100, 3)) * prose if len(text) >= 25 else len(text) / 50 * prose


def _settle(page: _Page) -> None:
    """Takes the blocks out that lie in doubted elements, unless those hold the article; if nothing is left, all stay."""
    if not page.doubted:
        return
    doubted = page.doubted

    def doubts(node: int) -> list[int]:
        found = []
        while node >= 0:
            if node in doubted:
                found.append(node)
            node = page.parent[node]
        return found

    # elements come after their parents
    inside = [False] * len(page.tag)
    for n in range(1, len(page.tag)):
        inside[n] = inside[page.parent[n]] or page.tag[page.parent[n]] in ("article", "main")
    bodies = {n for n in range(len(page.tag)) if page.tag[n] in ("article", "main") and not page.dropped[n]}
    wraps = {n: doubts(n) for n in bodies if not page.words[n] & THREADS}
    # related texts may be articles too, where the page has one outside all doubt
    held = set() if any(not w for w in wraps.values()) else {d for w in wraps.values() for d in w if not inside[d]}
    total, part, above = 0.0, dict.fromkeys(doubted, 0.0), []
    for node, text, in_links in page.blocks:
        above.append(doubts(node))
        value = _value(text, in_links)
        if not any(doubted[d] & THREADS and d not in held for d in above[-1]):
            total += value
            for d in above[-1]:
                part[d] += value
    spared = held | {d for d in doubted if 2 * part[d] > total}
    left = [b for b, a in zip(page.blocks, above) if spared.issuperset(a)]
    page.blocks = left or page.blocks


def _scores(page: _Page) -> tuple[dict[int, float], dict[int, float]]:
    """Discounted points, and link density, of every element that holds text."""
    points: dict[int, float] = {}
    chars: dict[int, int] = {}
    linked: dict[int, int] = {}
    for node, text, in_links in page.blocks:
        value = _value(text, in_links)
        level, at = 0, node
        while at >= 0:
            chars[at] = chars.get(at, 0) + len(text)
            linked[at] = linked.get(at, 0) + in_links
            # the paragraph passes its points on; it is no container itself
            if level == 1 or level == 0 and page.tag[node] not in ("p", "pre", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "blockquote"):
                points[at] = points.get(at, 0.0) + value
            elif level:
                points[at] = points.get(at, 0.0) + value / (2 if level == 2 else 3 * level)
            at = page.parent[at]
            level += 1
    density = {n: linked[n] / chars[n] for n in chars}
    return {n: v * (1 - density[n]) for n, v in points.items()}, density


def main_text(html: str | None) -> str:
    """Blocks of the main text of a page, joined by line ends."""
    page = _Page()
    page.feed(html or "")
    page.close()
    page.flush()
    _settle(page)
    if not page.blocks:
        return ""
    scores, density = _scores(page)
    best = max(scores, key=lambda n: (scores[n], -n), default=0)
    # an article is one text even where it has parts
    at, kept = best, {best}
    while at > 0:
        if page.tag[at] in ("article", "main") or (page.tag[at] in ("div", "section") and page.words[at] & ARTICLE):
            kept = {at}
            if page.tag[at] == "article":
                break
        at = page.parent[at]
    top = next(iter(kept))
    if page.tag[top] not in ("article", "main", "body", "html", "#root"):
        least = max(10.0, 0.2 * scores.get(top, 0.0))
        size: dict[int, int] = {}
        for node, text, _ in page.blocks:
            size[node] = size.get(node, 0) + len(text)
        for n in {*scores, *size}:
            if page.parent[n] == page.parent[top] and n != top:
                prose = page.tag[n] == "p" and size.get(n, 0) >= PROSE and density[n] < 0.25
                if scores.get(n, 0.0) >= least and density[n] < 0.5 or prose or page.tag[n] in ("h1", "h2"):
                    kept.add(n)
    out = []
    for node, text, _ in page.blocks:
        at = node
        while at >= 0 and at not in kept:
            at = page.parent[at]
        if at >= 0:
            out.append(text)
    return "\n".join(out)


def extracted(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BATCH):
                part = batch.slice(start, ROWS_PER_BATCH)
                texts = pa.array([main_text(h.as_py()) for h in part.column("html")], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), texts], ["page_id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string")
