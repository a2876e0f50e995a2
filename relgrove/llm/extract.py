"""Main text of web pages (operator 5).

The events of the standard library's streaming parser give the page's lines: a
line is the text between two block tags. For each line, the ratio of text to
tags is smoothed by a Gaussian, and lines over a threshold (the standard
deviation of the ratios) form clusters of content. The clusters select regions:

- Where the page marks articles (``article``, ``main``, their roles), a region
  is a marked part, and the siblings of the greatest ratio mass are selected,
  each that holds a cluster, unless the unmarked clusters have ``MARK_WEIGHT``
  times their mass.
- Else the region reaches from the first to the last cluster, without lines at
  its ends that are mostly links or a copyright, and without menus within:
  neighbouring lines of links only, or a line of several. Text of links counts
  for no ratio there.

A region's lines are kept whole, short ones too. Names help: scripts, styles
and controls are no lines at all; lines of a block that is a form, or whose
class or id names an advert, a notice, a sidebar or the like, are left out, but
not if it is rather a wrapper of the page (``opened``: next to no text lies
outside of such blocks). Blocks of reader comments are never opened.

Defined results: null or empty html gives an empty text, as does a page without
any text outside of the parts left out, or of links only. A page of which
nothing stands out has its greatest ratio as the one cluster. Tags that are
never closed end with their parent or the page; end tags without a start are
skipped at once, so pages of any length and depth take linear time. Repeated
rows are rows of their own. A null page_id or url stays null. An empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title nav footer aside button select textarea iframe svg canvas object audio video dialog menu datalist map search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of a class or an id that name parts which are no article text.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay sidebar sidebars aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus respond replies reply share sharing social related recommended recommendations newsletter subscribe subscription signup login widget widgets pagination pager skip copyright adbox adblock adunit adcontainer adwrapper leaderboard skyscraper topnav mainnav subnav sidenav sitenav pagenav navlist cookiebar cookiebanner commentlist".split()
)
#: Those of them that name what readers wrote.
COMMENTS = frozenset("comment comments commentlist disqus respond replies reply".split())
#: Words that turn the meaning of a name around (with-sidebar, comments-open): it is that of a page or a wrapper.
QUALIFIERS = frozenset("with has have no without free less not open closed enabled disabled layout".split())
#: Words that make a header one of the article.
OWN_HEADERS = frozenset("article post entry content story title".split())
_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Tags whose class or id says nothing: whole pages, and headings with anchors.
NAMED_FREELY = frozenset("html body main h1 h2 h3 h4 h5 h6".split())
_COPYRIGHT = re.compile(r"©|\(c\)\s*\d|copyright\b|all rights reserved", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A start tag of the key ends an open element of the values (HTML's implied end tags).
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_P_ENDERS = BLOCKS - {"body", "head", "html"}
_SCOPES = frozenset("article aside body div footer form header main nav section table td ul ol dl blockquote".split())
#: How many times the marked parts' ratio mass the unmarked clusters need to replace them.
MARK_WEIGHT = 3.0
#: Article numbers of one parent begin at a multiple of this.
_SIBLINGS = 1 << 20
#: A block that is left out is opened if less than this share of its text lies outside of such blocks.
WRAPPED = 0.2
SIGMA, RADIUS = 1.0, 2
_KERNEL = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-RADIUS, RADIUS + 1)]


def _named_away(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> str | None:
    """How a start tag opens a part that is no article text: "gone", "comments", "named", or None if it does not."""
    if tag in SKIPPED or tag == "header" and not in_article:
        return "gone"
    how = "named" if tag == "form" else None
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and (v or "").lower() == "true" or k == "style" and v and _HIDDEN.search(v):
            return "gone"
        if k == "role" and (v or "").lower() in ROLES:
            how = how or "named"
        if k in ("class", "id") and v and tag not in NAMED_FREELY:
            for name in v.split():
                words = {w.lower().rstrip("0123456789") for w in _SPLIT.split(name)}
                telling = words & WORDS - ({"header"} if in_article or words & OWN_HEADERS else set())
                if telling and not words & QUALIFIERS and (tag != "article" or words <= WORDS | {"body", "item"}):
                    how = "comments" if telling & COMMENTS else how or "named"
    return "gone" if how and tag not in BLOCKS else how


def _marks_article(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    return tag in ("article", "main") or any(k == "role" and (v or "").lower() in ("article", "main") or k == "itemprop" and (v or "").lower() == "articlebody" for k, v in attrs)


class Line(NamedTuple):
    text: str
    tags: int
    article: int = 0  # number of the marked article, 0 for none
    linked: int = 0  # characters of its links
    links: int = 0
    part: int = 0  # number of the innermost block left out by its name, 0 for none


class Part(NamedTuple):
    """A block left out by its name: the number of the one around it, and whether it holds reader comments."""

    parent: int
    comments: bool


class Lines(HTMLParser):
    """Collects the lines of a page, and the blocks that are left out by their names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.blocks: list[Part] = [Part(0, False)]
        self.open: list[tuple[str, bool, int, int]] = []  # tag, leads to skipping, article and part around it
        self.places: dict[str, list[int]] = {}  # tag: where it stands in open
        self.scopes: list[int] = [-1]  # where tags of _SCOPES stand in open
        self.parts: list[str] = []
        self.parents: dict[int, int] = {}  # serial number of a parent: last article number in it
        self.serials: list[int] = [0]  # those of the open elements
        self.serial = self.tags = self.articles = self.article = self.skipping = self.anchors = self.linked = self.links = self.part = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append(Line(text, max(1, self.tags), self.article, min(self.linked, len(text)), self.links, self.part))
        self.parts, self.tags, self.linked, self.links = [], 0, 0, 0

    def pop(self) -> None:
        tag, skips, self.article, self.part = self.open.pop()
        self.serials.pop()
        self.places[tag].pop()
        if tag in _SCOPES:
            self.scopes.pop()
        self.skipping -= skips
        self.anchors -= tag == "a"

    def end(self, tag: str, within: int) -> None:
        """Closes the innermost open ``tag`` at ``within`` or further in, and what is open in it."""
        at = self.places.get(tag)
        if at and at[-1] >= within:
            for _ in range(len(self.open) - at[-1]):
                self.pop()

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            for closing in ({"p"} if tag in _P_ENDERS else set()) | _ENDS.get(tag, set()):
                self.end(closing, self.scopes[-1])
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        away = _named_away(tag, attrs, bool(self.article))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in _SCOPES:
            self.scopes.append(len(self.open))
        self.open.append((tag, away == "gone", self.article, self.part))
        self.serial += 1
        self.serials.append(self.serial)
        self.skipping += away == "gone"
        self.anchors += tag == "a"
        self.links += tag == "a"
        if away and away != "gone" and not self.skipping:
            self.blocks.append(Part(self.part, away == "comments"))
            self.part = len(self.blocks) - 1
        if _marks_article(tag, attrs) and not self.skipping and not self.article:
            parent = self.serials[-2]
            if parent not in self.parents:
                self.articles += 1
                self.parents[parent] = self.articles * _SIBLINGS
            else:
                self.parents[parent] += 1
            self.article = self.parents[parent]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers do: the slash is ignored

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        self.end(tag, 0 if tag in BLOCKS else self.scopes[-1])  # a stray inline end tag closes nothing outside of its block

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            if self.anchors:
                self.linked += len(" ".join(data.split()))

    def close(self):
        super().close()
        self.end_line()


def _closed(html: str) -> str:
    """``html`` without what makes the parser start over again and again: tags that never end are text, a comment that never ends goes."""
    end = html.rfind(">") + 1
    tail = html[end:]
    if tail.count("<") > 1:
        comment = tail.find("<!--")
        html = html[:end] + tail[: comment if comment >= 0 else None].replace("<", "&lt;")
    return html


def parsed(html: str) -> Lines:
    html = _closed(html)
    while True:
        parser = Lines()
        try:
            parser.feed(html)
            parser.close()
            return parser
        except AssertionError:  # the parser's answer to "<![" with an unknown word
            if "<![" not in html:
                raise
            html = html.replace("<![", "&lt;![")


def opened(lines: list[Line], blocks: list[Part]) -> list[Line]:
    """The lines that lie in no block that is left out, once wrappers of the page are opened.

    While the lines outside have under ``WRAPPED`` of the text of the greatest
    block (all its text, if it alone holds a marked article), that block is a
    wrapper and is opened, together with the greatest block within it as long as
    that one has as good as all its text.
    """
    if len(blocks) == 1:
        return lines
    own, marked = [0] * len(blocks), [False] * len(blocks)
    for x in lines:
        own[x.part] += len(x.text) - x.linked
        marked[x.part] |= x.article > 0
    if any(marked[:1]) and own[0]:
        return [x for x in lines if not x.part]
    total, heaviest = list(own), [0] * len(blocks)
    comments = [False] * len(blocks)
    for k, p in enumerate(blocks):
        comments[k] = p.comments or comments[p.parent]
    for k in range(len(blocks) - 1, 0, -1):
        parent = blocks[k].parent
        if comments[k]:
            total[k] = 0
            continue
        if parent:
            total[parent] += total[k]
            marked[parent] |= marked[k]
        if not heaviest[parent] or total[k] > total[heaviest[parent]]:
            heaviest[parent] = k
    seen = [True] + [False] * (len(blocks) - 1)  # blocks whose lines count
    while True:
        best = outside = 0
        for k in range(1, len(blocks)):
            if seen[k]:
                outside += own[k]
            elif seen[blocks[k].parent] and not comments[k] and total[k] > total[best] * (best > 0):
                best = k
        outside += own[0]
        if not best or outside >= total[best] * (1.0 if marked[best] else WRAPPED):
            return [x for x in lines if seen[x.part]]
        seen[best] = True
        while heaviest[best] and total[heaviest[best]] > (1 - WRAPPED) * total[best]:
            best = heaviest[best]
            seen[best] = True


def lines_of(html: str) -> list[Line]:
    parser = parsed(html)
    return opened(parser.lines, parser.blocks)


def smoothed(ratios: list[float]) -> list[float]:
    """The ratios smoothed by a Gaussian over ``RADIUS`` lines on both sides; the kernel is cut at the ends."""
    out = []
    for k in range(len(ratios)):
        total = weight = 0.0
        for j, w in enumerate(_KERNEL, k - RADIUS):
            if 0 <= j < len(ratios):
                total += w * ratios[j]
                weight += w
        out.append(total / weight)
    return out


def threshold(ratios: list[float]) -> float:
    """The standard deviation of the ratios, or the greatest of them if that is less."""
    mean = sum(ratios) / len(ratios)
    return min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(ratios))


def content_lines(lines: list[Line]) -> list[str]:
    """The lines of the content region."""
    if not lines:
        return []
    marked = any(x.article for x in lines)
    ratios = smoothed([(len(x.text) - (0 if marked else x.linked)) / x.tags for x in lines])
    least = threshold(ratios)
    content = [r >= least for r in ratios]
    if marked:
        mass: dict[int, float] = {}
        groups: dict[int, float] = {}
        for x, r, c in zip(lines, ratios, content, strict=True):
            mass[x.article] = mass.get(x.article, 0.0) + r * c
            groups[x.article // _SIBLINGS] = groups.get(x.article // _SIBLINGS, 0.0) + r * c
        bare = groups.pop(0, 0.0)
        best = max(groups, key=lambda g: (groups[g], -g))
        if bare <= MARK_WEIGHT * groups[best]:
            own = {a for a in mass if a and a // _SIBLINGS == best and mass[a] > 0}
            if not own:
                own = {min(a for a in mass if a and a // _SIBLINGS == best)}
            return [x.text for x in lines if x.article in own]
        lines, content = (list(x) for x in zip(*((x, c) for x, c in zip(lines, content, strict=True) if not x.article), strict=True))
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    while first <= last and _no_edge(lines[first]):
        first += 1
    while first <= last and _no_edge(lines[last]):
        last -= 1
    kept = range(first, last + 1)
    bare_links = [2 * x.linked > len(x.text) for x in lines]
    menu = [bare_links[k] and (lines[k].links > 1 or k > first and bare_links[k - 1] or k < last and bare_links[k + 1]) for k in range(len(lines))]
    return [lines[k].text for k in kept if not menu[k]]


def _no_edge(line: Line) -> bool:
    """Whether a line can't begin or end a region: mostly links (a menu), or a copyright."""
    return 2 * line.linked > len(line.text) or bool(_COPYRIGHT.match(line.text))


def main_text(html: str | None) -> str:
    return "\n".join(content_lines(lines_of(html))) if html else ""


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches):
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
