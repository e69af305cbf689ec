"""Main text of web pages by smoothed text-to-tag ratios.

A streaming parser cuts a page into lines, one per block of text, each with its characters, the
tags met in it and the elements around it. The ratio of characters to tags is smoothed with a
Gaussian over the lines; lines above a threshold form clusters, and the smallest element that
holds all clusters is the content region. All of its text is main text but what stands in
elements that never hold any: menus, page headers and footers, sidebars, notices, adverts, forms,
scripts, styles and comments of readers, inside a line too. A class, id or role that looks like a
notice's does not count on an element that holds an article or, without one, most of the clusters' text.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import map_batches

#: Deviation of the smoothing, in lines, its reach, and the threshold as a share of the mean ratio.
SIGMA, REACH, THRESHOLD = 1.5, 4, 0.5
#: An article or main element that holds this share of the clusters' text is the region.
REGION_SHARE = 0.6

_BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text, and those of them that stand inside a line without ending it.
_NEVER = frozenset("aside button canvas datalist dialog footer form head header iframe input label legend menu nav noscript object option script select style svg template textarea title".split())
_INLINE = frozenset("button canvas datalist iframe input label noscript object option script select style svg template textarea".split())
#: Elements that hold a piece of writing; a header of their own belongs to it.
_WRITING = frozenset("article main".split())
#: Tokens of a class, id or role that mark an element without main text.
_MARKS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion related search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand before and behind a mark in one name: site-footer, ad-slot-3. Layouts such as with-sidebar or search-results are no marks.
_BEFORE = frozenset("bottom global main page primary secondary site top".split())
_BEHIND = frozenset("area articles bar block box buttons container form inner item items links list overlay posts section signup slot stories unit wrap wrapper".split())
#: Elements that are no content region: paragraphs, headings, items, cells and what stands inside lines.
_INNER = frozenset("p b i a em strong span font u small h1 h2 h3 h4 h5 h6 li td tr blockquote ul ol dl dt dd pre figure table thead tbody tfoot".split())
#: An opening tag of the key ends open elements of the named kinds.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Lists and tables that hold items and cells, and elements that end the search for an open paragraph.
_LISTS = ("ul", "ol", "dl", "table", "menu", "select")
_CONTAINERS = tuple(sorted(_BLOCKS - {"p"}))
#: Elements whose class or id names a layout and never a notice.
_UNMARKED = frozenset("html body h1 h2 h3 h4 h5 h6".split())
#: Marks of what readers write; they hold whatever stands inside.
_READERS = frozenset("comment comments".split())
_PART = re.compile(r"[a-z]+")


def _marked(token: str) -> bool:
    """Whether a whole token is a mark or a known compound of one."""
    parts = _PART.findall(token)
    while parts and parts[0] in _BEFORE:
        parts = parts[1:]
    while parts and parts[-1] in _BEHIND:
        parts = parts[:-1]
    return bool(parts) and all(p in _MARKS for p in parts)


class _Line:
    """One block of text: its runs as (text, element), the tags met in it and the element around it."""

    __slots__ = ("runs", "tags", "at")

    def __init__(self, runs: list[tuple[str, int]], tags: int, at: int) -> None:
        self.runs, self.tags, self.at = runs, tags, at


class _Lines(HTMLParser):
    """Collects the lines of a page and a table of its elements by number.

    An element knows its parent's number, whether it is barred, and whether its class, id or
    role looks like a notice's. Open elements are looked up by name and never searched for, so that
    work grows with the page whatever the nesting.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parent, self.barred, self.marked, self.writing = [""], [0], [False], [False], [False]
        self.stack, self.lines = [0], []
        self.places: dict[str, list[int]] = {}
        self.runs: list[tuple[str, int]] = []
        self.tags = 0

    def _cut(self) -> None:
        if any(text.strip() for text, _ in self.runs):
            self.lines.append(_Line(self.runs, self.tags, self.stack[-1]))
            self.tags = 0
        self.runs = []

    def _last(self, *names: str) -> int:
        """The place in the stack of the innermost open element of these names, 0 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def _close(self, at: int) -> None:
        gone = self.stack[at:]
        if any(self.names[n] in _BLOCKS or (self.names[n] in _NEVER and self.names[n] not in _INLINE) for n in gone):
            self._cut()
        for n in gone:
            self.places[self.names[n]].pop()
        del self.stack[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS or (tag in _NEVER and tag not in _INLINE):
            self._cut()
        self.tags += 1
        if tag in _BLOCKS:
            # a block ends an open paragraph of the same container, and an item or cell its neighbour
            at = self._last("p")
            if at and at >= self._last(*_CONTAINERS):
                self._close(at)
            ends = _ENDS.get(tag)
            if ends and (at := self._last(*ends)) and at > self._last(*_LISTS):
                self._close(at)
        if tag == "br":
            self.runs.append((" ", self.stack[-1]))
        if tag in _VOID:
            return
        up = self.stack[-1]
        tokens = [w for key, value in attrs if key in ("class", "id", "role") and value for w in value.lower().split()] if tag not in _UNMARKED else []
        readers = any(_marked(w) and _READERS & {*_PART.findall(w)} for w in tokens)
        own_header = tag == "header" and self.writing[up]
        self.parent.append(up)
        self.barred.append(self.barred[up] or readers or (tag in _NEVER and not own_header))
        self.marked.append(tag not in _WRITING and any(map(_marked, tokens)))
        self.writing.append(self.writing[up] or tag in _WRITING)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.names))
        self.names.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if at := self._last(tag):
            self._close(at)

    def handle_data(self, data: str) -> None:
        if not self.barred[self.stack[-1]]:
            self.runs.append((data, self.stack[-1]))


def lines_of(html: str | None) -> _Lines:
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser._cut()
    return parser


def smoothed(ratios: list[float], sigma: float = SIGMA, reach: int = REACH) -> list[float]:
    """The ratios after a Gaussian over neighbouring lines, cut off at the ends of the page."""
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(ratios)):
        near = range(max(0, i - reach), min(len(ratios), i + reach + 1))
        weights = [kernel[abs(i - j)] for j in near]
        out.append(sum(w * ratios[j] for w, j in zip(weights, near, strict=True)) / sum(weights))
    return out


def _joined(runs: list[tuple[str, int]], noise: list[bool]) -> str:
    """The text of a line's runs outside noise, white space as one space."""
    return " ".join("".join(text for text, at in runs if not noise[at]).split())


def _subtree_sums(parent: list[int], own: list[int]) -> list[int]:
    """For each element the sum over itself and all below it; a parent's number is smaller than its children's."""
    out = own.copy()
    for n in range(len(out) - 1, 0, -1):
        out[parent[n]] += out[n]
    return out


def main_text(html: str | None) -> str:
    """The blocks of the content region, in page order, joined by blank lines; empty if there is none."""
    page = lines_of(html)
    lines, size = page.lines, len(page.names)
    texts = [_joined(line.runs, page.barred) for line in lines]
    ratios = smoothed([len(t) / max(1, line.tags) for t, line in zip(texts, lines, strict=True)])
    if not lines:
        return ""
    limit = THRESHOLD * sum(ratios) / len(ratios)
    clusters = [i for i, r in enumerate(ratios) if r >= limit]
    # a marked element is noise, unless it holds a piece of writing or, on a page without one, most of the clusters' text
    own = [0] * size
    for i in clusters:
        own[lines[i].at] += len(texts[i])
    below, holds = _subtree_sums(page.parent, own), _subtree_sums(page.parent, [int(n in _WRITING) for n in page.names])
    noise = [False] * size
    for n in range(1, size):
        noise[n] = noise[page.parent[n]] or (page.marked[n] and not holds[n] and (holds[0] > 0 or below[n] < REGION_SHARE * below[0]))
    texts = [_joined(line.runs, noise) for line in lines]
    kept = [i for i, t in enumerate(texts) if t]
    clusters = [i for i in clusters if texts[i]] or kept
    if not kept:
        return ""
    # All outermost article and main elements with clusters are the region, with the clusters outside them, where they
    # hold most of the text; else it is the smallest element around all clusters. Numbers rise inwards.
    own = [0] * size
    for i in clusters:
        own[lines[i].at] += len(texts[i])
    weight = _subtree_sums(page.parent, own)
    total = weight[0]
    inner = [False] * size
    for n in range(1, size):
        inner[n] = inner[page.parent[n]] or page.names[page.parent[n]] in _WRITING
    outer = {n for n in range(1, size) if page.names[n] in _WRITING and not inner[n] and weight[n]}
    if sum(weight[n] for n in outer) < REGION_SHARE * total:
        outer = set()
    region = 0 if outer else max((n for n in range(size) if weight[n] == total and page.names[n] not in _INNER), default=0)
    within = [n in outer or (not outer and n == region) for n in range(size)]
    for n in range(1, size):
        within[n] = within[n] or within[page.parent[n]]
    dense = set(clusters) if outer else set()
    return "\n\n".join(texts[i] for i in kept if within[lines[i].at] or i in dense)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the main text of the whole html and its code points.

    The article is all outermost article and main elements with the dense text around them, or without one the
    smallest element around all dense text; an article's own header stays, as it holds its title.
    Character references are decoded and white space inside a block is one space. A long page is parsed
    by itself, with work in proportion to its size. Null or empty
    html and pages without a content region give an empty text. Null ids and urls are returned as
    they are; repeated rows are all returned; other columns are not read. An empty table gives an
    empty table.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(picked, make, "page_id long, url string, text string, n_chars long")
