"""Main-text extraction from HTML by text-to-tag ratios.

The page streams through the standard library's parser.  Block-level tags cut
it into *lines* (one block each), in page order; each line carries its text
and the number of tags met while it was open.  A line's score is its text
length per tag; the scores are smoothed with a Gaussian along the page, and a
two-means clustering of the smoothed scores puts the threshold between
boilerplate and content.

The content lines select the region.  It is the ``article`` elements that hold
at least half of the content of the ``main`` around them, else that ``main``,
else the smallest element that holds every content line, from its first
content line (and the headings before it) to its last, menu lines left out.
Short paragraphs and headings inside the region survive a low score of their
own.

Elements that are not article text by their tag, role or name (navigation,
headers, footers, asides, forms, adverts, notices, sidebars, comment lists)
are marked.  A mark lowers the score of the lines below it and cuts the
element out of the region, but never decides alone: a marked element around
the region stays, and so does a marked one that holds half of the region's
content, and a header with the region's heading.  Only what is never shown as
text (scripts, styles, controls, media) is dropped while parsing.

Work is linear in the page: every element and line is visited a fixed number
of times.

Defined results: null or empty HTML gives the empty text; HTML without tags is
one block; unclosed and stray tags are tolerated; nothing is cut or capped;
repeated pages and null ids are treated alike; an empty table gives an empty
result; clashing extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never shown as text of the page.
NEVER = frozenset("script style noscript template title iframe svg math object audio video canvas button select textarea datalist".split())
#: Marked by their tag or role.
APART = frozenset("nav aside footer form header dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "legend", "summary", "tbody", "tfoot", "thead", "tr"}
#: Marked by a class or id that is such a name as a whole; `has-sidebar` or `post-header` is not.
_NAME = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary|mobile|sticky|inline|blog|user|reader|cookie|post|js)[-_])*?"
    r"(?:ads?|advert(?:s|isement|isements|ising)?|sponsor(?:ed|s)?|banners?|cookies?|consent|gdpr|nav(?:bar|igation)?|menus?|breadcrumbs?"
    r"|side-?bars?|(?:site-|page-|global-|top-|main-)?header|footers?|masthead|comments?|disqus|respond|replies|share|sharing|social|related|recommended|recommendations|promos?"
    r"|promotion|newsletter|subscribe|subscription|signup|login|popups?|modal|overlay|notices?|notification|alert|toolbar|widgets?|pagination|pager|skip-?link)"
    r"(?:[-_](?:bar|box|list|links?|buttons?|block|container|wrapper|wrap|area|section|widgets?|banner|notice|popup|form|items?|left|right|top|bottom|slot|unit|thread|posts|articles|inner|menu|nav|icons?|panel|main|primary|\d+))*",
    re.I,
)
_NOT_NAMES = frozenset(("post-header", "post_header", "blog-header"))
SIGMA, MARKED_SCORE = 2.0, 0.25


def is_marked(tag: str, attrs) -> bool:
    if tag in APART:
        return True
    for key, value in attrs:
        if key == "role" and value in APART_ROLES:
            return True
        if key in ("class", "id") and value and any(_NAME.fullmatch(v) and v.lower() not in _NOT_NAMES for v in value.split()):
            return True
    return False


class LineParser(HTMLParser):
    """Turns parser events into elements (in page order, parents first) and lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int]] = []  # (tag, element that holds what follows)
        self.places: defaultdict[str, list[int]] = defaultdict(list)  # where each tag is open, the innermost last
        self.blocks: list[int] = []  # where block tags are open
        self.tags_of, self.parents, self.marks = [""], [0], [False]  # elements; 0 is the page
        self.hidden = 0  # open elements from the first hidden one on
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element

    def updatepos(self, i, j):
        """Line numbers are not needed; counting them costs a scan of every event."""
        return j

    def _flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, max(1, self.tags), self.linked, self._here()))
                self.tags = self.linked = 0
            self.parts = []

    def _here(self) -> int:
        return self.open[-1][1] if self.open else 0

    def _push(self, tag: str, at: int):
        self.places[tag].append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, at))

    def _cut(self, i: int):
        """Closes the open elements from place i on."""
        for tag, _ in self.open[i:]:
            self.places[tag].pop()
        del self.open[i:]
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            if tag not in ("body", "main", "article"):
                if tag not in VOID:
                    self._push(tag, 0)
                    self.hidden += 1
                return
            self._cut(len(self.open) - self.hidden)
            self.hidden = 0  # the hidden element was never closed
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCK:
            if tag in CLOSES_P:
                self._close_implied("p", BLOCK - {"p"})
            if tag == "li":
                self._close_implied("li", frozenset(("ul", "ol", "menu")))
            self._flush()
        elif tag in ("td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in NEVER or any(k == "hidden" for k, _ in attrs):
            self._push(tag, self._here())
            self.hidden = 1
            return
        here = self._here()
        if tag in BLOCK:
            self.tags_of.append("main" if ("role", "main") in attrs else tag)
            self.parents.append(here)
            self.marks.append(is_marked(tag, attrs))
            here = len(self.parents) - 1
        self._push(tag, here)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_implied(self, tag, barrier):
        for i in reversed(self.blocks):
            if self.open[i][0] == tag:
                self._flush()
                self._cut(i)
                return
            if self.open[i][0] in barrier:
                return

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if not self.hidden:
            self.tags += 1
        if not self.places[tag]:
            return
        i = self.places[tag][-1]
        if self.hidden:
            lowest = len(self.open) - self.hidden
            if i >= lowest:
                self.hidden -= len(self.open) - i
                self._cut(i)
                return
            if tag not in ("body", "html", "article", "main"):
                return
            self._cut(lowest)
            self.hidden = 0  # the hidden element was never closed
        if self.blocks and self.blocks[-1] >= i:
            self._flush()
        self._cut(i)

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)
            if self.places["a"]:
                self.linked += len(data)

    def finish(self):
        self.close()
        self._flush()
        return self.lines


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the page's ends."""
    radius = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = np.convolve(values, kernel)[radius : radius + len(values)]
    return full / np.convolve(np.ones(len(values)), kernel)[radius : radius + len(values)]


def content_mask(scores: np.ndarray) -> np.ndarray:
    """Lines of the upper cluster of a two-means clustering of smoothed scores."""
    if len(scores) < 3 or np.ptp(scores) < 20:  # no line stands out
        return np.ones(len(scores), bool)
    low, high = float(scores.min()), float(scores.max())
    for _ in range(30):
        upper = scores >= (low + high) / 2
        new = (float(scores[~upper].mean()), float(scores[upper].mean()))
        if new == (low, high):
            break
        low, high = new
    return upper


def _inherited(own: list[bool], parents: list[int]) -> list[bool]:
    """An element has it if it or an element around it does."""
    out = list(own)
    for i in range(1, len(out)):
        out[i] = out[i] or out[parents[i]]
    return out


def _sums(own: np.ndarray, parents: list[int]) -> list[float]:
    """Sum of the numbers of each element and all elements inside it."""
    out = own.tolist()
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += out[i]
    return out


def choose_region(parser: LineParser, at: np.ndarray, weight: np.ndarray, marked: np.ndarray) -> tuple[set[int], bool]:
    """(elements of the region, whether tags name it); ``weight`` is each line's content."""
    tags, parents = parser.tags_of, parser.parents
    inside = _sums(np.bincount(at, weight, len(parents)), parents)
    around = _inherited(parser.marks, parents)
    for kinds in (("article", "main"), ("main",)):
        nested = _inherited([t == kinds[0] for t in tags], parents)
        tops = [i for i, t in enumerate(tags) if t == kinds[0] and inside[i] > 0 and not nested[parents[i]]]
        tops = [i for i in tops if not around[i]] or tops
        if tops and kinds[0] == "article":  # teasers and comments beside the text are articles too
            mains = [i for i, t in enumerate(tags) if t == "main"]
            within = _inherited([t == "main" for t in tags], parents)
            if mains and 2 * sum(inside[i] for i in tops if within[i]) < max(inside[i] for i in mains):
                continue
        if tops:
            return set(tops), True
    counts = weight > 0
    counts = counts & ~marked if (counts & ~marked).any() else counts
    holds = _sums(np.bincount(at[counts], minlength=len(parents)).astype(float), parents)
    return {max(i for i, n in enumerate(holds) if n == holds[0])}, False  # elements are numbered outside in


def main_text(html: str | None) -> str:
    """The page's main text, one block a line."""
    if not html:
        return ""
    parser = LineParser()
    parser.feed(html)
    lines = parser.finish()
    if not lines:
        return ""
    parents, tags = parser.parents, parser.tags_of
    at = np.array([x[3] for x in lines])
    size = np.array([len(x[0]) for x in lines], float)
    around = _inherited(parser.marks, parents)
    marked = np.array([around[i] for i in at])
    scores = size / np.array([x[1] for x in lines], float)
    content = content_mask(smooth(np.where(marked, MARKED_SCORE * scores, scores)))
    region, by_tag = choose_region(parser, at, size * content, marked)
    inside = _inherited([i in region for i in range(len(parents))], parents)
    weight = _sums(np.bincount(at, size * content, len(parents)), parents)
    whole = sum(weight[i] for i in region)
    heads = _sums(np.bincount(at, [tags[i] in ("h1", "h2") for i in at], len(parents)), parents)
    cut = [False] * len(parents)
    for i in range(1, len(parents)):
        own = parser.marks[i] and inside[parents[i]] and i not in region
        if own and (tags[i] not in APART - {"form", "header"} and 2 * weight[i] >= whole > 0 or tags[i] == "header" and heads[i]):
            own = False
        cut[i] = own or cut[parents[i]] and i not in region
    keep = np.array([inside[i] and not cut[i] for i in at])
    if not by_tag:
        chosen = np.flatnonzero(keep & content)
        if len(chosen):
            first, last = int(chosen[0]), int(chosen[-1])
            while first and keep[first - 1] and tags[at[first - 1]] in HEADINGS:
                first -= 1
            keep[:first] = keep[last + 1 :] = False
            menu = np.array([2 * x[2] > len(x[0]) for x in lines])
            keep &= content | ~menu
    return "\n".join(x[0] for x, yes in zip(lines, keep, strict=True) if yes)


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(id, kept columns, text) for every page."""
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            texts = pa.array([main_text(h) for h in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], texts], names=["id", *kept, "text"])

    kinds = [f"{k} {pages.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep, strict=True)]
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), *(F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)))
    return rows.mapInArrow(run, ", ".join([f"id {pages.schema[id_col].dataType.simpleString()}", *kinds, "text string"])).toDF("id", *keep, "text")
