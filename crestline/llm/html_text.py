"""Main text of web pages by text-to-tag ratios.

A streaming parser turns a page into lines, one for each block of text, with the
characters and tags of each. Elements that never are content (menus, headers,
footers, asides, forms, scripts, styles, hidden parts), or whose class, id or role
names an advert, notice, sidebar, comment section or the like, give no lines. The
ratios of text to tags are smoothed with a Gaussian along the page and split at a
threshold by two-means clustering. The lines above it choose the content: it is
within the innermost region (article, main, section, div, table cell or the page)
that holds nine tenths of their characters.

Clustering alone drops short paragraphs, so lines below the threshold are content
too where those above it are: if the region lies in an article or main, or
consists of articles, all lines of those are the text, as authors mark it so;
otherwise the lines of every region that directly holds a chosen line, those
between chosen lines, and beside them headings before the first and sentences before and
after that are no links, of the region or next to it. Menus or notices that nothing names lie
outside of that and go. A name doesn't rule an element out that has a main heading or
a main part in it and holds more text than all of the page that no name touches.

Cases: a null or empty page, or one without text, has empty text; plain text
without markup is one block; unclosed elements close with their parent, and end
tags of elements that aren't open count for nothing; white space is what Unicode
calls so, a no-break space included; repeated rows give repeated results; an empty
table gives an empty result; other columns may have any names. Time and memory
grow in proportion to the page, however deep its elements lie in one another.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import tidy

#: Elements whose text never is content.
NEVER = frozenset("nav header footer aside form script style noscript template head title iframe object embed svg canvas button select textarea option dialog menu".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in a class, id or role that name a part which isn't content.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense adslot banner sponsor sponsored promo promotion "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "header masthead footer sidebar aside complementary contentinfo widget widgets "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe subscription signup login search "
    "comment comments commentlist disqus respond replies reply "
    "related recommended recommendations share sharing social".split()
)
#: Elements that may be the region of the content.
REGIONS = frozenset("article main section div td body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end when the key starts within them.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NO_END = frozenset("p li dt dd tr td th option b i em strong a span font u small big tt s".split())
#: Those of NAMES that rule out an article or main too.
_NOT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies respond related recommended".split())
_WORD = re.compile(r"[a-z]+")
_TAG_OPEN = re.compile(r"<[A-Za-z/!?]")


#: Words of a class or id that say what a part has or is like, and not that it is one.
_HAVING, _STATES = frozenset("with has no is without".split()), frozenset("open opened closed enabled disabled allowed on off page layout wrapper".split())


def _named(value: str, names: frozenset[str]) -> bool:
    """Whether a class, id or role has one of the names; "content-with-sidebar", "comments-open" and the like tell of what's inside."""
    for token in value.lower().split():
        words = _WORD.findall(token)
        if words and words[-1] not in _STATES and _HAVING.isdisjoint(words) and not names.isdisjoint(words):
            return True
    return False


def _unwanted(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """"never" for what is no content by its element or as it is hidden, "named" by its class, id or role, or neither."""
    if tag in NEVER:
        return "never"
    named = ""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "never"
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return "never"
        if name in ("class", "id", "role") and value and tag not in ("html", "body") and _named(value, _NOT_ARTICLES if tag in ("article", "main") else NAMES):
            named = "named"
    return named


class Line(NamedTuple):
    text: str
    tags: int
    region: int
    heading: bool
    links: int  # characters within links
    named: int  # the innermost element around that its name rules out, 0 for none


class _Lines(HTMLParser):
    """Collects lines and the tree of regions: ``kind`` and ``parent`` by number, 0 being the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kind, self.parent = ["page"], [0]
        self.open: list[tuple[str, str, bool]] = []  # tag, why unwanted, region
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # where a tag is open, the outermost first
        self.walls: list[int] = []  # where elements are open that end tags of others don't pass
        self.inside = [0]  # regions around, the innermost last
        self.hidden = self.tags = self.headings = self.anchors = self.linked = 0
        self.held: list[str] = []
        self.outer, self.titled = [0], [False]  # of elements that their name rules out: the next around, and whether a main heading or main part is inside
        self.ruled = [0]  # those around, the innermost last

    def flush(self) -> None:
        if self.held and (text := " ".join("".join(self.held).split())):
            self.lines.append(Line(text, self.tags, self.inside[-1], self.headings > 0, self.linked, self.ruled[-1]))
            self.tags = 0
        self.held, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += not self.hidden
        if tag == "br":
            self.held.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
        # an open p ends where a block starts, an open li at the next
        ends = max((self.at[t][-1] for t in (*_ENDS.get(tag, ()), *(("p",) if tag in BLOCKS else ())) if self.at[t]), default=-1)
        if ends > (self.walls[-1] if self.walls else -1):
            self._close(ends)
        if tag in VOID:
            return
        unwanted = _unwanted(tag, attrs)
        region = not self.hidden and unwanted != "never" and tag in REGIONS
        if not self.hidden and unwanted == "named":
            self.outer.append(self.ruled[-1])
            self.titled.append(False)
            self.ruled.append(len(self.outer) - 1)
        if tag in ("h1", "main"):
            self.titled[self.ruled[-1]] = True
        if region:
            self.kind.append(tag)
            self.parent.append(self.inside[-1])
            self.inside.append(len(self.kind) - 1)
        self.at[tag].append(len(self.open))
        if tag not in _NO_END:
            self.walls.append(len(self.open))
        if self.hidden and unwanted == "named":
            unwanted = ""
        self.open.append((tag, unwanted, region))
        self.hidden += unwanted == "never"
        self.headings += tag in HEADINGS
        self.anchors += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def handle_endtag(self, tag):
        self.tags += not self.hidden
        if tag in BLOCKS:
            self.flush()
        # a stray end tag of an inline element doesn't end blocks
        if self.at[tag] and (tag in BLOCKS or tag not in _NO_END or not self.walls or self.at[tag][-1] > self.walls[-1]):
            self._close(self.at[tag][-1])

    def _close(self, k: int) -> None:
        while len(self.open) > k:
            tag, unwanted, region = self.open.pop()
            self.at[tag].pop()
            if self.walls and self.walls[-1] == len(self.open):
                self.walls.pop()
            if region:
                self.inside.pop()
            if unwanted == "named":
                self.ruled.pop()
            self.hidden -= unwanted == "never"
            self.headings -= tag in HEADINGS
            self.anchors -= tag == "a"

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)
            self.linked += len(data.strip()) if self.anchors else 0

    def wanted(self) -> list[Line]:
        """The lines that no name rules out; the name of an element with a main heading doesn't, if it holds more than all that no name touches."""
        own = [0] * len(self.outer)
        for x in self.lines:
            own[x.named] += len(x.text)
        held, titled = own[:], self.titled[:]
        for i in range(len(held) - 1, 0, -1):  # an element opens after those around it
            held[self.outer[i]] += held[i]
            titled[self.outer[i]] |= titled[i]
        gone = [False] * len(held)
        for i in range(1, len(held)):
            gone[i] = gone[self.outer[i]] or not (titled[i] and held[i] > own[0])
        return [x for x in self.lines if not gone[x.named]]


def smoothed(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """A Gaussian average along the lines; at the ends over those that exist."""
    reach = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """The middle between the centres of two clusters, by Lloyd's steps from the extremes."""
    low, high = float(values.min()), float(values.max())
    while True:
        middle = (low + high) / 2
        below, above = values[values < middle], values[values >= middle]
        new = (float(below.mean()) if len(below) else low, float(above.mean()))
        if new == (low, high):
            return middle
        low, high = new


def chosen_lines(lines: list[Line]) -> np.ndarray:
    """Which lines' smoothed ratios lie in the upper of two clusters."""
    ratio = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]))
    return ratio >= threshold(ratio)


def main_text(html: str | None) -> str:
    """The page's main text: its blocks joined by one space."""
    if not html:
        return ""
    parser = _Lines()
    end = html.rfind(">") + 1  # no tag ends after the last ">", so the parser needn't look for its end
    parser.feed(html[:end])
    tail = _TAG_OPEN.split(html[end:], maxsplit=1)[0]  # an unfinished tag is none and no text; any other "<" is text
    parser.feed(tail.replace("<", "&lt;"))
    parser.close()
    parser.flush()
    lines = parser.lines = parser.wanted()
    if not lines:
        return ""
    chosen = chosen_lines(lines)
    best = _region(parser, chosen)
    marked = _marked(parser, best, chosen)
    if marked:
        return " ".join(x.text for x, inside in zip(lines, _within(parser, marked), strict=True) if inside)
    inside = _within(parser, {best})
    at = [i for i, x in enumerate(chosen) if x and inside[i]]
    direct, first, last = {lines[i].region for i in at}, at[0], at[-1]
    kept = [ok and (x.region in direct or first <= i <= last) for i, (x, ok) in enumerate(zip(lines, inside, strict=True))]
    before, after = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    beside = {best, parser.parent[best]}
    near = lambda x: (x.region in beside or parser.parent[x.region] in beside) and _prose(x)
    while before and (lines[before - 1].heading or near(lines[before - 1])):
        before -= 1
        kept[before] = True
    while after + 1 < len(kept) and near(lines[after + 1]):
        after += 1
        kept[after] = True
    return " ".join(x.text for x, ok in zip(lines, kept, strict=True) if ok)


def _prose(line: Line) -> bool:
    """Whether a short line beside the content may be of it: a sentence that is no link for the most part and no copyright notice."""
    return 2 * line.links < len(line.text) and "©" not in line.text and "(c)" not in line.text.lower() and line.text.rstrip("\"'”’»)")[-1:] in (".", "!", "?", "…", ":")


def _votes(parser: _Lines, chosen: np.ndarray) -> list[int]:
    """The characters of the chosen lines in each region and those within it."""
    votes = [0] * len(parser.kind)
    for x, ok in zip(parser.lines, chosen, strict=True):
        if ok:
            votes[x.region] += len(x.text)
    for r in range(len(votes) - 1, 0, -1):  # a region opens after its parent
        votes[parser.parent[r]] += votes[r]
    return votes


def _region(parser: _Lines, chosen: np.ndarray) -> int:
    """The innermost region with nine tenths of the chosen characters."""
    votes = _votes(parser, chosen)
    return max(r for r, n in enumerate(votes) if n * 10 >= votes[0] * 9)  # numbered as they open, so the largest is innermost


def _marked(parser: _Lines, best: int, chosen: np.ndarray) -> set[int]:
    """The articles, or the main, that the content region lies in or consists of; none if there are no such."""
    for kind in ("article", "main"):
        r = best
        while r and parser.kind[r] != kind:
            r = parser.parent[r]
        if r:
            return {x for x, k in enumerate(parser.kind) if k == kind and parser.parent[x] == parser.parent[r]}
    votes = _votes(parser, chosen)
    inside = _descends(parser, {best})
    for kind in ("article", "main"):
        found = {r for r, k in enumerate(parser.kind) if k == kind and inside[r]}
        outer = _descends(parser, found)
        found = {r for r in found if not outer[parser.parent[r]]}
        if sum(votes[r] for r in found) * 2 > votes[best]:
            return found
    return set()


def _descends(parser: _Lines, regions: set[int]) -> list[bool]:
    """Whether each region is one of those or within one."""
    out = [r in regions for r in range(len(parser.kind))]
    for r in range(1, len(out)):
        out[r] = out[r] or out[parser.parent[r]]
    return out


def _within(parser: _Lines, regions: set[int]) -> list[bool]:
    inside = _descends(parser, regions)
    return [inside[x.region] for x in parser.lines]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
