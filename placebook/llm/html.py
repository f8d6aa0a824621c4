"""The main text of a web page, by text-to-tag ratios.

The standard library's parser gives a stream of events. Block elements cut it into lines; a line's ratio is its
characters per tag. Smoothed by a Gaussian, so that a short line among long ones counts as one of them, the ratios are
split by a threshold into content and the rest, and runs of content lines are clusters. The clusters choose a region of
the page, an article or else the innermost container that holds nearly all their text, and all lines of the region are
the main text, but for those of elements that by their name, role or class are not part of an article, and for links
outside the clusters. A form, or a container that only a word in its class or id sets apart, stays part of the page if it
holds the main element or article with most content, or without any nearly all content.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# The smoothing's width in lines, and the threshold in standard deviations of the smoothed ratios.
SIGMA = 1.0
THRESHOLD = 0.5
# A region holds at least this share of the content's characters.
REGION_SHARE = 0.9
# Characters given to the parser at a time.
PIECE = 1 << 16

# Elements by what they mean for the text.
SILENT = frozenset("script style noscript template title textarea select option button svg math iframe object canvas audio video datalist".split())
APART = frozenset("nav footer aside form dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar".split())
WRAPPERS = frozenset(["form"])
APART_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar ad ads adbox adslot advert adverts "
    "advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe subscription signup login paywall share sharing social related recommended comment comments disqus "
    "respond replies pagination pager skip search".split()
)
CONTAINERS = frozenset("html body main article section div header nav footer aside form dialog menu table tbody tr td th ul ol li dl dd dt figure blockquote center fieldset details".split())
BLOCKS = CONTAINERS | frozenset("head p h1 h2 h3 h4 h5 h6 pre hr br address figcaption summary caption thead tfoot legend hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(["article", "main"])
# Containers of one of these names never hold the main text.
COMMENTS = frozenset("comment comments disqus respond replies".split())


class Region:
    """An open or closed container: whether it is apart in any case, itself or by a parent, and whether it may be."""

    __slots__ = ("name", "parent", "apart", "doubtful", "depth")

    def __init__(self, name: str, parent: Region | None, apart: bool, doubtful: bool = False):
        self.name, self.parent, self.apart, self.doubtful = name, parent, apart, doubtful
        self.depth = parent.depth + 1 if parent else 0


class Line:
    __slots__ = ("text", "tags", "linked", "region")

    def __init__(self, text: str, tags: int, linked: int, region: Region):
        self.text, self.tags, self.linked, self.region = text, tags, linked, region


class LineReader(HTMLParser):
    """Cuts a page into lines."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.region = Region("", None, False)
        self.lines: list[Line] = []
        self.silent: list[str] = []
        self.pieces: list[str] = []
        self.tags = self.linked = self.links = 0
        self.aside: Region | None = None

    def read(self, page: str) -> list[Line]:
        for start in range(0, len(page), PIECE):
            self.feed(page[start : start + PIECE])
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # a tag that the page's end cuts off
            self.rawdata = ""
        self.close()
        self.end_line()
        return self.lines

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append(Line(text, self.tags, self.linked, self.aside or self.region))
            self.tags = self.linked = 0
        self.pieces = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            self.silent.append(tag)
        if self.silent:
            return
        if tag in BLOCKS:
            self.end_line()
            if tag != "br":
                self.aside = None
        self.tags += 1
        self.links += tag == "a"
        if tag in CONTAINERS or tag == "p":
            apart, doubtful = self.stands_apart(tag, attrs)
            if tag in CONTAINERS:
                self.region = Region(tag, self.region, self.region.apart or apart, doubtful)
            elif apart or doubtful:
                self.aside = Region(tag, self.region, True)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in SILENT:
            return
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in CONTAINERS and not self.silent:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            elif tag in ("body", "html"):
                self.silent = []
            return
        if tag in BLOCKS:
            self.end_line()
            self.aside = None
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        region = self.region
        while region.parent and region.name != tag:
            region = region.parent
        if region.parent:
            self.region = region.parent

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append(data)
            if self.links:
                self.linked += len(data)

    def stands_apart(self, tag: str, attrs: list) -> tuple[bool, bool]:
        """Whether an element is apart in any case, and whether it is so unless it holds the main text."""
        if tag in APART - WRAPPERS:
            return True, False
        inside = self.region
        while inside and inside.name not in MAIN:
            inside = inside.parent
        if tag == "header" and inside is None:
            return True, False
        doubtful = tag in WRAPPERS
        for name, value in attrs:
            value = (value or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, False
            if name == "role" and value.strip() in APART_ROLES:
                if value.strip() not in WRAPPERS:
                    return True, False
                doubtful = True
            if name in ("class", "id"):
                words = set(re.split(r"[^a-z]+", value))
                if tag not in ("html", "body", *MAIN):
                    if words & COMMENTS:
                        return True, False
                    doubtful = doubtful or bool(words & APART_NAMES)
                if tag == "article" and words & {"comment", "comments"}:
                    return True, False
        return False, doubtful


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Each value's mean with its neighbours, weighted by a Gaussian."""
    reach = max(1, math.ceil(2 * sigma))
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = mass = 0.0
        for k, weight in enumerate(weights, i - reach):
            if 0 <= k < len(values):
                total += weight * values[k]
                mass += weight
        out.append(total / mass)
    return out


def content_lines(lines: list[Line]) -> list[bool]:
    """Which lines are content by their smoothed ratio. Where all are alike, all are."""
    ratios = smoothed([len(line.text) / max(1, line.tags) for line in lines])
    if not ratios:
        return []
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [ratio >= min(mean, THRESHOLD * deviation) for ratio in ratios]


def _within(region: Region, names: frozenset) -> Region | None:
    """The outermost region of one of the names that holds this one."""
    found = None
    while region:
        if region.name in names:
            found = region
        region = region.parent
    return found


def _doubtful(region: Region) -> list[Region]:
    """The regions that hold this one, itself too, and may be apart."""
    found, at = [], region
    while at:
        if at.doubtful:
            found.append(at)
        at = at.parent
    return found


def lines_able(lines: list[Line], content: list[bool]) -> list[int]:
    """The lines that no element sets apart. Elements that only may do so do not if they hold the main text."""
    seen = [i for i, line in enumerate(lines) if not line.region.apart]
    doubts = {i: _doubtful(lines[i].region) for i in seen}
    if not any(doubts.values()):
        return seen
    size = {i: len(lines[i].text) for i in seen if content[i] and 2 * lines[i].linked <= len(lines[i].text)}
    whole: set[int] = set()
    for name in ("main", "article"):
        mass: dict[int, int] = {}
        held: dict[int, Region] = {}
        for i in size:
            if found := _within(lines[i].region, frozenset([name])):
                held[id(found)] = found
                mass[id(found)] = mass.get(id(found), 0) + size[i]
        if mass:
            whole = {id(region) for region in _doubtful(held[max(mass, key=mass.get)])}
            break
    else:
        mass = {}
        for i in size:
            for region in doubts[i]:
                mass[id(region)] = mass.get(id(region), 0) + size[i]
        plain = sum(size[i] for i in size if not doubts[i])
        whole = {key for key, n in mass.items() if 2 * n > sum(size.values()) and n >= REGION_SHARE * (n + plain)}
    return [i for i in seen if all(id(region) in whole for region in doubts[i])]


def main_text(page: str | None) -> str:
    """The main text of a page; null and pages without any are empty."""
    lines = LineReader().read(page or "")
    content = content_lines(lines)
    able = lines_able(lines, content)
    articles = {i: found for i in able if (found := _within(lines[i].region, frozenset(["article"])))}
    if not articles:
        articles = {i: found for i in able if (found := _within(lines[i].region, frozenset(["main"])))}
    if articles:
        chosen = {id(found) for i, found in articles.items() if content[i]}
        linked: dict[int, list[int]] = {}
        for i, found in articles.items():
            sums = linked.setdefault(id(found), [0, 0])
            sums[0] += lines[i].linked
            sums[1] += len(lines[i].text)
        chosen = {key for key in chosen if 2 * linked[key][0] <= linked[key][1]} or chosen or set(linked)
        inner = [i for i, found in articles.items() if id(found) in chosen]
        return " ".join(lines[i].text for i in [i for i in inner if content[i] or 2 * lines[i].linked <= len(lines[i].text)] or inner)

    chosen = [i for i in able if content[i] and 2 * lines[i].linked <= len(lines[i].text)] or [i for i in able if content[i]] or able
    mass: dict[int, int] = {}
    regions: dict[int, Region] = {}
    for i in chosen:
        region = lines[i].region
        while region:
            regions[id(region)] = region
            mass[id(region)] = mass.get(id(region), 0) + len(lines[i].text)
            region = region.parent
    total = sum(len(lines[i].text) for i in chosen)
    large = [key for key, size in mass.items() if size >= REGION_SHARE * total]
    if not large:
        return ""
    inner = max(large, key=lambda key: regions[key].depth)

    def inside(region: Region | None) -> bool:
        while region and id(region) != inner:
            region = region.parent
        return region is not None

    return " ".join(lines[i].text for i in able if inside(lines[i].region))


def extracted(html: Column) -> Column:
    @F.arrow_udf("string")
    def texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    return texts(html)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with the columns text, the main text of html, and n_chars, its code points, which replace any of the same
    names. White space within a block is one space, blocks are joined by one; null and empty pages have an empty text.
    Every row stays, repeated rows included.
    """
    done = pages.withColumn("text", extracted(F.col("html")))
    return done.withColumn("n_chars", F.char_length("text").cast("long"))
