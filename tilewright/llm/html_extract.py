"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events into lines (text blocks between block
tags), each with its text, the tags seen since the last one, its characters in links, and its
container.  The text-to-tag ratios (of text outside links) are smoothed by a Gaussian, and a two-cluster
threshold picks the dense lines.  The content region is found from them: from the whole page inwards, a
container is entered if it holds nearly all dense text of the one around it, and neither a heading nor
more than a tenth of that text is left outside.  If an article or main element holds half of the dense text, the region
is the outermost such element.  All lines of the region are kept, however short, but for

* what markup says is no content: navigation, headers outside articles, footers, asides, forms, hidden
  elements, and elements whose class or id consists of the words of ``NAMES`` (and neutral ones) alone;
* in a region that no article element names, runs of three or more lines that are not dense and
  nearly all links.

Null pages are empty; a page without such text gives an empty text; broken nesting
closes at the next matching end tag; an end tag without a start is passed over.  The parser's state takes constant time
for each event, so long and deep pages take time in proportion.  Rows are independent, repeated
rows give equal results, an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video".split())
ASIDE = frozenset("nav footer aside form button select textarea dialog menu".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that may hold a content region.
REGION = frozenset("html body article main section div td center".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Words of class and id names that mark boilerplate, if no other words stand beside them but neutral ones.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside rail footer foot header masthead topbar toolbar comment comments review reviews disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager skip copyright".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right primary secondary global user users reader readers customer bar box block area section container wrapper wrap inner outer list item items "
    "links link group panel row col column unit slot zone thread form the js ui is has no x post posts article".split()
)
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")
#: A tag that the page's end cuts off.
CUT_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")
SIGMA = 1.0


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: (tag, container, 2 hidden or 1 boilerplate, open paragraphs of the scope around)
        self.stack: list[tuple[str, int, int, int]] = []
        self.open: dict[str, int] = {}
        self.paragraphs = 0  # open p elements since the last region element
        self.parent = [-1]
        self.article = [False]
        self.container = 0
        self.articles = 0  # depth of article elements
        self.skip = 0  # depth of boilerplate
        self.hidden = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0
        self.tags = 0
        #: (text, tags, container, boilerplate, characters in links, heading)
        self.lines: list[tuple[str, int, int, bool, int, bool]] = []

    def _flush(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", "".join(self.parts)).strip()
            self.parts = []
            if text:
                heading = bool(self.stack) and self.stack[-1][0] in HEADING
                self.lines.append((text, max(1, self.tags), self.container, self.skip > 0, min(self.linked, len(text)), heading))
                self.tags = 0
            self.linked = 0

    def _boilerplate(self, tag: str, attrs) -> bool:
        if tag in ASIDE:
            return True
        if tag == "header":
            return not self.articles
        for key, value in attrs:
            value = (value or "").lower()
            if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
            if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
            if key in ("class", "id") and tag not in ("html", "body", "article", "main"):
                for name in value.split():
                    words = set(WORD.findall(name))
                    if words & NAMES and words <= NAMES | NEUTRAL:
                        return True
        return False

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.parts.append(" ")
                if tag == "hr":
                    self._flush()
            return
        if tag in ENDS_P and self.paragraphs:
            self._close("p")
        if tag not in INLINE:
            self._flush()
        self.links += tag == "a"
        hidden = tag in HIDDEN
        aside = not hidden and self._boilerplate(tag, attrs)
        if aside and tag in INLINE:
            self._flush()
        if tag in INLINE and not aside:
            return
        self.stack.append((tag, self.container, 2 if hidden else int(aside), self.paragraphs))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.paragraphs += tag == "p"
        self.hidden += hidden
        self.skip += aside
        if tag in REGION:
            self.paragraphs = 0
            self.parent.append(self.container)
            role = dict(attrs).get("role") or dict(attrs).get("itemprop")
            self.article.append(tag in ("article", "main") or role in ("main", "article", "articleBody"))
            self.container = len(self.parent) - 1
            self.articles += self.article[-1]

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def _close(self, tag: str) -> None:
        """Close the innermost open element of the name and all inside it."""
        if not self.open.get(tag) or tag == "p" and not self.paragraphs:
            return
        self._flush()
        name = None
        while name != tag:
            name, container, kind, self.paragraphs = self.stack.pop()
            self.open[name] -= 1
            self.hidden -= kind == 2
            self.skip -= kind == 1
            if name in REGION:
                self.articles -= self.article[self.container]
                self.container = container

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag not in VOID:
            if tag not in INLINE:
                self._flush()
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends see only the values there are."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]
    return np.convolve(values, kernel)[reach : reach + len(values)] / weight


def threshold(values: np.ndarray) -> float:
    """The border of two clusters in one dimension (two means from the extremes); clusters whose
    means differ by less than a factor of two are one."""
    low, high = float(values.min()), float(values.max())
    for _ in range(50):
        border = (low + high) / 2
        upper = values >= border
        if upper.all() or not upper.any():
            return float(values.min())
        a, b = float(values[~upper].mean()), float(values[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2 if 2 * low < high else float(values.min())


def _totals(parser: _Lines, values: np.ndarray, at: list[int]) -> np.ndarray:
    """The values of the lines in each container and all that it holds."""
    out = np.zeros(len(parser.parent))
    np.add.at(out, at, values)
    for c in range(len(out) - 1, 0, -1):  # containers are numbered in page order
        out[parser.parent[c]] += out[c]
    return out


def content_region(parser: _Lines, lines: list[tuple], dense: np.ndarray) -> tuple[int, bool]:
    """The container of the content, and whether an article element names it."""
    at = [x[2] for x in lines]
    held = _totals(parser, np.array([len(x[0]) for x in lines]) * dense, at)
    headings = _totals(parser, np.array([x[5] for x in lines], float), at)
    for c, named in enumerate(parser.article):
        if named and held[c] >= 0.5 * held[0]:
            return c, True
    fullest: dict[int, int] = {}
    for c in range(1, len(held)):
        inner = fullest.get(parser.parent[c])
        if inner is None or held[c] > held[inner]:
            fullest[parser.parent[c]] = c
    region = 0
    while (inner := fullest.get(region)) is not None and held[inner] >= 0.9 * held[region] > 0 and headings[inner] == headings[region]:
        region = inner
    return region, False


def link_runs(lines: list[tuple], dense: np.ndarray, least: int = 3) -> set[int]:
    """Lines of runs of ``least`` or more that are nearly all links and not dense."""
    out: set[int] = set()
    run: list[int] = []
    for k, x in enumerate([*lines, ("", 1, 0, False, 0, False)]):
        if k < len(lines) and not dense[k] and x[4] >= 0.8 * len(x[0]):
            run.append(k)
            continue
        if len(run) >= least:
            out.update(run)
        run = []
    return out


def main_text(html: str | None) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    parser = _Lines()
    parser.feed(CUT_TAG.sub("", html or ""))
    parser.close()
    parser._flush()
    lines = [x for x in parser.lines if not x[3]]
    if not lines:
        return ""
    free = np.array([len(x[0]) - x[4] for x in lines], float)
    ratio = smooth(free / np.array([x[1] for x in lines]))
    dense = ratio >= threshold(ratio)
    region, named = content_region(parser, lines, dense)
    inside = [c == region for c in range(len(parser.parent))]
    for c in range(region + 1, len(inside)):
        inside[c] = inside[parser.parent[c]]
    gone = set() if named else link_runs(lines, dense)
    return " ".join(x[0] for k, x in enumerate(lines) if inside[x[2]] and k not in gone)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
