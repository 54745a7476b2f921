"""Main text of web pages: events of the standard-library parser make lines, the lines' text-to-tag
ratio is smoothed with a Gaussian and clustered by a threshold, and the content regions are kept.

Lines are the block-level pieces of a page, as the parser's event stream yields them.  Each line has
its length and the number of tags in it; links weigh by the text they hold.  Chrome is no candidate:
elements that are so by their tag (menus, footers, asides, scripts, ...) and those whose class, id or role says so
(adverts, notices, comments, ...), unless these hold an article, a main element or most of the page's text.

The clusters decide where the content is, elements only complete it, since short lines (a heading, a list, a
one-word paragraph) are content too.  If ``article`` and ``main`` elements hold most of the chosen text, those
that hold a fair share of it are taken whole.  Otherwise the innermost element that holds the chosen text
is, without runs of links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import gathered

SIGMA = 1.0
# Element names by role.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot "
                   "th thead title tr ul".split())
SKIPPED = frozenset("head script style noscript template iframe object svg canvas select button textarea nav header footer aside menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
#: elements that an unclosed tag may leave open: a closing block or a new one ends them
LOOSE = frozenset("p li dt dd tr td th option a b i em strong span u small font".split())
# Words that name chrome in a class or id, those that name what readers write, words that turn the
# meaning (`has-sidebar`, `ad-free`, `page-with-menu`), and words that name the content.
CHROME = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent footer header masthead "
                   "menu modal nav navbar navigation newsletter notice pager pagination popup promo promotion related share sharing sidebar social "
                   "sponsor sponsored subscribe teaser toolbar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
TURNING = frozenset("has no not without with free less is hide hidden show layout page wrapper container body open closed".split())
LANDMARKS = frozenset("article content entry main post story".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
_WORDS = re.compile(r"[a-z]+")
HEADINGS = frozenset(("h1", "h2"))
NONE, SOFT, COMMENT, HARD = range(4)


def role_of(name: str, value: str) -> int:
    """What an attribute says of its element: nothing, chrome unless it holds the content, or readers' comments."""
    if name == "role":
        return SOFT if value.lower() in _ROLES else NONE
    if name == "aria-hidden":
        return SOFT if value == "true" else NONE
    found = NONE
    for token in value.lower().split():
        words = _WORDS.findall(token)
        if not TURNING.intersection(words):
            if COMMENTS.intersection(words):
                return COMMENT
            if CHROME.intersection(words):
                found = SOFT
    return found


class _Lines(HTMLParser):
    """Collects ``(text, length, link text length, tags, element, heading)`` per block line, and the elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        # elements by number, 0 being the page: parent, tag, what it is, whether a class or id names content
        self.parent, self.tag, self.kind, self.landmark = [0], ["html"], [NONE], [False]
        self.open: list[int] = []
        self.hard = 0
        self.in_content = 0
        self.in_link = 0
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                here = self.open[-1] if self.open else 0
                self.lines.append((text, len(text), self.linked, self.tags, here, self.tag[here] in HEADINGS))
            self.parts = []
        self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in VOID:
            return
        kind, landmark = NONE, tag in CONTENT
        for name, value in attrs:
            if name == "hidden":
                kind = HARD
            elif value and name in ("class", "id", "role", "aria-hidden"):
                if tag not in ("html", "body"):
                    kind = max(kind, role_of(name, value))
                landmark = landmark or not LANDMARKS.isdisjoint(value.lower().split())
        # an article's own header holds its title
        if tag in SKIPPED and not (tag == "header" and self.in_content):
            kind = HARD
        elif tag == "form":
            kind = max(kind, SOFT)
        self.parent.append(self.open[-1] if self.open else 0)
        self.tag.append(tag)
        self.kind.append(kind)
        self.landmark.append(landmark and not kind)
        self.open.append(len(self.parent) - 1)
        self.hard += kind == HARD
        self.in_content += tag in CONTENT
        self.in_link += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        # close up to the matching element, but never past an element that is not loose for a loose tag
        for k in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[k]]
            if name == tag:
                for e in self.open[k:]:
                    self.hard -= self.kind[e] == HARD
                    self.in_link -= self.tag[e] == "a"
                    self.in_content -= self.tag[e] in CONTENT
                del self.open[k:]
                return
            if tag in LOOSE and name not in LOOSE:
                return

    def handle_data(self, data: str) -> None:
        if not self.hard:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)

    def finish(self) -> None:
        # a comment that is never closed runs to the end of the page
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        self.close()
        self.end_line()

    def sums(self, own: np.ndarray) -> np.ndarray:
        """``own`` (a value per element) summed over each element and all in it: later elements lie in earlier ones."""
        out = own.astype(float).tolist()
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return np.array(out)

    def within(self, starts: np.ndarray) -> np.ndarray:
        """Which elements are, or lie in, one that ``starts`` marks."""
        out = starts.tolist()
        for e in range(1, len(out)):
            out[e] = out[e] or out[self.parent[e]]
        return np.array(out, bool)


def _per_element(page: _Lines, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    return page.sums(np.bincount(at, weights=values, minlength=len(page.parent)))


def _chrome(page: _Lines, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Elements that are chrome by class, id or role, or lie in one."""
    kind = np.array(page.kind)
    comment = page.within(kind == COMMENT)
    # a content element outside of what readers write, that is no chrome itself
    content = np.array([t in CONTENT for t in page.tag]) & (kind == NONE) & ~comment
    held, total = page.sums(content), _per_element(page, at, size)
    soft = (kind == SOFT) & (held == 0) & (2 * total < total[0])
    return page.within(soft | (kind == COMMENT))


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, normalised at the ends."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]
    return np.convolve(ratios, kernel)[reach:-reach] / weight


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The main text: its lines in page order, joined by one space; empty for NULL, empty or text-free pages."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.finish()
    if not page.lines:
        return ""
    at = np.array([x[4] for x in page.lines])
    size = np.array([x[1] for x in page.lines], float)
    free = ~_chrome(page, at, size)[at]
    if not free.any():
        free[:] = True
    lines = [x for x, f in zip(page.lines, free) if f]
    at, size = at[free], size[free]
    linked = np.array([x[2] for x in lines], float)
    tags = np.array([x[3] for x in lines], float)
    ratio = np.maximum(size - linked, 0) / np.maximum(tags, 1)
    smooth = smoothed(ratio, sigma)
    # threshold clustering: a line belongs to the content cluster from the standard deviation of all ratios on
    chosen = smooth >= min(float(ratio.std()), float(smooth.max()))
    weight = np.where(chosen, np.maximum(size - linked, 1), 0)
    keep = _in_content_elements(page, at, weight)
    if keep is None:
        keep = _in_container(page, at, weight)
        keep &= ~_link_runs(size, linked) | chosen
        # the heading right before the container belongs to it
        k = int(np.argmax(keep)) - 1
        while k >= 0 and lines[k][5]:
            keep[k] = True
            k -= 1
    return " ".join(x[0] for x, k in zip(lines, keep) if k)


def _in_content_elements(page: _Lines, at: np.ndarray, weight: np.ndarray) -> np.ndarray | None:
    """Lines of the outermost article and main elements with a quarter of the chosen text of the one that has most,
    if such elements hold half of all chosen text."""
    marked = np.array([t in CONTENT for t in page.tag])
    inner = page.within(marked)[page.parent]
    inner[0] = False
    outer = marked & ~inner
    held = _per_element(page, at, weight) * outer
    if not held.any() or 2 * held.sum() < weight.sum():
        return None
    return page.within(outer & (4 * held >= held.max()) & (held > 0))[at]


def _in_container(page: _Lines, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lines of the innermost element that holds all chosen text, or nine tenths of it if its name says content."""
    held = _per_element(page, at, weight)
    best = 0
    # an element's number is above its parent's: the last one that qualifies along one path is the innermost
    for e in range(1, len(held)):
        if page.tag[e] in CONTAINERS and 10 * held[e] >= held[0] * (9 if page.landmark[e] else 10):
            best = e
    inside = np.zeros(len(held), bool)
    inside[best] = True
    return page.within(inside)[at]


def _link_runs(size: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Lines of two or more neighbours that are links for three quarters of their text."""
    mostly = 4 * linked >= 3 * size
    return mostly & (np.append(mostly[1:], False) | np.append(False, mostly[:-1]))


def extracted(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """``pages(page_id, url, html, ...)`` -> ``(page_id, url, text, n_chars)``, one row per row.

    A page without text (NULL or empty html, markup only) gives an empty text.  Repeated rows give
    repeated results; NULL ids and urls pass through; other columns, also clashing ones, are not read.  A very
    long page is read whole, in time and memory proportional to its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "html", 8 << 20):
            texts = [main_text(h, sigma) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
