"""Main text of HTML pages by text-to-tag ratios.

The standard library's parser streams events. Block elements cut the page into lines; a line keeps its
text (character references decoded, white space turned into single spaces), its number of tags and
where it stands. Lines inside page furniture (navigation, headers, footers, sidebars, forms, scripts,
styles, and elements whose class, id or role says advert, menu, notice, comments and the like) never
count. A form or a class or id is no sure sign, as both stand on wrappers of whole pages: such an
element is no furniture if it holds most of the page's text outside links, unless an article stands
apart from it, or the page's largest article or main element, if no larger text stands outside.
Text-to-tag ratios of the other lines are smoothed by a Gaussian kernel and clustered by a
threshold into content and rest; lines of links are rest. Content lines are the seeds of regions. In an
article or main element a region reaches over the whole element, short lines too, except lists of links
whose mean ratio is rest; an article without a seed is none. Elsewhere a region has the seeds, single lines
between them and the headings right before.

A null or empty page, or one without any text, has empty text. Unclosed tags are taken as the parser
meets them: an end tag closes what was left open inside; what can't stand in a head closes it. Pages that repeat are extracted alike; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

SIGMA = 1.5
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset(
    "head nav aside footer script style noscript template svg canvas iframe object button select textarea dialog menu audio video map datalist".split()
)
IN_HEAD = frozenset("head title base basefont bgsound link meta noframes noscript script style template".split())
BODIES = ("article", "main")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may stand open without an end tag; they never hold furniture open.
LOOSE = frozenset("p b i u em strong a span font small big li dd dt tr td th option br sub sup code".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist"
    " consent cookie cookies copyright disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice notices"
    " pagination pager popup promo promotion related share sharing sidebar skip social sponsor sponsored subscribe subscription"
    " teaser toolbar topbar widget widgets".split()
)
_WORD = re.compile(r"[a-z]+")
_LONG_REFERENCE = re.compile(r"&#([xX][0-9a-fA-F]{8,}|[0-9]{8,})")


def _short_reference(match: re.Match) -> str:
    """A character reference of many digits: its zeros go, and one beyond all characters is none (U+FFFD)."""
    digits = match[1].lstrip("xX0") or "0"
    return f"&#{'x' if match[1][0] in 'xX' else ''}{digits}" if len(digits) < 8 else "&#xFFFD"


class LineParser(HTMLParser):
    """Lines of a page: (text, tags, heading, mostly links, the outermost article or main it stands in or -1).
    Elements that matter later are numbered as they open, so an element's parent has a lower number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.cuts: list[tuple[list[tuple[str, bool, int]], int, bool, int]] = []  # lines' parts, as read
        self.parts: list[tuple[str, bool, int]] = []  # text, whether in a link, what it stands in
        self.tags = 0
        self.heading = False
        self.link = False
        #: Elements that end tags may close, whether each is furniture, and its number or -1.
        self.open: list[tuple[str, bool, int]] = []
        self.opened: Counter = Counter()  # how many of a name are open
        self.shut = 0  # open elements that are furniture
        self.inside = 0  # open article and main elements
        self.within = -1  # the innermost open element with a number
        self.top = -1  # the outermost open article or main element
        self.parents: list[int] = []  # by number: what an element stands in, or -1
        self.doubtful: list[int] = []  # elements that may be furniture, outer ones first
        self.bodies: dict[str, list[int]] = {t: [] for t in BODIES}

    def cut(self) -> None:
        self.cuts.append((self.parts, self.tags, self.heading, self.top))
        self.parts = []
        self.tags = 0
        self.heading = False

    def furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool]:
        """Whether an element is furniture, and whether it may be."""
        if tag in FURNITURE or tag == "header" and not self.inside:
            return True, False
        doubtful = tag == "form"
        for name, value in attrs:
            if name == "hidden" and tag not in ("body", "html", *BODIES):  # whatever its value
                return True, False
            if not value or tag in ("body", "html", *BODIES) and "comment" not in value:
                continue
            if name in ("class", "id"):
                doubtful |= not MARKS.isdisjoint(_WORD.findall(value.lower()))
            elif name == "role" and value.lower() == "form":
                doubtful = True
            elif name == "role" and value.lower() in ROLES:
                return True, False
            elif name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, False
        return False, doubtful

    def pop(self, tag: str) -> None:
        """Close the innermost element of this name and what is open inside."""
        while self.open:
            last, mark, number = self.open.pop()
            self.opened[last] -= 1
            self.shut -= mark
            self.inside -= last in BODIES
            if number >= 0:
                self.within = self.parents[number]
                if number == self.top:
                    self.top = -1
            if last == tag:
                break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "body" and self.opened["head"] or tag not in IN_HEAD and self.open and self.open[-1][0] == "head":
            self.pop("head")
        if tag in BLOCKS:
            self.cut()
            self.heading = tag in HEADINGS
        elif tag in VOID:
            self.parts.append((" ", False, -1))
        if tag in VOID:
            return
        self.link |= tag == "a"
        mark, doubtful = self.furniture(tag, attrs)
        if tag in LOOSE and not mark and not doubtful:
            return
        number = -1
        if doubtful or tag in BODIES and not mark:
            number = len(self.parents)
            self.parents.append(self.within)
            self.within = number
            (self.doubtful if doubtful else self.bodies[tag]).append(number)
            if tag in BODIES and self.top < 0:
                self.top = number
        self.open.append((tag, mark, number))
        self.opened[tag] += 1
        self.shut += mark
        self.inside += tag in BODIES

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        self.link &= tag != "a"
        if tag in BLOCKS:
            self.cut()
        if self.opened[tag]:
            self.pop(tag)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.pop("head")
        if not self.shut:
            self.parts.append((data, self.link, self.within))

    # What the library's patterns can't close is never text: a tag ends at the next >, other markup at the page's end.

    def _closed(self, end: int) -> int:
        return end if end >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        if end < 0:
            self.tags += 1
            end = self.rawdata.find(">", i) + 1 or -1
        return self._closed(end)

    def parse_endtag(self, i: int) -> int:
        return self._closed(super().parse_endtag(i))

    def parse_pi(self, i: int) -> int:
        return self._closed(super().parse_pi(i))

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = self.rawdata.find("-->", i + 2)
        return self._closed(end + 3 if end >= 0 else end)

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        return self._closed(self.parse_bogus_comment(i))

    def marked(self, numbers: set[int]) -> list[bool]:
        """By number: whether an element is one of these or stands in one."""
        found: list[bool] = []
        for number, parent in enumerate(self.parents):
            found.append(number in numbers or parent >= 0 and found[parent])
        return found

    def above(self, number: int) -> list[int]:
        """What an element stands in."""
        found = []
        while (number := self.parents[number]) >= 0:
            found.append(number)
        return found

    def dropped(self) -> list[bool]:
        """By number: whether an element is furniture, or stands in one that is."""
        own, total = [0] * len(self.parents), 0  # characters outside links
        for parts, *_ in self.cuts:
            for data, link, within in parts:
                size = 0 if link else len(data.strip())
                total += size
                if within >= 0:
                    own[within] += size
        holds = own.copy()
        for number in reversed(range(len(holds))):
            if self.parents[number] >= 0:
                holds[self.parents[number]] += holds[number]
        largest = [max(found, key=lambda n: holds[n]) for found in self.bodies.values() if any(holds[n] for n in found)]
        drop = set(self.doubtful)
        path = set(self.above(largest[0])) if largest else set()
        inner = self.marked({largest[0]}) if largest else []
        closed = len(path & drop)
        for number in self.doubtful:
            apart = largest and not closed and not inner[number]
            if 2 * holds[number] > total and not apart:
                drop.remove(number)
                closed -= number in path
        gone = self.marked(drop)
        outside = total - sum(n for n, lost in zip(own, gone) if lost)
        for body in largest:
            if holds[body] >= outside:
                drop.difference_update(self.above(body))
        return self.marked(drop)

    def lines(self) -> list[tuple[str, int, bool, bool, int]]:
        gone, out, tags = self.dropped(), [], 0
        for parts, more, heading, top in self.cuts:
            tags += more
            kept = [(data, link) for data, link, within in parts if within < 0 or not gone[within]]
            if text := " ".join("".join(data for data, _ in kept).split()):
                linked = sum(len(data.strip()) for data, link in kept if link)
                out.append((text, tags, heading, 2 * linked > len(text), top))
                tags = 0
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def threshold(values: np.ndarray) -> float:
    """The middle between the means of two clusters of the values' logarithms."""
    logs = np.log1p(values)
    cut = (logs.min() + logs.max()) / 2
    for _ in range(20):
        low, high = logs[logs < cut], logs[logs >= cut]
        if not len(low) or high.mean() - low.mean() < 0.7:  # one cluster: less than twice apart
            return 0.0
        new = (low.mean() + high.mean()) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return float(np.expm1(cut))


def regions(lines: list[tuple[str, int, bool, bool, int]]) -> list[bool]:
    """Which lines are content. Seeds are lines over the ratios' threshold that aren't mostly links. A seed in
    an article makes the article's lines a region, but for lists of links in it whose mean is under the
    threshold; without seeds in articles, the lines by the seeds are tried one by one."""
    raw = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    ratios = smoothed(raw)
    least = threshold(ratios)
    links = [mostly for *_, mostly, _ in lines]
    tops = np.array([top for *_, top in lines])
    seeds = (ratios >= least) & ~np.array(links)
    chosen = set(tops[seeds].tolist()) - {-1}
    if chosen:
        keep = np.isin(tops, list(chosen))
        for (linked, _), run in groupby(range(len(lines)), key=lambda i: (links[i], tops[i])):
            if linked and len(run := list(run)) > 1 and raw[run].mean() < least:
                keep[run] = False
        return keep.tolist()
    keep = seeds.copy()
    keep[1:-1] |= seeds[:-2] & seeds[2:]
    for i in range(len(lines) - 2, -1, -1):
        keep[i] |= lines[i][2] and keep[i + 1]
    return keep.tolist()


def main_text(html: str) -> str:
    parser = LineParser()
    parser.feed(_LONG_REFERENCE.sub(_short_reference, html))
    parser.close()
    parser.cut()
    lines = parser.lines()
    return "\n".join(line[0] for line, kept in zip(lines, regions(lines)) if kept) if lines else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) if h else "" for h in common.each(batch.column("html"))]
            sizes = pa.array([len(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
