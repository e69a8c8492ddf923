"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's streaming parser sends start tags, end tags and data.  Block elements cut the page into
lines; each line counts its characters and its tags.  The text-to-tag ratio is smoothed over neighbouring lines
by a Gaussian, and two-means on its logarithm gives the threshold between content and the rest.

The regions to choose from are the page's article and main elements and, elsewhere, the lines of one container.  A
region is content if one of its smoothed lines reaches the threshold; lines of an article weigh WEIGHT times as much, and
where an article is content, loose containers are not.  A chosen region is kept whole, so headings and one-word
paragraphs stay.

Lines inside elements that are never content (navigation, forms, scripts ...) only take part in the smoothing.  Words of
class, id and role (sidebar, comments ...) make an element suspect.  Its lines are left out too, unless it can't be what
the word says: it holds an article, and none stands outside such elements, or it holds most of the page's text, and
hardly any is outside.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_batches

# Element names and the words of class, id and role that mark what is not content.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre "
    "section summary table tbody tfoot thead tr ul".split()
)
SPACES = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head header iframe input label menu nav "
    "noscript object script select style svg template textarea title video".split()
)
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent "
    "contentinfo cookie cookies complementary dialog discussion disqus footer form gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion "
    "recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe "
    "toolbar widget widgets".split()
)
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements whose lines form a region of their own outside articles.
CONTAINERS = frozenset("article body center div main section".split())
#: Elements whose end tag is often left out; they never hold back an outer end tag.
LOOSE = frozenset("p li dd dt option tr td th tbody thead tfoot".split())
#: What the ratio of a line in an article or main element is multiplied by.
WEIGHT = 4.0

_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


class Place(NamedTuple):
    """Where a line stands: in an excluded element, in which article and region (0: none), in which suspect elements."""

    noise: bool = False
    article: int = 0
    region: int = 0
    suspects: tuple[int, ...] = ()


class Line(NamedTuple):
    text: str
    tags: int
    place: Place


class Lines(HTMLParser):
    """Collects a page's lines, and the suspect elements that hold an article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, Place]] = []
        self.held: list[tuple[int, list[str], int]] = []  # lines that an excluded inline element interrupts
        self.parts: list[str] = []
        self.tags, self.count = 0, 0
        self.holders: set[int] = set()

    def here(self) -> Place:
        return self.open[-1][1] if self.open else Place()

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text or self.tags:
            self.lines.append(Line(text, self.tags, self.here()))
        self.parts, self.tags = [], 0

    @staticmethod
    def hidden(attrs: list) -> bool:
        return any(
            name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
            for name, value in attrs
        )

    @staticmethod
    def suspect(attrs: list) -> bool:
        return any(name in ("class", "id", "role") and value and not NOISE_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(value)) for name, value in attrs)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SPACES:
            self.parts.append(" ")
        if tag == "body" or (tag in BLOCKS and tag != "noscript"):
            while any(n == "head" for n, _ in self.open):
                self.cut()
                self.open.pop()
        plain = tag in CONTENT_TAGS or tag in ("html", "body")
        noise = tag in NOISE_TAGS or (not plain and self.hidden(attrs))
        suspect = not plain and not noise and self.suspect(attrs)
        if tag in BLOCKS:
            self.cut()
        elif (noise or suspect) and self.parts and not self.here().noise:
            self.held.append((len(self.open), self.parts, self.tags))
            self.parts, self.tags = [], 0
        self.tags += 1
        if tag in VOID:
            return
        if tag in LOOSE and self.open and self.open[-1][0] == tag:
            self.cut()
            self.open.pop()
        place = self.here()
        if tag in CONTAINERS or noise or suspect:
            self.count += 1
        if tag in CONTENT_TAGS and not place.article and not place.noise:
            place = place._replace(article=self.count)
            self.holders.update(place.suspects)
        if tag in CONTAINERS and not place.article:
            place = place._replace(region=self.count)
        if suspect:
            place = place._replace(suspects=(*place.suspects, self.count))
        if tag in BLOCKS or noise or suspect:
            self.open.append((tag, place._replace(noise=place.noise or noise)))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        elif tag in SPACES:
            self.parts.append(" ")
        self.tags += 1
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][0]
            if name == tag:
                if tag not in BLOCKS:
                    self.cut()
                del self.open[k:]
                self.resume()
                return
            if tag in LOOSE and name not in LOOSE:
                return

    def resume(self) -> None:
        """Go on with the lines that closed elements interrupted."""
        while self.held and self.held[-1][0] >= len(self.open):
            depth, parts, tags = self.held.pop()
            if depth == len(self.open):
                self.parts, self.tags = [*parts, *self.parts], self.tags + tags
            elif text := _SPACE.sub(" ", "".join(parts)).strip():
                self.lines.append(Line(text, tags, self.here()))

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    def finish(self) -> list[Line]:
        self.close()
        self.cut()
        for depth, parts, tags in self.held:
            if text := _SPACE.sub(" ", "".join(parts)).strip():
                self.lines.append(Line(text, tags, self.open[depth - 1][1] if depth else Place()))
        return self.lines

    def excluded(self) -> list[bool]:
        """Of each line whether it is never content."""
        real = [(len(text), place) for text, _, place in self.lines if not place.noise]
        chars = Counter()
        for n, place in real:
            chars.update(dict.fromkeys(place.suspects, n))
        total = sum(n for n, _ in real)
        cleared: set[int] = set()
        if not any(n and place.article and not place.suspects for n, place in real):
            cleared = self.holders & chars.keys()
        wide = sorted((x for x, n in chars.items() if 2 * n > total), key=lambda x: (-chars[x], x))
        for x in wide:  # from the outside in, until a tenth of the text is left
            if 10 * sum(n for n, place in real if cleared.issuperset(place.suspects)) >= total:
                break
            cleared.add(x)
        return [place.noise or not cleared.issuperset(place.suspects) for _, _, place in self.lines]


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average over neighbouring lines, normalised at the ends."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Border between the two means of the logarithms of ``values``; the smallest value if all are alike."""
    x = np.log1p(values)
    low, high = x.min(), x.max()
    if high - low < 1e-9:
        return float(values.min())
    for _ in range(50):
        cut = (low + high) / 2
        new = x[x <= cut].mean(), x[x > cut].mean()
        if abs(new[0] - low) + abs(new[1] - high) < 1e-9:
            break
        low, high = new
    return float(np.expm1((low + high) / 2))


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article's blocks in page order, joined by newlines; '' for null, empty or without content."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = parser.finish()
    out = parser.excluded()
    regions: dict[tuple[int, int], list[int]] = {}
    for i, (text, _, place) in enumerate(lines):
        if text and not out[i]:
            regions.setdefault((place.article, 0 if place.article else place.region), []).append(i)
    if not regions:
        return ""
    ratios = [len(text) / max(1, tags) * (WEIGHT if place.article and not skip else 1) for (text, tags, place), skip in zip(lines, out, strict=True)]
    near = smoothed(np.array(ratios), sigma)
    floor = threshold(near)
    chosen = {k: v for k, v in regions.items() if near[v].max() >= floor} or regions
    if any(article for article, _ in chosen):
        chosen = {k: v for k, v in chosen.items() if k[0]}
    return "\n".join(lines[i].text for i in sorted(i for v in chosen.values() for i in v))


def extract(pages: DataFrame, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0) -> DataFrame:
    """Main text of every page: rows ``*keep, text, n_chars``.  One pass, no shuffle; each page is read whole.

    A null or empty page, or one without content, gives ''.  Null keys and repeated rows are answered row by
    row; other columns are not read.  Malformed markup never fails: what the parser can't read is skipped.
    """
    cols = pages.select(html_col, *keep)
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in cols.schema.fields[1:])

    def run(batch: pa.RecordBatch) -> dict:
        texts = [main_text(h, sigma) for h in batch.column(0).to_pylist()]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())} | {n: batch.column(i + 1) for i, n in enumerate(keep)}

    return map_batches(cols, run, f"{kept}text string, n_chars bigint")
