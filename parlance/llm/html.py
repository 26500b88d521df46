"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

A page is streamed through the standard library's parser, which yields lines (blocks) with the number of tags seen in
each. Elements that never hold an article's text (menus, page headers and footers, asides, forms, scripts, styles) give
none. The ratios of the lines are smoothed and parted into two clusters by a threshold; what a page says of itself is evidence
that the clusters weigh:

* A class, id or role that names a sidebar, notice, advert and the like marks its lines as such, unless they hold most of
  the text and lie in the upper cluster: then it names the layout around the article. Reader comments go, unless they hold
  the only article. `has-sidebar` and its kind say nothing.
* Of several articles, those with a line in the upper cluster are content. Without any, the smallest container around the
  lines of the upper cluster is; outside the first and last of these, its lines made of links only are menus.
* Three or more lines of links in a row that lie in the lower cluster are a menu, also inside an article.

All other lines of what is content are kept, so a short paragraph is not lost. Time is linear in the length of a page, however
deep its elements nest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
DROPPED = frozenset("head title script style noscript template nav footer aside form button select textarea option iframe object svg canvas video audio map menu dialog search".split())
CONTAINER = frozenset("body div section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HINT = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|side-bar|nav|navbar|navigation|menus?|breadcrumbs?|footers?|headers?|masthead|topbar|comments?|commentlist|replies|disqus|respond|share|sharing|social|related|recommended|newsletters?|subscribe|subscription|signup|login|popups?|modals?|overlay|widgets?|pagination|pager|skip-link|toolbar|teasers?|copyright)(?=$|[\s_-])", re.I)
#: Hints of reader comments, and words before a hint that make it a trait of the layout.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|replies|disqus|respond)(?=$|[\s_-])", re.I)
TRAIT = re.compile(r"(?:^|\s)(?:has|have|with|without|no|show|hide)[_-]\S*", re.I)
#: An end tag closes open elements up to its own, but not past one of these.
BARRIER = frozenset("article main table body html".split())
MENU_LINES = 3


@dataclass(slots=True)
class Line:
    """A block's text, the tags seen since the one before, its article (0: none), its container, the innermost hinted element
    around it (0: none), whether all its text is links, and whether these are several."""

    text: str
    tags: int
    region: int
    node: int
    hint: int
    linked: bool
    several: bool


class Lines(HTMLParser):
    """Collects the lines of a page, the parent of each container, and the hinted elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements, each with what held before it: dropped, region, container, hint, and how text inside counts.
        self.open: list[tuple[str, bool, int, int, int, str]] = []
        self.count: Counter[str] = Counter()
        self.dropped = 0
        self.region, self.regions = 0, 0
        self.parts: list[str] = []
        self.tags = 0
        self.lines: list[Line] = []
        self.node, self.parents = 0, [0]  # the open container, and the parent of each; 0 is the page
        #: For each hint the one around it, whether it is of comments, and whether an article begins inside.
        self.hint, self.hints = 0, [[0, False, False]]
        self.inside = ""  # the innermost of a heading, an article's header, or a link below these
        self.links, self.plain = 0, False

    def cut(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.region, self.node, self.hint, self.links > 0 and not self.plain, self.links > 1))
                self.tags = 0
            self.parts = []
            self.links, self.plain = 0, False

    def pop(self) -> None:
        name, drop, self.region, self.node, self.hint, self.inside = self.open.pop()
        self.count[name] -= 1
        self.dropped -= drop

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCK or "-" in tag:
            self.cut()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if (tag == "p" or tag in HEADINGS) and self.count["p"] or tag == "li" and (self.count["p"] or self.count["li"]):
            for i in range(len(self.open) - 1, -1, -1):
                name = self.open[i][0]
                if name == "p" or name == tag == "li":
                    while len(self.open) > i:
                        self.pop()
                    break
                if name in BLOCK:
                    break
        if tag in ("article", "main"):
            while any(self.count[name] for name in ("nav", "header", "head", "title")):
                self.pop()
        found = {k: v or "" for k, v in attrs}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        within = self.region > 0
        drop = tag in DROPPED or (tag == "header" and not within) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        hint = False
        if not drop and names != " " and tag not in ("html", "body", "main") and tag not in HEADINGS and not (tag == "header" and within):
            named = TRAIT.sub(" ", names)
            hint = bool(HINT.search(named))
            if tag == "article":
                drop, hint = hint and bool(re.search(r"comment|reply|sponsor|advert|related|teaser", named, re.I)), False
            elif tag not in BLOCK and "-" not in tag:
                drop, hint = hint, False  # part of a line
        self.open.append((tag, drop, self.region, self.node, self.hint, self.inside))
        self.count[tag] += 1
        if tag in CONTAINER:
            self.parents.append(self.node)
            self.node = len(self.parents) - 1
        if hint:
            self.hints.append([self.hint, bool(COMMENTS.search(named)), False])
            self.hint = len(self.hints) - 1
        if tag in HEADINGS:
            self.inside = "heading"
        elif tag in ("header", "hgroup"):
            self.inside = "header"
        elif tag == "a" and self.inside != "header":
            self.inside = "heading link" if "heading" in self.inside else "link"
        self.dropped += drop
        if not self.dropped and (tag in ("article", "main") or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"):
            if not self.region or tag == "article":
                self.regions += 1
                self.region = self.regions
                around = self.hint
                while around and not self.hints[around][2]:
                    self.hints[around][2] = True
                    around = self.hints[around][0]

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK or "-" in tag:
            self.cut()
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if name in BARRIER and tag not in BARRIER:
                return

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """As in the standard parser, but one that it gives up on is a comment up to the next `>`."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def handle_data(self, data: str) -> None:
        if self.dropped or self.inside == "header":  # of an article's own header only the headings are text
            return
        self.parts.append(data)
        if data.strip():
            linked = "link" in self.inside
            self.links += linked
            self.plain |= "heading" in self.inside or not linked and any(c.isalnum() for c in data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Convolution with a Gaussian of that width, normalised at the ends."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = slice(reach, reach + len(values))
    return np.convolve(values, kernel)[full] / np.convolve(np.ones(len(values)), kernel)[full]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """The middle between two cluster means, found by iterated division (one cluster: its least value)."""
    at = float(values.mean())
    for _ in range(rounds):
        high, low = values[values > at], values[values <= at]
        if not len(high) or not len(low):
            return float(values.min())
        new = (high.mean() + low.mean()) / 2
        if abs(new - at) < 1e-9:
            break
        at = float(new)
    return at


def ratios(lines: list[Line], sigma: float) -> np.ndarray:
    """The smoothed text-to-tag ratio of each line."""
    return smooth(np.array([len(line.text) / max(1, line.tags) for line in lines], float), sigma)


def unhinted(lines: list[Line], hints: list[list], sigma: float) -> list[Line]:
    """The lines that no hint drops: first those of comments are weighed, then the others against what is left."""
    for comments in (True, False):
        if not lines or not any(h[1] == comments for h in hints[1:]):
            continue
        counted = [line.region > 0 for line in lines] if any(line.region for line in lines) else [True] * len(lines)
        ratio = ratios(lines, sigma)
        least = threshold(ratio)
        size, total, n = ([0.0] * len(hints) for _ in range(3))
        for line, on, r in zip(lines, counted, ratio.tolist(), strict=True):
            size[line.hint] += len(line.text) * on
            total[line.hint] += r
            n[line.hint] += 1
        for h in range(len(hints) - 1, 0, -1):  # outer hints come first
            for sums in (size, total, n):
                sums[hints[h][0]] += sums[h]
        gone = [False] * len(hints)
        for h in range(1, len(hints)):
            around, of_comments, article = hints[h]
            most = 2 * size[h] > size[0]
            layout = most and (article if of_comments else total[h] >= least * n[h])
            gone[h] = gone[around] or of_comments == comments and not layout
        lines = [line for line in lines if not gone[line.hint]]
    return lines


def menus(lines: list[Line], ratio: np.ndarray, least: float) -> set[int]:
    """Lines in runs of MENU_LINES or more that are links only and lie in the lower cluster."""
    out: set[int] = set()
    run: list[int] = []
    for i, line in enumerate([*lines, None]):
        if line and line.linked and ratio[i] < least:
            run.append(i)
        else:
            if len(run) >= MENU_LINES:
                out.update(run)
            run = []
    return out


def main_text(page: str, sigma: float = 1.0) -> str:
    """Main text of a page: its blocks joined by two line ends; empty if it has none."""
    parser = Lines()
    parser.feed(page)
    parser.close()
    parser.cut()
    lines = unhinted(parser.lines, parser.hints, sigma)
    if not lines:
        return ""
    ratio = ratios(lines, sigma)
    least = threshold(ratio)
    menu = menus(lines, ratio, least)
    best: dict[int, float] = {}
    for r, line in zip(ratio.tolist(), lines, strict=True):
        best[line.region] = max(best.get(line.region, 0.0), r)
    named = {region: r for region, r in best.items() if region}
    if named:
        content = {region for region, r in named.items() if r >= least} or {max(named, key=named.get)}
        return "\n\n".join(line.text for i, line in enumerate(lines) if line.region in content and i not in menu)
    at = np.flatnonzero(ratio >= least)
    nodes, parents = [line.node for line in lines], parser.parents
    above, held = (np.bincount(x, minlength=len(parents)).tolist() for x in (np.array(nodes)[at], nodes))
    for node in range(len(parents) - 1, 0, -1):  # parents come first
        above[parents[node]] += above[node]
        held[parents[node]] += held[node]
    shared = max(node for node, n in enumerate(above) if n == len(at))
    while held[shared] == 1 and shared:  # a wrapper of one line is no container
        shared = parents[shared]
    within_shared = [shared == 0]
    for node in range(1, len(parents)):
        within_shared.append(node == shared or within_shared[parents[node]])
    inside = [i for i, node in enumerate(nodes) if within_shared[node] and i not in menu]
    return "\n\n".join(lines[i].text for i in inside if at[0] <= i <= at[-1] or not (lines[i].linked and lines[i].several))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """Main text of every page from its whole html: page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text; null ids and urls stay null; repeated rows stay; an empty table gives no
    rows. Other columns are not read.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = source.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text((h or b"").decode("utf-8", "replace"), sigma) for h in utf8(batch.column("html"))]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return source.mapInArrow(run, schema)
