"""Main text of web pages by text-to-tag ratio (after Weninger, Hsu and Han, 2010).

A streaming parser of the standard library turns a page into lines, one for each block element. A
line's ratio is its characters over its tags; the logarithms of the ratios are smoothed with a
Gaussian, and the lines at or above their mean, within bounds, are the content cluster. An element whose text lies
for a good part in such lines is content with its short lines too; of any other only the clustered
lines and what stands between them. Page furniture by element, role or name is left out; a name
alone does not make furniture of what holds an article or most of the clustered text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import map_batches

# Elements and names by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form script style noscript template iframe object svg select button textarea head title dialog menu canvas audio video map datalist search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices "
    "alert sidebar sidebars side menu menus nav navbar navigation navigations breadcrumb breadcrumbs topbar header masthead footer footers foot comment comments commentlist "
    "disqus replies reply respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay "
    "widget widgets toolbar pagination pager paywall login search skip".split()
)
#: Elements that a name such as has-sidebar does not make furniture of; an article may still be a comment.
WHOLE = frozenset("html body main".split())
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Names that content has too.
WEAK = frozenset("promo promotion social share sharing related recommended side alert header notice notices discussion widget widgets login search skip".split())
#: Words that turn a name into one of another thing: in such a compound the name says what is with, about or
#: around the content. It counts as a weak one, and within an article not at all if it is of the first kind.
TURNS = frozenset("has have with without no not non of on for about under".split())
LAYOUT = frozenset("content page layout main body article entry text story".split())
#: A start of one of these ends an open paragraph.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend", "summary", "html", "body"}
ENDS_P = frozenset("td th button object article section div main aside footer body".split())
ALIKE = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table select".split())
REGIONS = frozenset("article main section div td body blockquote".split())
ARTICLES = frozenset("article main".split())
_NAME = re.compile("[A-Z]?[a-z]+|[A-Z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Spread of the Gaussian in lines.
SIGMA = 1.0
#: Characters a tag below which no line is clustered, and from which every line is, whatever the page's mean.
BOUNDS = (8.0, 20.0)
#: An element is content as a whole if this share of its text lies in clustered lines.
SHARE = 0.25


class Lines(HTMLParser):
    """Events to lines ``(text, tags, furniture, named, region, element)``.

    ``furniture`` tells that the line lies in page furniture by element, role or state; ``named`` is
    the outermost element that is furniture by its name only, ``region`` the innermost open element
    that can hold content, both as numbers with 0 for none. :attr:`up` leads from a region to the
    one around it, so a line costs the same at any depth.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, str]] = []
        # Open elements: (element, furniture, named, region, innermost block, whether in an article or main).
        self.stack: list[tuple[str, bool, int, int, str, bool]] = []
        self.open = Counter()
        self.up: list[int] = [0]
        self.kind: list[str] = [""]
        # For each named element whether it holds an article, None for comments, and whether its name is a weak one.
        self.holds_article: list[bool | None] = [False]
        self.weak: list[bool] = [False]
        self.plain_article = False
        self.parts: list[str] = []
        self.tags = 0

    def top(self) -> tuple[str, bool, int, int, str, bool]:
        return self.stack[-1] if self.stack else ("", False, 0, 0, "", False)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, hidden, named, region, block, _ = self.top()
            self.lines.append((text, max(1, self.tags), hidden, named, region, block))
            self.tags = 0
        self.parts = []

    def pop(self, depth: int) -> None:
        """Close all elements from this depth on."""
        below = self.stack[depth - 1] if depth else ("", False, 0, 0, "", False)
        if any(e[0] in BLOCKS for e in self.stack[depth:]) or self.top()[1:3] != below[1:3]:
            self.flush()
        self.open.subtract(e[0] for e in self.stack[depth:])
        del self.stack[depth:]

    def close_open(self, tags: tuple[str, ...], within: frozenset) -> None:
        if not any(self.open[t] > 0 for t in tags):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            if self.stack[depth][0] in tags:
                self.pop(depth)
                return
            if self.stack[depth][0] in within:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in CLOSES_P:
            self.close_open(("p",), ENDS_P)
        if tag in ALIKE:
            self.close_open(ALIKE[tag], LISTS | {"tr"} if tag in ("td", "th") else LISTS)
        if tag in BLOCKS:
            self.flush()
        if tag in VOID:
            return
        _, was_hidden, was_named, region, block, inside = self.top()
        given = dict(attrs)
        hidden = was_hidden or self.furniture(tag, given, inside)
        named = was_named
        if not hidden and not named and self.named(tag, given, inside):
            clear = self.words(given, inside)[0] & NAMES
            self.holds_article.append(None if clear & COMMENTS else False)
            self.weak.append(clear <= WEAK)
            named = len(self.weak) - 1
        if (hidden, named) != (was_hidden, was_named):
            self.flush()
        if tag in ARTICLES and not hidden and not named:
            self.plain_article = True
        if named and tag in ("article", "main", "h1") and self.holds_article[named] is False:
            self.holds_article[named] = True
        if tag in REGIONS and not hidden:
            self.up.append(region)
            self.kind.append(tag)
            region = len(self.up) - 1
        self.open[tag] += 1
        self.stack.append((tag, hidden, named, region, tag if tag in BLOCKS else block, inside or tag in ARTICLES))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.open[tag] > 0:
            for depth in range(len(self.stack) - 1, -1, -1):
                if self.stack[depth][0] == tag:
                    self.pop(depth)
                    return
        if tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.parts.append(data)

    @staticmethod
    def furniture(tag: str, attrs: dict, inside: bool) -> bool:
        if tag in FURNITURE:
            return True
        if tag == "header":
            return not inside
        if tag in WHOLE:
            return False
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
            return True
        return (attrs.get("role") or "").lower() in ROLES

    @staticmethod
    def words(attrs: dict, inside: bool) -> tuple[set[str], set[str]]:
        """The words of classes and id: those of plain names, and those of compounds that may mean something else."""
        clear, turned = set(), set()
        for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
            words = {w.lower() for w in _NAME.findall(name)}
            if not words & (TURNS | LAYOUT):
                clear |= words
            elif not (inside and words & TURNS):
                turned |= words
        return clear, turned

    def named(self, tag: str, attrs: dict, inside: bool) -> bool:
        if tag in WHOLE or tag == "header":
            return False
        return bool(set.union(*self.words(attrs, inside)) & (COMMENTS if tag == "article" else NAMES - {"header", "side", "alert", "search"} if inside else NAMES))


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian filter over the lines, with the ends repeated."""
    reach = max(1, round(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), weight / weight.sum(), mode="valid")


def clustered(ratio: np.ndarray) -> np.ndarray:
    """Which lines have a smoothed logarithm of their ratio at or above the mean of all lines of the page, within the :data:`BOUNDS`."""
    level = smoothed(np.log1p(ratio))
    return level >= np.clip(level.mean(), *np.log1p(BOUNDS)) - 1e-12


def chosen(lines: list[tuple[int, str, bool, int]], up: list[int], kind: list[str]) -> list[bool]:
    """Which visible lines ``(region, element, clustered, characters)`` are content."""
    if not any(high for _, _, high, _ in lines):
        return [True] * len(lines)
    # Text and clustered text of each region alone, and with all that lies in it: inner regions have larger numbers.
    own = {r: [0, 0] for r in range(len(up))}
    for region, _, high, n in lines:
        own[region][0] += n
        own[region][1] += n * high
    whole = {r: list(x) for r, x in own.items()}
    for r in range(len(up) - 1, 0, -1):
        whole[up[r]][0] += whole[r][0]
        whole[up[r]][1] += whole[r][1]
    rich = lambda x: x[1] > 0 and x[1] >= SHARE * x[0]
    # An article or main is content as a whole, with all regions in it; any other element by its own lines.
    article = [False] * len(up)
    for r in range(1, len(up)):
        article[r] = article[up[r]] or kind[r] in ARTICLES and rich(whole[r])
    keep = [high or article[region] or rich(own[region]) for region, _, high, _ in lines]
    some = [i for i, kept in enumerate(keep) if kept]
    a, b = some[0], some[-1] + 1
    # Short text between content, headings before it, closing paragraphs after it and short articles about it, unless it outweighs the content.
    weight = sum(n for (_, _, _, n), kept in zip(lines, keep, strict=True) if kept)
    between = [i for i in range(a, b) if not keep[i]]
    in_article = [False] * len(up)
    for r in range(1, len(up)):
        in_article[r] = in_article[up[r]] or kind[r] in ARTICLES
    before, after = [], []
    while a and (lines[a - 1][1] in HEADINGS or in_article[lines[a - 1][0]]):
        a -= 1
        before.append(a)
    while b < len(lines) and (lines[b][1] == "p" or in_article[lines[b][0]]):
        after.append(b)
        b += 1
    for more in (between, before, after):
        if sum(lines[i][3] for i in more) <= weight:
            for i in more:
                keep[i] = True
    return keep


def main_text(html: str | None) -> str:
    """The content lines of a page, joined by two line feeds; empty if there are none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    if not parser.lines:
        return ""
    high = clustered(np.array([len(text) / tags for text, tags, *_ in parser.lines])).tolist()
    # A name makes furniture of an element unless it holds an article, or, by a weak name on a page without
    # another article, most of the clustered text. A comment stays one.
    weight = Counter()
    for (text, _, hidden, named, _, _), is_high in zip(parser.lines, high, strict=True):
        if not hidden and is_high:
            weight[named] += len(text)
    most = sum(weight.values()) / 2
    free = not parser.plain_article
    overruled = {0} | {i for i, (holds, weak) in enumerate(zip(parser.holds_article, parser.weak, strict=True)) if holds or holds is False and free and weak and weight[i] > most}
    shown = [(line, is_high) for line, is_high in zip(parser.lines, high, strict=True) if not line[2] and line[3] in overruled]
    if not shown:
        return ""
    keep = chosen([(region, element, is_high, len(text)) for (text, _, _, _, region, element), is_high in shown], parser.up, parser.kind)
    return "\n\n".join(line[0] for (line, _), kept in zip(shown, keep, strict=True) if kept)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [main_text(h) for h in batch["html"]]
        yield batch[["page_id", "url"]].assign(text=texts, n_chars=[len(t) for t in texts])


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, url, text, n_chars)``, one row a page; no shuffle.

    A null or empty page, or one of furniture only, gives an empty text; so does a page without
    any text. Of lines with equal ratios all or none are clustered. Markup that is not closed or
    closed twice is read as browsers do, at any depth and length. Repeated rows and null ids pass
    through; other columns are ignored. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return map_batches(rows, _extract, f"page_id {kind}, url string, text string, n_chars long")
