"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with the path of tags from the root down to it. Blocks inside
parts that are named as something else than the article (menus, adverts, forms, comments ...) are
left out. For each path the text outside links and the punctuation are added up and divided by the
path's blocks. Both ratios are smoothed over neighbouring blocks, fused to a score and held against a
threshold taken from the scores' spread. The smallest part of the page that encloses all chosen
blocks is the article; within it, blocks that are nothing but links and whose path was not chosen are
left out. Names that an article may well use itself (related, search, notice ...) leave nothing out
there: a part with such a class is a path of its own with half the score, and the threshold decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import ship

# A quote opens a value only after "="; without its end it is an ordinary character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select xmp noembed noframes".split())
LEFT_OUT = frozenset("head nav footer aside form button dialog menu fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr img nobr".split()
)
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre td th tr tbody thead table figure figcaption".split())
# An open element of the key ends where one of the values begins.
ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
SURE = (
    "ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|sidebar|nav|navbar|navigation|breadcrumbs?|footer|masthead|"
    "comments?|commentlist|replies|respond|disqus|cookies?|consent|gdpr|popup|newsletter|subscribe|signup|share|sharing|pagination|"
    "pager|complementary|contentinfo"
)
DOUBTFUL = (
    "promotion|banner|side|menu|discussion|notices?|disclaimer|modal|overlay|login|social|related|recommended|widget|toolbar|search"
)


def named(words: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.IGNORECASE)


SURE_PARTS, DOUBTFUL_PARTS = named(SURE), named(DOUBTFUL)
# Words of an article that is a reader's comment. An article that merely is open for comments is none.
COMMENT = re.compile(r"(?:user-|reader-)?comment(?:[_-](?:\d+|body|item|entry|content))?|reply(?:[_-]\d+)?", re.IGNORECASE)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top)[_-]?header(?:$|[\s_-])", re.IGNORECASE)
MARKS = re.compile(r"[.,;:!?，。；：！？、…]")

RADIUS = 2
SPREAD = 0.5
DOUBT = 0.5


class Page:
    """Blocks of one page; elements know their parents, paths are numbered."""

    def __init__(self, html: str):
        self.parents, self.depths, self.tags = [-1], [0], [""]
        self.paths: dict[tuple[int, str], int] = {}
        # stack: (tag, element, path, left out, inside an article, doubtful)
        self.stack: list[tuple] = [("", 0, 0, False, False, False)]
        self.blocks: list[tuple[int, int, str, int, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.read(html)

    def read(self, html: str) -> None:
        at, links = 0, 0
        while m := TOKEN.search(html, at):
            self.text(html[at : m.start()], links)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name == "a":
                    links = max(0, links - 1)
                self.end(name)
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else len(html)
            else:
                if name == "a":
                    links = 1
                self.start(name, m[3])
        self.text(html[at:], links)
        self.close_block()

    def text(self, raw: str, links: int) -> None:
        if raw and not self.stack[-1][3]:
            decoded = unescape(raw) if "&" in raw else raw
            self.parts.append(decoded)
            if links:
                self.linked += len("".join(decoded.split()))

    def close_block(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                _, element, path, _, _, doubt = next(s for s in reversed(self.stack) if s[0] not in INLINE)
                self.blocks.append((element, path, text, self.linked, doubt))
            self.parts, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name not in INLINE:
            self.close_block()
            self.imply_ends(name)
        if name in VOID:
            return
        _, parent, path, out, inside, doubt = self.stack[-1]
        verdict = self.other_part(name, attributes, inside)
        out, doubt = out or verdict == "out", doubt or verdict == "doubt"
        if name not in INLINE:
            path = self.paths.setdefault((path, f"{name}?" if doubt else name), len(self.paths) + 1)
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            self.tags.append(name)
            parent = len(self.parents) - 1
        self.stack.append((name, parent, path, out, inside or name in ARTICLE, doubt))

    @staticmethod
    def other_part(name: str, attributes: str, inside: bool) -> str:
        """Whether an element is "out", a "doubt" inside an article, or neither ("")."""
        if name in LEFT_OUT or (name == "header" and not inside):
            return "out"
        if not attributes or name in ("html", "body", "main"):
            return ""
        given = {a.lower(): v.strip("\"'") for a, v in ATTRIBUTE.findall(attributes)}
        classes, anchor = f"{given.get('class', '')} {given.get('role', '')}", given.get("id", "")
        if name == "article":
            # the page's own parts are never left out by name, but an article may be a comment
            return "out" if any(COMMENT.fullmatch(w) for w in f"{classes} {anchor}".split()) else ""
        hidden = "hidden" in given or "hidden" in classes.lower().split() or given.get("aria-hidden", "").lower() == "true"
        if hidden or NO_DISPLAY.search(given.get("style", "")):
            return "out"
        if not inside:
            names = f"{classes} {anchor}"
            return "out" if any(p.search(names) for p in (SURE_PARTS, DOUBTFUL_PARTS, PAGE_HEADER)) else ""
        # Headings and words of an article may be named after what they speak of.
        if SURE_PARTS.search(classes if name in HEADINGS else f"{classes} {anchor}") or PAGE_HEADER.search(classes):
            return "out"
        return "doubt" if name not in INLINE and name not in HEADINGS and DOUBTFUL_PARTS.search(classes) else ""

    def imply_ends(self, name: str) -> None:
        if name in ENDS:
            ended, stop = ENDS[name]
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in stop:
                    break
                if self.stack[k][0] in ended:
                    del self.stack[k:]
                    break
        elif name != "br":
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] == "p":
                    del self.stack[k:]
                    break
                if self.stack[k][0] not in INLINE:
                    break

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.close_block()
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == name:
                del self.stack[k:]
                break
            if name in INLINE and self.stack[k][0] not in INLINE:
                break

    def article(self, chosen: list[tuple]) -> int:
        """The outermost article or main part with most of the chosen text, else what encloses all
        chosen blocks, a single block's surroundings included."""
        letters: dict[int, int] = {}
        for element, _, text, _, _ in chosen:
            top, e = 0, element
            while e > 0:
                top = e if self.tags[e] in ARTICLE else top
                e = self.parents[e]
            letters[top] = letters.get(top, 0) + len(text)
        top = max(letters, key=letters.get)
        if top and 2 * letters[top] >= sum(letters.values()):
            return top
        around = self.enclosing([b[0] for b in chosen])
        while around and self.tags[around] in LEAVES:
            around = self.parents[around]
        return around

    def enclosing(self, elements: list[int]) -> int:
        """The smallest element around all of them."""
        around = elements[0]
        for e in elements[1:]:
            while e != around:
                if self.depths[e] >= self.depths[around]:
                    e = self.parents[e]
                else:
                    around = self.parents[around]
        return around


def smoothed(values: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbours, the weights at the ends adding up to one as well."""
    kernel = np.exp(-0.5 * np.arange(-RADIUS, RADIUS + 1) ** 2)
    weights = np.convolve(np.ones(len(values)), kernel)[RADIUS : RADIUS + len(values)]
    return np.convolve(values, kernel)[RADIUS : RADIUS + len(values)] / weights


def path_scores(blocks: list[tuple]) -> np.ndarray:
    """Fused ratio of text and of punctuation per path, smoothed along the page; half of it where the name is doubtful."""
    paths = np.asarray([b[1] for b in blocks])
    letters = np.asarray([max(0, len(b[2]) - b[3]) for b in blocks], float)
    marks = np.asarray([len(MARKS.findall(b[2])) for b in blocks], float)
    _, which = np.unique(paths, return_inverse=True)
    each = np.bincount(which)
    text_ratio = (np.bincount(which, letters) / each)[which]
    mark_ratio = (np.bincount(which, marks) / each)[which]
    trust = np.where([b[4] for b in blocks], DOUBT, 1.0)
    return trust * smoothed(text_ratio) * (1 + smoothed(mark_ratio))


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Page(html)
    blocks = page.blocks
    if not blocks:
        return ""
    scores = path_scores(blocks)
    chosen = scores >= min(SPREAD * scores.std(), scores.max())
    around = page.article([b for b, c in zip(blocks, chosen, strict=True) if c])
    inside, kept = {around: True, 0: around == 0}, []
    for (element, _, text, linked, doubt), c in zip(blocks, chosen, strict=True):
        trail = []
        e = element
        while e not in inside:
            trail.append(e)
            e = page.parents[e]
        for t in trail:
            inside[t] = inside[e]
        if inside[element] and (c or not doubt and linked < len("".join(text.split()))):
            kept.append(text)
    return "\n".join(kept)


@F.pandas_udf(T.StringType())
def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame, html: str, text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in ``text``, an existing column of that name replaced.

    A null, empty or text-less page gives an empty string. Every row is read for itself and stays.
    Markup without an end runs to the end of the page. Nothing is cut off, whatever a page's length.
    """
    columns = [c for c in pages.columns if c != text]
    return pages.select(*columns, extracted(F.col(html).cast("string")).alias(text))


ship(__name__)
