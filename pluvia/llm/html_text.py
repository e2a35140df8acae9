"""Main text of web pages: flat blocks, classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. A block's features are its words and the share of
them in links, the same of the blocks before and after it, and what it stands in (article, navigation, advert,
heading ...). A tree grown on the small labelled pages of html_labels.py tells main text from the rest.

Tags are found in one pass, in time that grows with the page, whatever is left open or unquoted.

Defined results: a null or empty page, and one without main text, gives the empty string; white space is
Unicode white space, so a no-break space becomes a space; a line break tag is white space; unknown and stray tags are
dropped; raw text (scripts, styles) that is never closed ends the page; repeated rows are rows of their
own; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pluvia.llm.common import small
from pluvia.llm.html_labels import PAGES

#: Fixed values of HTML: elements whose tags end a block of text, whose content is raw text, or which hold no text of the page.
BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
SILENT = frozenset("audio button canvas datalist embed input map math meter object output progress select svg video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What a block may stand in, one bit each.
ARTICLE, NAV, HEADER, FOOTER, ASIDE, FORM, ADVERT, NOTICE, COMMENTS, HIDDEN = (1 << i for i in range(10))
#: Elements, roles, and words of class and id that name such a place.
BY_TAG = {"article": ARTICLE, "main": ARTICLE, "nav": NAV, "menu": NAV, "header": HEADER, "footer": FOOTER, "aside": ASIDE, "form": FORM, "fieldset": FORM, "dialog": NOTICE}
BY_ROLE = {"main": ARTICLE, "article": ARTICLE, "navigation": NAV, "menu": NAV, "menubar": NAV, "banner": HEADER, "contentinfo": FOOTER, "complementary": ASIDE, "search": FORM, "form": FORM, "alert": NOTICE, "alertdialog": NOTICE, "dialog": NOTICE}
BY_WORD = {
    ARTICLE: "article articlebody content entry post story",
    NAV: "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc toolbar topbar",
    HEADER: "header masthead",
    FOOTER: "bottombar colophon copyright foot footer imprint legal",
    ASIDE: "aside popular recommended related sidebar trending widget widgets",
    FORM: "form login search signin signup",
    ADVERT: "ad ads adsense advert advertisement advertising banner promo promoted promotion sponsor sponsored",
    NOTICE: "alert consent cookie cookies disclaimer gdpr modal newsletter notice notices overlay paywall popup privacy share sharing social subscribe subscription",
    COMMENTS: "comment comments commentlist discussion disqus replies reply respond thread",
    HIDDEN: "hidden invisible offscreen",
}
_WORDS = {word: bit for bit, words in BY_WORD.items() for word in words.split()}
#: Names that mean the article as a whole.
_MAIN = frozenset({"main", "main-content", "maincontent"})
#: After these the next word of a class tells of what is absent, near or spoken of, not of what it is.
_NEAR = frozenset("category has no tag with without".split())
#: What takes the text of an inline element out of its block.
_INLINE = NAV | ADVERT | HIDDEN

#: A quote counts only after an equals sign, and only if it is closed.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_CUT = re.compile(r"[^a-z0-9]+")


@dataclass
class Block:
    """words, and of these in links; places: the bits above; heading: stands in h1 to h6."""

    text: str
    words: int
    linked: int
    places: int
    heading: bool


@lru_cache(1 << 14)
def _place(tag: str, attributes: str) -> int:
    """The places that a start tag names."""
    bits = BY_TAG.get(tag, 0)
    if not attributes.strip(" \t\r\n\f/"):
        return bits
    named = {k.lower(): v.strip("\"'") for k, v in reversed(_ATTRIBUTE.findall(attributes))}
    bits |= BY_ROLE.get(named.get("role", "").lower(), 0)
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "").lower()):
        bits |= HIDDEN
    if tag in ("html", "body"):
        return bits
    found = 0
    for name in (named.get("id", ""), *named.get("class", "").split()):
        words = [w for w in _CUT.split(_CAMEL.sub("-", html.unescape(name)).lower()) if w]
        if not words or words[0] in _NEAR:
            continue
        first = _WORDS.get(words[0], 0)
        if tag in ("article", "main"):
            found |= first & COMMENTS
            continue
        own = ARTICLE if "-".join(words) in _MAIN else 0
        for w in words:
            own |= _WORDS.get(w, 0)
        # article-header is the head of an article, header-content is the page's; post-comments are comments.
        if first & HEADER or own & ~(ARTICLE | HEADER):
            own &= ~ARTICLE
        found |= own & ~HEADER if own & ARTICLE else own
    bits |= found
    return bits & ~ARTICLE if bits & ~ARTICLE else bits


def _within(outer: int, own: int) -> int:
    """The places of what stands in both: an article of its own is not in the page's head or form,
    and what is in an article may have a head."""
    if outer & ARTICLE:
        own &= ~HEADER
    elif own & ARTICLE:
        outer &= ~(HEADER | FORM)
    return outer | own


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    stack: list[tuple[str, int, bool]] = field(default_factory=list)  # open elements, the places inside, and whether their text is left out
    open: dict[str, int] = field(default_factory=dict)
    links: int = 0
    silent: int = 0
    heading: bool = False

    @property
    def places(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    def text(self, raw: str) -> None:
        if raw and not self.silent and not (self.stack and self.stack[-1][2]):
            self.pieces.append((html.unescape(raw) if "&" in raw else raw, self.links > 0))

    def end_block(self) -> None:
        if not self.pieces:
            return
        whole = "".join(p for p, _ in self.pieces).split()
        if whole:
            linked = sum(len(p.split()) for p, link in self.pieces if link)
            self.blocks.append(Block(" ".join(whole), len(whole), min(linked, len(whole)), self.places, self.heading))
        self.pieces = []

    def push(self, tag: str, places: int, left_out: bool = False) -> None:
        self.stack.append((tag, places, left_out))
        self.open[tag] = self.open.get(tag, 0) + 1

    def pop_to(self, tag: str) -> None:
        while self.open.get(tag, 0):
            last = self.stack.pop()[0]
            self.open[last] -= 1
            if last == tag:
                break

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.text(" ")
        elif tag in SILENT and tag not in VOID:
            self.silent += not attributes.endswith("/")
        elif tag == "a":
            self.links = 1  # a link in a link ends the first
        if tag not in BLOCK:
            own = _place(tag, attributes) if attributes and tag not in VOID and tag not in RAW else 0
            if own & _INLINE:
                self.push(tag, _within(self.places, own), left_out=True)
            return
        self.end_block()
        self.pop_to("p")  # a block ends a paragraph
        self.heading = tag in HEADINGS
        if tag in VOID:
            return
        if tag in ("li", "dt", "dd", "td", "th", "tr"):
            self.links = 0
        own = _place(tag, attributes)
        if tag == "p" or tag in BY_TAG or tag in ("div", "section", "table", "ul", "ol", "dl", "figure", "blockquote", "center", "details") or own:
            self.push(tag, _within(self.places, own))

    def end(self, tag: str) -> None:
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "a":
            self.links = 0
        if tag in BLOCK:
            self.end_block()
            if tag in HEADINGS:
                self.heading = False
            if tag not in ("p", "title"):
                self.links = self.silent = 0  # whatever was left open ends here
        self.pop_to(tag)


def blocks(page: str | None) -> list[Block]:
    """The flat blocks of a page, in its order, without scripts, styles and markup."""
    source, at, reader, pattern = page or "", 0, _Reader(), _TAG
    low = None
    while True:
        lt = source.find("<", at)
        if lt < 0 or lt + 1 >= len(source):
            reader.text(source[at:] if lt < 0 else source[at:lt])
            break
        reader.text(source[at:lt])
        then = source[lt + 1]
        if then in "!?" or (then == "/" and not source[lt + 2 : lt + 3].isalpha()):
            mark = "-->" if source.startswith("<!--", lt) else "]]>" if source.startswith("<![CDATA[", lt) else ">"
            end = source.find(mark, lt + (2 if mark == "-->" and source.startswith("<!-->", lt) else 4 if mark == "-->" else 2))
            if end < 0 and mark != ">":
                mark, end = ">", source.find(">", lt)
            if end < 0:
                break
            at = end + len(mark)
            continue
        if not (then == "/" or (then.isascii() and then.isalpha())):
            reader.text("<")
            at = lt + 1
            continue
        m = pattern.match(source, lt)
        if m is None and pattern is _TAG:  # a quote is never closed: from here on tags end at the first >
            pattern = _LOOSE
            m = pattern.match(source, lt)
        if m is None:  # no > is left
            break
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            reader.end(tag)
            continue
        reader.start(tag, m[3])
        if tag in RAW:
            low = source.lower() if low is None and source.isascii() else low
            end = low.find(f"</{tag}", at) if low is not None else _closing(source, tag, at)
            if end < 0:
                break
            at = end
    reader.end_block()
    return reader.blocks


def _closing(source: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}", re.IGNORECASE | re.ASCII).search(source, at)
    return found.start() if found else -1


#: Columns of the feature matrix.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "other_article", "bad_place", "heading")
BAD = NAV | HEADER | FOOTER | ASIDE | FORM | ADVERT | NOTICE | COMMENTS | HIDDEN


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block. other_article: the page has an article and the block isn't in it."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found], float)
    inside = np.array([bool(b.places & ARTICLE) for b in found], float)
    before = lambda x: np.concatenate([[0.0], x[:-1]]) if n else x
    after = lambda x: np.concatenate([x[1:], [0.0]]) if n else x
    bad = np.array([bool(b.places & BAD) for b in found], float)
    heads = np.array([b.heading for b in found], float)
    # An article that holds no words of its own but links is no article.
    has = float((inside * (1 - bad) * words).sum() > 0)
    return np.stack([words, links, before(words), before(links), after(words), after(links), inside, has * (1 - inside), bad, heads], axis=1)


@dataclass(frozen=True)
class Tree:
    """Inner nodes send rows with feature <= cut to low; a leaf (feature -1) holds the share of main text."""

    feature: int
    cut: float
    share: float
    low: Tree | None = None
    high: Tree | None = None

    def shares(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.share)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[left], out[~left] = self.low.shares(x[left]), self.high.shares(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, leaf: int = 2) -> Tree:
    """A classification tree by Gini impurity; of equal splits the first feature and lowest cut."""
    share = float(y.mean()) if len(y) else 0.0
    best: tuple[float, int, float] | None = None
    if depth and 0.0 < share < 1.0:
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1]) + 1
            at = at[(at >= leaf) & (at <= len(y) - leaf)]
            if not len(at):
                continue
            one, n = t[at - 1], at.astype(float)
            rest, m = t[-1] - one, len(y) - n
            impurity = 2 * (one * (n - one) / n + rest * (m - rest) / m)
            i = int(np.argmin(np.round(impurity, 9)))
            if best is None or impurity[i] < best[0] - 1e-9:
                best = (float(impurity[i]), f, float((v[at[i] - 1] + v[at[i]]) / 2))
    if best is None or best[0] >= 2 * len(y) * share * (1 - share) - 1e-9:
        return Tree(-1, 0.0, share)
    left = x[:, best[1]] <= best[2]
    return Tree(best[1], best[2], share, grow(x[left], y[left], depth - 1, leaf), grow(x[~left], y[~left], depth - 1, leaf))


@lru_cache(1)
def trained() -> Tree:
    """The tree of the labelled pages, whose main blocks begin with + and whose others begin with -."""
    rows, labels = [], []
    for page in PAGES:
        found = blocks(page)
        rows.append(features(found))
        labels += [b.text.startswith("+") for b in found]
    return grow(np.concatenate(rows), np.array(labels, float))


def main_text(page: str | None, tree: Tree | None = None) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = (tree or trained()).shares(features(found)) > 0.5
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extracted(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page; no shuffle."""
    model = tree or trained()
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch, 128):
                texts = [main_text(page.as_py(), model) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
