"""Main text of web pages: flat text blocks, kept or not by a decision tree.

A page is cut into blocks of text at the tags that start a new line. A block's
features are its own word count and link density, those of the blocks before
and after it, and where it stands: under a heading tag, in an article, in an
element for menus, headers, footers, sidebars, forms or dialogs, or in one whose
class, id or role says as much. A small decision tree, trained on the labelled
pages of ``html_examples``, tells main text from the rest.

An element or name marks what it holds, but not the main text that it merely
encloses: a form or a name that says what an element has (``with-sidebar``,
``share-ready``) is a wrapper where an article, a main element or more words
than all unmarked text stand in it. Any other mark is one where it encloses the
largest article, with more words than the unmarked text. Hidden text stays so.

Scripts, styles and other raw elements, comments and markup are no text.
Character references are decoded, white space in a block becomes one space,
and the kept blocks of a page are joined by a line feed, all of them whole.

Null and empty pages, and pages without text, give an empty text. A page of any
length is read in one pass, every character a bounded number of times. Unclosed
elements run to the end of what holds them, an unclosed link to the end of its
paragraph or of the element it began in, unclosed comments and raw elements to
the end of the page; a ``<`` that no ``>`` follows is text. Repeated rows are extracted alike; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from vectext.llm.html_examples import EXAMPLES
from vectext.llm.streams import text_of

TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><'\"]*)")
SPECIAL = re.compile("['\">]")
HREF, ANCHOR = re.compile(r"\bhref\s*=", re.I), re.compile(r"\b(?:name|id)\s*=", re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea template iframe svg select canvas audio video".split())
#: Elements that end a line of text and begin a new one.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
BOILER = frozenset("nav aside footer form menu dialog button fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name something beside the main text.
BOILER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo "
    "consent cookie cookies dialog disclaimer disqus footer form gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices pager pagination popup promo promotion recommended related replies reply respond search "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words before a listed word that say an element has, or lacks, such a part.
HAVING = frozenset("with has have having no not without hide hides show shows for near after before".split())
#: Words behind a listed word that leave it the name of the element.
HOLDERS = frozenset(
    "area bar block body box col column container content group holder inner item items link links list outer panel "
    "region row section slot text unit wrap wrapper zone".split()
)
#: Words that make a text under a mark a body of its own.
LEAST_BODY = 10
FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
    "heading", "in_article", "boiler_element", "boiler_name",
)


@dataclass
class Block:
    """A run of text between two line-ending tags."""

    text: str
    link_chars: int
    heading: bool
    in_article: bool
    boiler_element: bool = False
    boiler_name: bool = False
    mark: int = 0
    body: int = 0

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1

    @property
    def link_density(self) -> float:
        return min(1.0, self.link_chars / max(1, len(self.text)))


@dataclass
class Mark:
    """An element that marks what it holds; ``loose`` and ``hidden`` take in the marks around it, as ``alike`` does."""

    around: int
    element: bool
    name: bool
    loose: bool
    hidden: bool
    alike: int


class Tags:
    """Where the tags of a page end, every character looked at a bounded number of times.

    A tag ends at its first ``>`` outside quotes; where there is none up to the
    end of the page, at its first ``>``.
    """

    def __init__(self, source: str) -> None:
        self.source = source
        #: The last find of each kind: from where, and what was found; finds go forward.
        self.found: dict[str, tuple[int, int]] = {}
        #: Special characters from which, outside quotes, no tag ends.
        self.endless: set[int] = set()

    def next(self, kind: str, at: int) -> int:
        """Place of the next ``>``, or of the next quote or ``>``, -1 if there is none."""
        since, place = self.found.get(kind, (0, 0))
        if not (since <= at and (place < 0 or place >= at)) or kind not in self.found:
            if kind == ">":
                place = self.source.find(">", at)
            else:
                match = SPECIAL.search(self.source, at)
                place = match.start() if match else -1
            self.found[kind] = at, place
        return place

    def end(self, at: int) -> int:
        """The place behind the tag whose attributes begin at ``at``, -1 if no ``>`` follows."""
        plain = self.next(">", at)
        if plain < 0:
            return -1
        seen, special = [], self.next("special", at)
        while special >= 0 and special not in self.endless:
            quote = self.source[special]
            if quote == ">":
                return special + 1
            seen.append(special)
            close = self.source.find(quote, special + 1)
            if close < 0:
                break
            match = SPECIAL.search(self.source, close + 1)
            special = match.start() if match else -1
        self.endless.update(seen)
        return plain + 1


class Page:
    """Reads a page into blocks."""

    def __init__(self, source: str) -> None:
        self.blocks: list[Block] = []
        self.open: list[str] = []
        #: Of each open element: how many articles it is in, the marks and bodies (articles) by number, 0 for none.
        self.places: list[tuple[int, int, int]] = [(0, 0, 0)]
        self.marks = [Mark(0, False, False, True, False, 0)]
        self.kinds: dict[tuple[int, str, str], int] = {}
        self.bodies = [0]
        self.parts: list[str] = []
        self.links, self.link_chars, self.heading = 0, 0, False
        #: How often each element is open; how deep the link began, and whether in a paragraph.
        self.counts: Counter[str] = Counter()
        self.link_depth, self.link_in_p, self.in_p = 0, False, False
        self.read(source)
        self.settle()

    def read(self, source: str) -> None:
        at, n, tags = 0, len(source), Tags(source)
        while at < n:
            opening = source.find("<", at)
            if opening < 0:
                self.add(source[at:])
                break
            if opening > at:
                self.add(source[at:opening])
            if source.startswith("<!--", opening):
                end = source.find("-->", opening + 4)
                at = n if end < 0 else end + 3
                continue
            tag = TAG_NAME.match(source, opening)
            if tag:
                at = tags.end(tag.end())
            else:
                at = tags.next(">", opening) + 1 if source[opening + 1:opening + 2] in ("!", "?") else 0
            if at <= 0:
                self.add("<")
                at = opening + 1
            elif tag:
                at = self.tag(source, tag[1], tag[2].lower(), source[tag.end():at - 1], at)
        self.flush()

    def tag(self, source: str, closing: str, name: str, rest: str, at: int) -> int:
        """Takes in a tag that ends at ``at``; returns where to go on, behind the content of raw elements."""
        if closing:
            self.close(name)
        elif name in RAW:
            # A slash closes foreign elements only; a script runs to its end tag.
            if not (name == "svg" and rest.endswith("/")):
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                return len(source) if end is None else end.end()
        else:
            self.start(name, rest)
        return at

    def add(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        self.parts.append(text)
        if self.links:
            self.link_chars += len(text.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            article, mark, body = self.places[-1]
            self.blocks.append(Block(text, self.link_chars, self.heading, bool(article), mark=mark, body=body))
        self.parts, self.link_chars = [], 0

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.parts.append(" ")
        if name in BLOCK:
            self.flush()
        if name == "p":
            self.paragraph(True)
        if name == "a":
            # A named place without a target is no link.
            self.links = int(bool(HREF.search(rest)) or not ANCHOR.search(rest))
            self.link_depth, self.link_in_p = len(self.open), self.in_p
        if name in HEADINGS:
            self.heading = True
        if name in VOID or rest.endswith("/") or name not in BLOCK or name == "p":
            return
        article, mark, body = self.places[-1]
        article += name in MAIN
        element = name in BOILER or (name == "header" and not article)
        # That a form is named a form says nothing more.
        named, part, hidden = names_boiler(rest, FORM_NAMES if name == "form" else BOILER_NAMES)
        if name in ("html", "body"):
            named = hidden = False
        if element or named or hidden:
            outer = self.marks[mark]
            loose = outer.loose and (not element or name == "form") and (not named or part)
            alike = self.kinds.setdefault((outer.alike, name, rest), len(self.kinds) + 1)
            self.marks.append(Mark(mark, element, named or hidden, loose, outer.hidden or hidden, alike))
            mark = len(self.marks) - 1
        if name in MAIN:
            self.bodies.append(mark)
            body = len(self.bodies) - 1
        self.open.append(name)
        self.counts[name] += 1
        self.places.append((article, mark, body))

    def paragraph(self, opens: bool) -> None:
        """A paragraph begins or ends; a link that began in the one before ends with it."""
        if self.link_in_p:
            self.links, self.link_in_p = 0, False
        self.in_p = opens

    def close(self, name: str) -> None:
        if name == "a":
            self.links = 0
        if name in BLOCK:
            self.flush()
        if name in HEADINGS:
            self.heading = False
        if name == "p":
            self.paragraph(False)
        if self.counts[name]:
            while True:
                ended = self.open.pop()
                self.places.pop()
                self.counts[ended] -= 1
                if ended == name:
                    break
            # An open link ends with the element that it began in.
            if len(self.open) < self.link_depth:
                self.links = 0

    def settle(self) -> None:
        """Marks the blocks, by the marked elements that are not wrappers of main text."""
        if len(self.marks) > 1:
            wrappers = self.wrappers()
            # An element comes after those around it.
            marked = [(False, False)]
            for k, m in enumerate(self.marks[1:], 1):
                element, name = marked[m.around]
                marked.append((element, name) if k in wrappers else (element or m.element, name or m.name))
            for b in self.blocks:
                b.boiler_element, b.boiler_name = marked[b.mark]

    def wrappers(self) -> set[int]:
        """Marked elements that enclose main text."""
        in_body, by_kind = [0] * len(self.bodies), [0] * (len(self.kinds) + 1)
        for b in self.blocks:
            if b.link_density < 0.5:
                by_kind[self.marks[b.mark].alike] += b.words
                if b.mark == self.bodies[b.body]:
                    in_body[b.body] += b.words
        shown = [(in_body[k], self.marks[m]) for k, m in enumerate(self.bodies) if k and not self.marks[m].hidden]
        free = {0} | {m.alike for _, m in shown if m.loose}
        unmarked = self.enclosing(free)
        plain = sum(by_kind[kind] for kind in {self.marks[k].alike for k in unmarked | {0}})
        largest = max(shown, key=lambda s: s[0], default=(0, self.marks[0]))
        if largest[0] > plain:
            free.add(largest[1].alike)
        else:
            texts = [(by_kind[m.alike], m.alike) for m in self.marks if m.loose and not m.hidden and m.alike not in free]
            most = max(texts, default=(0, 0))
            if most[0] > plain and most[0] >= LEAST_BODY:
                free.add(most[1])
        return self.enclosing(free)

    def enclosing(self, kinds: set[int]) -> set[int]:
        """Marked elements of these kinds and those around them."""
        out: set[int] = set()
        for k in range(len(self.marks) - 1, 0, -1):
            if k in out or self.marks[k].alike in kinds:
                out |= {k, self.marks[k].around}
        return out - {0}


FORM_NAMES = BOILER_NAMES - {"form"}


def names_boiler(rest: str, listed: frozenset[str] = BOILER_NAMES) -> tuple[bool, bool, bool]:
    """Whether attributes name something beside the main text, only as a part of something else, or hide the element."""
    if not rest or rest.isspace():
        return False, False, False
    named, part = False, True
    for found in ATTRIBUTE.finditer(rest):
        for value in (found[2] or found[3] or found[4] or "").split():
            words = [w.lower() for w in NAME_PARTS.findall(value)]
            if listed.isdisjoint(words):
                continue
            named = True
            head = [w for w in words if w not in HOLDERS][-1]
            part = part and (head not in listed or not HAVING.isdisjoint(words))
    return named, named and part, bool(HIDDEN.search(rest))


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block, columns as in ``FEATURES``."""
    out = np.zeros((len(blocks), len(FEATURES)))
    for k, b in enumerate(blocks):
        out[k, :2] = b.words, b.link_density
        out[k, 6:] = b.heading, b.in_article, b.boiler_element, b.boiler_name
    out[1:, 2:4], out[:-1, 4:6] = out[:-1, :2], out[1:, :2]
    return out


@dataclass
class Node:
    """A cut of one feature, or a leaf with its share of main text."""

    share: float
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def shares(self, x: np.ndarray) -> np.ndarray:
        if self.low is None or self.high is None:
            return np.full(len(x), self.share)
        above = x[:, self.feature] > self.cut
        out = np.empty(len(x))
        out[above], out[~above] = self.high.shares(x[above]), self.low.shares(x[~above])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A tree of cuts that lower the Gini impurity most, by features in their order on ties."""
    node = Node(float(y.mean()))
    if not depth or node.share in (0.0, 1.0):
        return node
    best = node.share * (1 - node.share) * len(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            above = x[:, f] > cut
            sides = y[above], y[~above]
            if min(map(len, sides)) < least:
                continue
            impurity = sum(s.mean() * (1 - s.mean()) * len(s) for s in sides)
            if impurity < best:
                best, node.feature, node.cut = impurity, f, float(cut)
    if node.feature >= 0:
        above = x[:, node.feature] > node.cut
        node.low, node.high = grow(x[~above], y[~above], depth - 1, least), grow(x[above], y[above], depth - 1, least)
    return node


def labelled_table(pages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of marked pages."""
    rows, labels = [], []
    for page in pages:
        blocks = Page(page).blocks
        labels += [b.text.startswith("+") for b in blocks]
        for b in blocks:
            b.text = re.sub(r"(^| )[+-] ", r"\1", b.text)
        rows.append(features(blocks))
    return np.concatenate(rows), np.array(labels, dtype=float)


@cache
def trained_tree() -> Node:
    return grow(*labelled_table(EXAMPLES))


def main_text(source: str | None, tree: Node | None = None) -> str:
    """The main text of one page."""
    blocks = Page(source or "").blocks
    if not blocks:
        return ""
    keep = (tree or trained_tree()).shares(features(blocks)) > 0.5
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds each page's main text; all other columns stay."""
    tree = trained_tree()

    @pandas_udf("string")
    def extracted(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return df.withColumn(out, extracted(text_of(html)))
