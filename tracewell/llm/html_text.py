"""Main text of web pages: flat text blocks, classified by a decision tree over them and their neighbours."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import batches, known_id, null_ids

# How elements of HTML are shown.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
UNSEEN = frozenset("script style title noscript template textarea svg math iframe object canvas audio video noembed noframes".split())
CONTAINERS = frozenset("article aside blockquote body button details dialog div dl fieldset figure footer form header li main menu nav ol p search section select span table td tr ul".split())
ASIDE = frozenset("aside button dialog footer form menu nav search select".split())
BREAKS = frozenset("br wbr".split())
#: Words in class, id and role that tell what a container is for.
ASIDE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus"
    " footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion"
    " recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
TOP_WORDS = frozenset(("header", "top", "topbar"))
MAIN_WORDS = frozenset("article articlebody content entry main maincontent post postbody story".split())
#: Of ASIDE_WORDS, those of texts that aren't the article however long they are.
OTHER_WORDS = frozenset("comment comments consent cookie cookies disqus gdpr modal popup replies reply respond".split())
#: After these, a word tells what the page has elsewhere, or hasn't.
MODIFIERS = frozenset("has no with without".split())
#: Words without links that an article outside of all other parts has at least, if it is the page's.
ARTICLE = 20

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Labelled blocks the tree is trained on. hint: 1 within an article or main part, -1 within
#: a part for something else, 0 neither; then heading, words, link density, words and link density of
#: the block before and of that after; last, whether it is main text.
LABELLED = (
    (1, 1, 8, 0.0, 6, 1.0, 40, 0.0, 1),
    (1, 1, 3, 0.0, 12, 0.0, 2, 0.0, 1),
    (1, 1, 5, 1.0, 30, 0.0, 60, 0.0, 1),
    (1, 0, 1, 0.0, 60, 0.0, 45, 0.0, 1),
    (1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 1),
    (1, 0, 2, 0.0, 0, 0.0, 0, 0.0, 1),
    (1, 0, 2, 0.0, 7, 0.0, 6, 0.3, 1),
    (1, 0, 40, 0.0, 8, 0.0, 30, 0.0, 1),
    (1, 0, 120, 0.1, 50, 0.0, 0, 0.0, 1),
    (1, 0, 25, 0.5, 50, 0.0, 60, 0.0, 1),
    (1, 0, 3, 1.0, 60, 0.0, 50, 0.1, 1),
    (1, 0, 14, 0.2, 20, 0.0, 4, 1.0, 1),
    (1, 0, 3, 1.0, 4, 1.0, 3, 1.0, 0),
    (1, 0, 5, 1.0, 40, 0.0, 4, 1.0, 0),
    (1, 0, 4, 1.0, 5, 1.0, 0, 0.0, 0),
    (1, 0, 2, 1.0, 2, 1.0, 30, 0.0, 0),
    (0, 1, 7, 0.0, 3, 1.0, 60, 0.0, 1),
    (0, 1, 2, 0.0, 3, 1.0, 40, 0.0, 1),
    (0, 1, 3, 0.0, 1, 1.0, 25, 0.0, 1),
    (0, 1, 5, 0.0, 2, 1.0, 18, 0.1, 1),
    (0, 1, 4, 0.0, 0, 0.0, 30, 0.0, 1),
    (0, 1, 6, 0.0, 45, 0.0, 35, 0.0, 1),
    (0, 1, 4, 0.0, 30, 0.0, 4, 1.0, 0),
    (0, 1, 2, 0.0, 5, 0.9, 3, 1.0, 0),
    (0, 1, 3, 1.0, 3, 1.0, 5, 1.0, 0),
    (0, 0, 60, 0.0, 5, 0.0, 70, 0.0, 1),
    (0, 0, 35, 0.1, 2, 1.0, 0, 0.0, 1),
    (0, 0, 90, 0.2, 40, 0.0, 4, 1.0, 1),
    (0, 0, 22, 0.0, 50, 0.0, 50, 0.0, 1),
    (0, 0, 18, 0.0, 8, 0.0, 25, 0.0, 1),
    (0, 0, 40, 0.0, 1, 0.0, 2, 1.0, 1),
    (0, 0, 26, 0.0, 2, 1.0, 3, 1.0, 1),
    (0, 0, 80, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0, 20, 0.1, 3, 1.0, 40, 0.0, 1),
    (0, 0, 16, 0.0, 40, 0.0, 2, 1.0, 1),
    (0, 0, 30, 0.3, 6, 0.0, 5, 0.0, 1),
    (0, 0, 3, 0.0, 50, 0.0, 60, 0.0, 1),
    (0, 0, 6, 0.1, 40, 0.0, 30, 0.0, 1),
    (0, 0, 4, 0.0, 30, 0.0, 3, 1.0, 0),
    (0, 0, 5, 0.0, 3, 1.0, 4, 1.0, 0),
    (0, 0, 6, 0.0, 0, 0.0, 2, 1.0, 0),
    (0, 0, 3, 0.0, 2, 1.0, 0, 0.0, 0),
    (0, 0, 4, 0.0, 3, 1.0, 2, 0.0, 0),
    (0, 0, 2, 0.0, 4, 1.0, 5, 0.0, 0),
    (0, 0, 5, 0.0, 2, 0.9, 0, 0.0, 0),
    (0, 0, 8, 0.4, 30, 0.0, 0, 0.0, 0),
    (0, 0, 7, 0.0, 3, 1.0, 8, 0.0, 0),
    (0, 0, 3, 1.0, 3, 1.0, 3, 1.0, 0),
    (0, 0, 2, 1.0, 50, 0.0, 60, 0.0, 0),
    (0, 0, 30, 0.9, 25, 0.9, 30, 1.0, 0),
    (0, 0, 45, 0.8, 4, 1.0, 6, 1.0, 0),
    (-1, 0, 3, 1.0, 2, 1.0, 4, 1.0, 0),
    (-1, 0, 20, 0.0, 3, 1.0, 60, 0.0, 0),
    (-1, 0, 70, 0.0, 60, 0.0, 50, 0.0, 0),
    (-1, 0, 8, 0.0, 5, 1.0, 9, 0.0, 0),
    (-1, 1, 3, 0.0, 60, 0.0, 20, 0.0, 0),
    (-1, 0, 9, 0.1, 55, 0.0, 0, 0.0, 0),
    (-1, 0, 1, 0.0, 1, 0.0, 1, 0.0, 0),
    (1, 1, 5, 0.0, 3, 1.0, 4, 0.0, 1),
    (1, 0, 4, 0.0, 3, 1.0, 6, 0.0, 1),
    (1, 0, 3, 0.0, 30, 0.0, 4, 1.0, 1),
    (1, 0, 6, 0.0, 3, 1.0, 3, 1.0, 1),
    (1, 1, 4, 1.0, 30, 0.0, 8, 0.0, 1),
    (1, 0, 8, 0.0, 0, 0.0, 5, 1.0, 1),
    (1, 1, 3, 1.0, 4, 1.0, 9, 0.0, 1),
    (1, 0, 12, 1.0, 9, 0.0, 12, 0.0, 1),
    (1, 0, 4, 0.7, 20, 0.0, 12, 0.0, 1),
    (1, 0, 2, 0.0, 0, 0.0, 3, 1.0, 1),
    (1, 0, 5, 0.2, 4, 1.0, 4, 1.0, 1),
    (0, 0, 11, 0.0, 35, 0.0, 4, 0.0, 1),
    (0, 0, 10, 0.0, 74, 0.0, 0, 0.0, 0),
    (0, 0, 11, 0.0, 112, 0.0, 0, 0.0, 0),
    (0, 0, 12, 0.0, 8, 0.0, 0, 0.0, 0),
    (0, 0, 12, 0.0, 1, 1.0, 11, 0.0, 0),
    (0, 1, 9, 0.0, 7, 0.0, 9, 0.0, 1),
    (0, 0, 15, 0.0, 10, 0.0, 0, 0.0, 0),
    (0, 1, 7, 0.0, 10, 0.0, 10, 0.0, 1),
    (0, 1, 3, 0.0, 4, 0.0, 3, 0.0, 1),
    (0, 0, 7, 0.0, 1, 1.0, 9, 0.0, 0),
    (0, 0, 5, 0.0, 1, 1.0, 11, 0.0, 0),
    (0, 0, 7, 0.0, 7, 0.0, 8, 0.0, 1),
    (0, 0, 16, 0.0, 121, 0.0, 0, 0.0, 0),
    (0, 0, 9, 0.0, 6, 0.0, 15, 0.0, 1),
    (0, 0, 74, 0.0, 89, 0.0, 11, 0.0, 1),
    (0, 1, 5, 0.0, 9, 0.0, 5, 0.0, 1),
    (0, 0, 13, 0.0, 30, 0.0, 1, 0.0, 1),
    (0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0),
    (0, 0, 8, 0.0, 1, 1.0, 14, 0.0, 0),
)


@dataclass
class Tree:
    """A leaf has ``label``; else rows whose ``feature`` is at most ``at`` go ``low``, others ``high``."""

    label: int = 0
    feature: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None


def train(rows: Sequence[Sequence[float]]) -> Tree:
    """A decision tree by Gini impurity, grown till its leaves are pure or no split helps."""
    x = np.array([r[:-1] for r in rows], float)
    y = np.array([r[-1] for r in rows], int)

    def impurity(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = k / np.maximum(n, 1)
        return 2 * p * (1 - p) * n

    def grow(at: np.ndarray) -> Tree:
        ones, n = int(y[at].sum()), len(at)
        leaf, best = Tree(label=int(2 * ones > n)), None
        if 0 < ones < n:
            for f in range(x.shape[1]):
                by = at[np.argsort(x[at, f], kind="stable")]
                v, k = x[by, f], np.cumsum(y[by])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if len(cut):
                    cost = impurity(k[cut], cut + 1) + impurity(ones - k[cut], n - cut - 1)
                    i = int(np.argmin(cost))
                    if best is None or cost[i] < best[0] - 1e-9:
                        best = (cost[i], f, (v[cut[i]] + v[cut[i] + 1]) / 2)
        if best is None:
            return leaf
        _, f, value = best
        return Tree(leaf.label, f, value, grow(at[x[at, f] <= value]), grow(at[x[at, f] > value]))

    return grow(np.arange(len(y)))


def decide(tree: Tree, row: Sequence[float]) -> int:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.at else tree.high
    return tree.label


@dataclass
class Block:
    """Text between two block borders, with its words within links and its container's hint."""

    text: str
    hint: int
    heading: int
    words: int
    linked: int


@dataclass
class Part:
    """A container: number of its parent (-1: none), what it tells of itself, its hint, and its own words without links."""

    up: int
    tag: str
    hidden: bool = False
    other: bool = False  # it or one around it has OTHER_WORDS
    aside: bool = False
    top: bool = False
    main: bool = False
    hint: int = 0
    words: int = 0


def _told(part: Part, attributes: str) -> None:
    """Sets what the attributes tell, by their names: a value that reads like an attribute is none."""
    named: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            if part.tag != "body":
                for token in value.split():
                    ws = [w.lower() for w in _PART.findall(token)]
                    named.update(w for before, w in zip(("", *ws), ws) if before not in MODIFIERS)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NO_DISPLAY.search(value):
            part.hidden = True
    if named:
        part.aside, part.top, part.main = bool(named & ASIDE_WORDS), bool(named & TOP_WORDS), bool(named & MAIN_WORDS)
        part.other = part.other or bool(named & OTHER_WORDS)


def _hint(part: Part, up: int, opened: bool = False) -> int:
    """Of a container: what its parent's (``up``) is, unless it tells more itself; ``opened``: it is but a wrapper."""
    if part.hidden or up < 0 or part.tag in ASIDE and not opened:
        return -1
    if part.tag in ("article", "main"):
        return 1
    if part.tag == "header":
        return up or -1
    if not opened and (part.aside or not up and part.top):
        return -1
    return 1 if part.main else up


def unwrapped(parts: list[Part], loose: int) -> list[int] | None:
    """Hints where parts for something else turn out to hold the page's article; None if none does.

    A main in one counts, and an article that has more words than all text outside of such parts
    and no such part's comments around it. A form, or a part that is named as something else,
    is but a wrapper if it has most of the page's words and no article lies outside. What is hidden
    stays so. ``loose``: words outside of all containers.
    """
    if all(p.hint >= 0 for p in parts):
        return None
    words = [0 if p.hidden else p.words for p in parts]
    total = loose + sum(words)
    clear = loose + sum(n for p, n in zip(parts, words) if p.hint >= 0)
    for i in range(len(parts) - 1, -1, -1):
        if parts[i].up >= 0:
            words[parts[i].up] += words[i]
    outside = any(p.hint > 0 and n >= ARTICLE for p, n in zip(parts, words))
    held, opened = set(), set()
    for i, p in enumerate(parts):
        if p.hint < 0 and not p.hidden:
            if p.tag == "main" or p.tag == "article" and not p.other and words[i] > clear:
                held.add(i)
            elif not outside and not p.other and 2 * words[i] > total and (p.tag == "form" or p.tag not in ASIDE and p.tag != "header" and (p.aside or p.top)):
                opened.add(i)
    if not held and not opened:
        return None
    out: list[int] = []
    for i, p in enumerate(parts):
        out.append(1 if i in held else _hint(p, out[p.up] if p.up >= 0 else 0, i in opened))
    return out


@dataclass
class _Reader:
    """Turns the tokens of a page into blocks. ``hints``: of the containers, if they are known."""

    hints: list[int] | None = None
    blocks: list[Block] = field(default_factory=list)
    containers: list[Part] = field(default_factory=list)
    stack: list[tuple[str, int, int]] = field(default_factory=list)
    open: Counter[str] = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    loose: int = 0
    linked: int = 0
    link: int = 0
    heading: int = 0

    def text(self, raw: str) -> None:
        if raw:
            shown = html.unescape(raw) if "&" in raw else raw
            self.parts.append(shown)
            if self.link:
                self.linked += len(shown.split())

    def close_block(self) -> None:
        if self.parts:
            ws = "".join(self.parts).split()
            if ws:
                linked = min(self.linked, len(ws))
                self.blocks.append(Block(" ".join(ws), self.stack[-1][1] if self.stack else 0, self.heading, len(ws), linked))
                if self.stack:
                    self.containers[self.stack[-1][2]].words += len(ws) - linked
                else:
                    self.loose += len(ws) - linked
            self.parts.clear()
        self.linked = 0

    def container(self, tag: str, attributes: str) -> tuple[str, int, int]:
        """Its tag, hint and number."""
        _, hint, up = self.stack[-1] if self.stack else ("", 0, -1)
        part = Part(up, tag)
        if up >= 0:
            part.hidden, part.other = self.containers[up].hidden, self.containers[up].other
        if attributes:
            _told(part, attributes)
        at = len(self.containers)
        part.hint = self.hints[at] if self.hints else _hint(part, hint)
        self.containers.append(part)
        return tag, part.hint, at

    def tag(self, closing: bool, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = 0 if closing else 1
        elif tag in BREAKS:
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self.close_block()
            if not closing and self.stack and self.stack[-1][0] == "p":  # a block ends an open paragraph
                self.stack.pop()
                self.open["p"] -= 1
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                self.heading = 0 if closing else 1
            elif tag not in ("hr",):
                self.heading = 0
            self.link = 0 if closing else self.link
        if tag in CONTAINERS:
            if not closing:
                new = self.container(tag, attributes)
                if tag == "span" and new[1] != (self.stack[-1][1] if self.stack else 0):
                    self.close_block()
                self.stack.append(new)
                self.open[tag] += 1
            elif self.open[tag]:  # else there is none to close, however deep the stack is
                for i in range(len(self.stack) - 1, -1, -1):
                    if self.stack[i][0] == tag:
                        if tag == "span" and self.stack[i][1] != (self.stack[i - 1][1] if i else 0):
                            self.close_block()
                        self.open.subtract(t for t, _, _ in self.stack[i:])
                        del self.stack[i:]
                        break


def _tag(page: str, at: int, quotes: bool) -> tuple[int, int, bool, str, str, bool] | None:
    """The next tag: (start, end, closing, name, attributes, quotes); comments and declarations have no name.

    ``quotes``: whether quotations count. Where one isn't closed till the page's end, none count from
    there on, so each character is passed over a bounded number of times.
    """
    while True:
        start = page.find("<", at)
        if start < 0:
            return None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            return start, end + 3 if end >= 0 else len(page), False, "", "", quotes
        named = _NAME.match(page, start + 1)
        if named or page[start + 1 : start + 2] in ("!", "?"):
            break
        at = start + 1
    behind = named.end() if named else start + 2
    closed = _QUOTED.match(page, behind) if named and quotes else None
    quotes = quotes and not (named and not closed)
    end = closed.end() - 1 if closed else page.find(">", behind)
    if end < 0:
        return None
    return start, end + 1, bool(named and named[1]), named[2].lower() if named else "", page[behind:end], quotes


def _read(page: str, hints: list[int] | None = None) -> _Reader:
    out, at, quotes = _Reader(hints), 0, True
    while found := _tag(page, at, quotes):
        start, end, closing, name, attributes, quotes = found
        out.text(page[at:start])
        at = end
        if name in UNSEEN and not closing and not attributes.endswith("/"):
            over = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = over.end() if over else len(page)
        elif name:
            out.tag(closing, name, attributes)
    out.text(page[at:])
    out.close_block()
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order. Markup that isn't closed or is nested wrongly is read as it comes."""
    out = _read(page)
    hints = unwrapped(out.containers, out.loose)
    return out.blocks if hints is None else _read(page, hints).blocks


def features(bs: list[Block]) -> list[tuple[float, ...]]:
    """hint, heading, and words and link density of each block, the one before and the one after."""
    own = [(0, 0.0), *((b.words, b.linked / b.words) for b in bs), (0, 0.0)]
    return [(b.hint, b.heading, *own[i + 1], *own[i], *own[i + 2]) for i, b in enumerate(bs)]


def main_text(page: str | None, tree: Tree) -> str:
    """Main blocks of a page, joined by an empty line."""
    if not page:
        return ""
    bs = blocks(page)
    return "\n\n".join(b.text for b, f in zip(bs, features(bs)) if decide(tree, f))


def extract(pages: DataFrame, *, labelled: Sequence[Sequence[float]] = LABELLED) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages(page_id, url, html)``.

    A tree trained on ``labelled`` (a small table, as LABELLED) keeps the blocks that are main
    text. Character references are decoded, white space within a block becomes one space, blocks
    are joined by two line feeds. Null and empty pages, and those without main text, have an
    empty text. Rows are read one by one: repeats are extracted each, other columns aren't read,
    an empty table gives an empty result.
    """
    batches(pages.sparkSession)
    tree = train(labelled)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.drop(columns="html").assign(text=[main_text(h, tree) for h in pdf["html"]])

    rows = null_ids(pages.select(known_id("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string"), "page_id")
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
