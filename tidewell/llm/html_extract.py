"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with its path of block elements from the root.  Text length, punctuation and link
text are added up per path; their ratios to the number of blocks are fused to one score, which is smoothed over neighbouring
blocks.  Names are a prior only: below an element that by name, role or class is a menu, header, footer, sidebar, notice,
advert, form or list of reader comments a score counts LESS of itself, outside <article> and <main> OUTSIDE of itself.  This
decides where such text is as rich as the article's, and changes nothing where it holds for all blocks.  Blocks whose score
reaches the threshold are content.

The deepest element that holds most of the content, or the <article> or <main> around it, is the region.  In it, too, blocks
below the threshold go, unless they are on a path whose other blocks are content (short paragraphs), are items of a list or
table behind content, or a heading over it; none of these stay if they are mostly links or have an unwanted name.
All steps are linear in the page: elements are numbers with a parent, paths are interned, open elements are found by tag.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_rows

# Fixed names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag ends an open element of these names, up to one of the bounds.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Elements without text for readers, and those that are seldom part of an article.
UNSEEN = frozenset("head noscript template svg canvas object".split()) | RAW
DROPPED = frozenset("nav footer aside form button select dialog menu fieldset".split())
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*+=\s*+["']?true|style\s*+=\s*+["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
NAMES = frozenset(
    "ad ads adbox adsense adslot banner consent gdpr notice notices popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets footer "
    "toolbar share sharing sharebar social related recommended recommendations newsletter subscribe subscription signup login search disqus respond replies reply "
    "pagination pager hidden copyright disclaimer alert rail skip masthead topbar feedback discussion".split()
)
PREFIXES = ("advert", "sponsor", "cookie", "promo", "comment")
HEADER_NAMES = frozenset("header siteheader pageheader".split())
NOT_WORD = re.compile(r"[^a-z0-9]+")
ATTRIBUTE = re.compile(r"""(class|id|role)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++))?""", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def unwanted(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by its name, role, class or id; ``inside``: within an article or main element."""
    if name in DROPPED or name == "header" and not inside:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.lower() in ROLES:
            return True
        if key in ("class", "id"):
            for one in value.split():
                words = [w for w in NOT_WORD.split(CAMEL.sub("-", one).lower()) if w]
                # "has-sidebar", "no-ads" and the like tell of the page, not of the element
                if words and words[0] in ("has", "with", "no", "without", "is"):
                    continue
                if any(w in NAMES or w.startswith(PREFIXES) or w in HEADER_NAMES and not inside for w in words):
                    return True
    return False


#: What remains of a score below an element with an unwanted name, and of one outside <article> and <main>.
LESS, OUTSIDE = 0.1, 0.5
#: Share of the size-weighted mean score that a block needs.
THRESHOLD = 0.5
#: Share of the threshold that a path reaches without its neighbours.
OWN = 0.4
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd td th caption figcaption pre blockquote".split())
#: Elements that are parts of a text, never its region.
PARTS = HEADINGS | frozenset("p li td tr tbody blockquote pre ul ol".split())
MARKS = [f"{c} " for c in ",.;:!?"]
WIDE_MARKS = "、。，；：！？…"


@dataclass
class Block:
    element: int
    path: int
    prior: float
    parts: list[str] = field(default_factory=list)
    link: int = 0
    text: str = ""


class Page:
    """The blocks of a page in order; of each element (0 is the root) its tag, parent, path, prior, and if an article has it.

    Elements are numbered in page order, so a parent's number is below its children's.
    """

    def __init__(self, page: str) -> None:
        self.blocks: list[Block] = []
        self.tag, self.parent, self.path, self.prior, self.inside = [""], [-1], [0], [1.0], [False]
        self._paths: dict[tuple[int, str], int] = {}
        self._stack: list[int] = [0]
        self._open: dict[str, list[int]] = defaultdict(list)  # places in the stack of the open elements of a tag
        self._current: Block | None = None
        self._links = False
        self._read(page)

    def _flush(self) -> None:
        if (block := self._current) is not None:
            block.text = " ".join(html.unescape("".join(block.parts)).split())
            if block.text:
                self.blocks.append(block)
        self._current = None

    def _put(self, raw: str) -> None:
        top = self._stack[-1]
        if not self.prior[top]:
            return
        if self._current is None:
            if raw.isspace():
                return
            self._current = Block(top, self.path[top], self.prior[top] * (1 if self.inside[top] else OUTSIDE))
        self._current.parts.append(raw)
        if self._links:
            self._current.link += len(raw)

    def _close(self, upto: int) -> None:
        self._flush()
        while len(self._stack) > upto:
            self._open[self.tag[self._stack.pop()]].pop()

    def _last(self, names: Iterable[str]) -> int:
        """The topmost place of an open element of these tags, or -1."""
        return max((self._open[n][-1] for n in names if self._open[n]), default=-1)

    def _push(self, name: str, prior: float) -> None:
        top = self._stack[-1]
        self._open[name].append(len(self._stack))
        self._stack.append(len(self.tag))
        self.tag.append(name)
        self.parent.append(top)
        self.prior.append(min(prior, self.prior[top]))
        self.inside.append(self.inside[top] or name in ("article", "main"))
        self.path.append(self._paths.setdefault((self.path[top], name), len(self._paths) + 1))

    def _read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            to = page.find("<", at)
            if to < 0:
                to = end
            if to > at:
                self._put(page[at:to])
            if to >= end:
                break
            at = to
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = end if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?"), at):
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            elif (match := TAG.match(page, at) or LOOSE_TAG.match(page, at)) is None:
                self._put("<")
                at += 1
            else:
                at = self._element(page, match.end(), match[1], match[2].lower(), match[3])
        self._flush()

    def _element(self, page: str, at: int, closing: str, name: str, attributes: str) -> int:
        """Takes a tag that ends at ``at``; returns where to read on."""
        if name == "br":
            self._put(" ")
            return at
        prior = 1.0 if closing else prior_of(name, attributes, self.inside[self._stack[-1]])
        if name in INLINE and prior == 1:
            if name == "a":
                self._links = not closing
            if closing and self._open[name]:  # an inline element with a prior of its own
                self._close(self._open[name][-1])
            return at
        if closing:
            if self._open[name]:
                self._close(self._open[name][-1])
                self._links = False
            elif name == "p":
                self._flush()
            return at
        if name in VOID:
            if name not in INLINE:
                self._flush()
            return at
        self._flush()
        if name in CLOSES_P and (p := self._last(("p",))) > self._last(("td", "th", "button", "body", "html")):
            self._close(p)
        if name in ENDS:
            ended, bounds = ENDS[name]
            while (place := self._last(ended)) > self._last(bounds):
                self._close(place)
                if name not in ("tr", "tbody"):
                    break
        if name == "body" and self._open["head"]:
            self._close(self._open["head"][0])
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            return len(page) if stop is None else (page.find(">", stop.start()) + 1 or len(page))
        if not (attributes.endswith("/") and name in ("svg", "path")):
            self._push(name, prior)
        return at


def prior_of(name: str, attributes: str, inside: bool) -> float:
    """1, LESS for an unwanted name, 0 for what a reader doesn't see."""
    if name in UNSEEN or attributes and HIDDEN.search(attributes):
        return 0.0
    return LESS if unwanted(name, attributes, inside) else 1.0


def path_ratios(blocks: list[Block]) -> np.ndarray:
    """Of each block its path's text and punctuation a block, less the path's share of links."""
    _, of = np.unique([b.path for b in blocks], return_inverse=True)
    size = np.array([len(b.text) for b in blocks], float)
    marks = np.array([_marks(b.text) for b in blocks], float)
    link = np.minimum([b.link for b in blocks], size)
    text, mark, linked, count = (np.bincount(of, w) for w in (size, marks, link, np.ones(len(of))))
    return (np.sqrt(text / count * (mark + 0.5) / count) * (1 - linked / text))[of]


def scores(blocks: list[Block], priors: bool = True) -> np.ndarray:
    """Path ratios smoothed over neighbouring blocks, less each block's own share of links."""
    raw = path_ratios(blocks)
    if len(raw) >= 5:
        kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
        raw = np.convolve(raw, kernel, "same") / np.convolve(np.ones(len(raw)), kernel, "same")
    raw *= 1 - np.array([min(b.link, len(b.text)) / len(b.text) for b in blocks])
    return raw * [b.prior for b in blocks] if priors else raw


def _marks(text: str) -> int:
    """Punctuation before a blank or the end, or of wide scripts; dots within names don't count."""
    padded = f"{text} "
    return sum(map(padded.count, MARKS)) + sum(map(text.count, WIDE_MARKS))


def selected(page: Page, priors: bool = True) -> np.ndarray:
    """Which of the page's blocks are its article."""
    blocks = page.blocks
    if not blocks:
        return np.zeros(0, bool)
    size, score = np.array([len(b.text) for b in blocks], float), scores(blocks, priors)
    prior = np.array([b.prior if priors else 1.0 for b in blocks])
    least = THRESHOLD * float((score * size * prior).sum() / (size * prior).sum())
    content = score >= least
    # neighbours lift a score, so a path must be worth something by itself
    worth = content & (path_ratios(blocks) * prior >= OWN * least)
    content = worth if worth.any() else content
    held = np.zeros(len(page.tag))
    np.add.at(held, [b.element for b in blocks], np.where(content, size, 0.0))
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    # the deepest element with most of the content; numbers grow in page order, so the deepest is the largest
    root = int(np.flatnonzero(held >= 0.8 * held[0])[-1])
    while page.tag[root] in PARTS:
        root = page.parent[root]
    at = root
    while at > 0:
        if priors and page.tag[at] in ("article", "main"):
            root = at
        at = page.parent[at]
    inside = [e == root for e in range(len(held))]
    for e in range(root + 1, len(held)):
        inside[e] = inside[page.parent[e]]
    own = page.tag[root] not in ("", "html", "body")
    linked = np.array([2 * b.link > len(b.text) for b in blocks])
    # without an element of its own the region reaches from the first block of content to the last
    spread = np.flatnonzero(content)
    keep = np.array([inside[b.element] for b in blocks])
    out = keep & content
    plain = keep & ~linked & (prior == prior[content].max())
    if not own:
        out[: spread[0]] = out[spread[-1] + 1 :] = False
        plain[: spread[0]] = plain[spread[-1] + 1 :] = False
    tags = [page.tag[b.element] for b in blocks]
    short_of = {p for i, p in enumerate(b.path for b in blocks) if out[i]}  # a short line on a path whose other lines are content
    for i, b in enumerate(blocks):  # lists and tables go with what they follow
        if plain[i] and (b.path in short_of or tags[i] in ITEMS and i > 0 and out[i - 1]):
            out[i] = True
    for i in range(len(blocks) - 2, -1, -1):  # a heading goes with what it stands over
        if tags[i] in HEADINGS and keep[i] and prior[i] == prior[content].max() and out[i + 1]:
            out[i] = True
    return out


def main_text(page: str) -> str:
    """The article's text: blocks with white space folded, joined by one space; empty if there is none."""
    read = Page(page)
    return " ".join(b.text for b, s in zip(read.blocks, selected(read), strict=True) if s)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_kept (blocks of text, and those in the article) of every row.

    Null and empty html give an empty text, repeated rows equal ones; pages of any length and depth are read whole, in
    time that grows with their length; other columns are not read; an empty table gives no rows.
    """

    def fn(c: dict[str, list]) -> dict[str, list]:
        texts, found, kept = [], [], []
        for page in c["html"]:
            read = Page(page)
            chosen = selected(read)
            texts.append(" ".join(b.text for b, s in zip(read.blocks, chosen, strict=True) if s))
            found.append(len(chosen))
            kept.append(int(chosen.sum()))
        return {"page_id": c["page_id"], "url": c["url"], "text": texts, "n_blocks": found, "n_kept": kept}

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    made = map_rows(rows, fn, "page_id long, url string, text string, n_blocks long, n_kept long")
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks", "n_kept")
