"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks, the runs of text between block-level tags. A block's features are its number of words and
its link density, those of the blocks before and after and whether these are paragraphs, its zone (inside markup that is boilerplate by its element, plain, inside a
main part, inside an article), how far the names of the elements around it speak of boilerplate or of content, whether the page has an article at all, its
form (heading, paragraph, list item), and whether it speaks of rights or cookies. Names are shares from 0 to 1, never a verdict: of the class ``social-history`` one of two words is a boilerplate
word, and ``no-sidebar`` or ``with-ads`` say nothing of what is inside. The tree is trained on the small labelled table that ``training_pages``
writes by rule, and the blocks that it takes for content make up the text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import only

BOILER, PLAIN, MAIN, ARTICLE = -1, 0, 1, 2
OTHER, HEADING, PARAGRAPH, ITEM = 0, 1, 2, 3

# Fixed values of HTML: elements by how they are treated.
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "select", "button", "canvas", "audio", "video", "xmp", "noframes", "noembed")
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements without an end of their own in practice; they are not tracked as containers.
LOOSE = set("p li dt dd td th tr tbody thead tfoot h1 h2 h3 h4 h5 h6 html body hr caption legend summary".split())
BOILER_TAGS = set("nav footer aside menu dialog head fieldset label".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
BOILER_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox adslot sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice "
    "notices alert popup popover modal overlay newsletter subscribe subscription signup login register share sharing social related recommended "
    "recommendations comment comments commentlist disqus respond reply replies sidebar aside widget widgets menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager skip legal copyright disclaimer paywall teaser teasers search form hidden".split()
)
HEADER_NAMES = {"header"}
CONTENT_NAMES = set("content article post entry story main maincontent text articlebody body".split())
#: Words that say where or what shape something is, not what; they don't count.
SHAPES = set("wrap wrapper container box area block inner outer section list item items left right top bottom buttons button bar row col column site page the".split())
#: Words that make a name tell of a page's state, as in ``no-sidebar``: it says nothing of what is inside.
STATES = set("no not without has have with hide show is".split())
LEGAL = re.compile(r"©|\(c\) ?\d|copyright|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos|\bcookies?\b", re.IGNORECASE)

#: Of these, those whose content is read as the page's where their end is missing; browsers show it.
FLOW = ("svg", "math", "object", "select", "button")


@lru_cache(maxsize=None)
def _token(raw: tuple[str, ...]) -> re.Pattern:
    return re.compile(
        r"<!--.*?(?:-->|\Z)"
        r"|<(?P<empty>svg|math)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
        rf"|<(?P<raw>{'|'.join(raw)})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:(?P<close></(?P=raw)\s*>)|\Z)"
        r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
        r"|<[!?/][^>]*+(?:>|\Z)"
        r"|<[a-zA-Z][^>]*+(?:>|\Z)"
        r"|(?P<text>[^<]++|<)",
        re.DOTALL | re.IGNORECASE,
    )


def tokens(page: str) -> Iterator[re.Match]:
    """Matches in page order; from an unclosed element of FLOW on, those of its name are plain tags, as no end can follow."""
    at, raw = 0, RAW
    while at is not None:
        start, at = at, None
        for m in _token(raw).finditer(page, start):
            if m["raw"] and not m["close"] and m["raw"].lower() in FLOW:
                at, raw = m.start(), tuple(x for x in raw if x != m["raw"].lower())
                break
            yield m


ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

def names_of(value: str) -> list[list[str]]:
    """The lower-case words of each name of a class or id, as in ``post-content mainText``."""
    return [[x.lower() for x in NAME_PARTS.findall(name)] for name in value.split()]


def share_of(names: list[list[str]], known: set[str]) -> float:
    """The highest share of ``known`` words that a name has, names of states and words of shape left out."""
    best = 0.0
    for parts in names:
        if parts and parts[0] not in STATES:
            own = [x for x in parts if x not in SHAPES]
            best = max(best, sum(x in known for x in own) / len(own) if own else 0.0)
    return best


@lru_cache(maxsize=4096)
def _kind(tag: str, attrs: str) -> tuple[int | None, float, float, bool]:
    """(zone that an element gives its inside or None, share of boilerplate and of content in its names, is it a header)."""
    names, role = [], ""
    for key, value in ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return BOILER, 1.0, 0.0, False
        if key == "role":
            role = value.lower()
        elif key in ("class", "id"):
            names += names_of(value)
    bad, good = share_of(names, BOILER_NAMES), share_of(names, CONTENT_NAMES)
    head = tag == "header" or share_of(names, HEADER_NAMES) > 0
    if tag in ("html", "body"):
        return None, 0.0, 0.0, False
    if tag in BOILER_TAGS or role in BOILER_ROLES:
        return BOILER, bad, good, False
    if tag == "main" or role == "main":
        return MAIN, bad, good, False
    if tag == "article" or role == "article":
        return ARTICLE, bad, good, False
    # A form may be a whole page's: half a word.
    return None, max(bad, 0.5) if tag == "form" else bad, good, head


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    zone: int
    bad: float  # of the nearest element around it whose names say something
    good: float
    outer: float  # the highest such share of boilerplate of any other element around it
    form: int
    legal: bool


def _inside(state: tuple[int, float, float, float], tag: str, kind: tuple[int | None, float, float, bool]) -> tuple[int, float, float, float]:
    """(zone, bad, good, outer) inside an element, from those around it."""
    zone, bad, good, outer = state
    own, own_bad, own_good, head = kind
    if zone == BOILER or own == BOILER:
        return BOILER, max(bad, own_bad), good, outer
    if head and zone == PLAIN and good < 0.5:
        # A page's header; that of an article, or of something named like content, has its title.
        if tag == "header":
            return BOILER, bad, good, outer
        own_bad = max(own_bad, 1.0 / (1 + own_good) if own_good else 0.75)
    if own in (MAIN, ARTICLE):
        # What a whole main part lies in is the page's frame, whose names say less of it.
        outer = max(outer, bad) / (2 if own == MAIN else 1)
        return max(zone, own), own_bad, own_good, outer
    if own_bad or own_good:
        return zone, own_bad, own_good, max(outer, bad)
    return state


def blocks(page: str) -> list[Block]:
    """Each block with text, in page order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[int, float, float, float]]] = []
    state, links, form = (PLAIN, 0.0, 0.0, 0.0), 0, OTHER
    parts: list[str] = []
    linked: list[str] = []

    def close() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                n, own = text.count(" ") + 1, len(html.unescape("".join(linked)).split())
                out.append(Block(text, n, own, *state, form, LEGAL.search(text) is not None))
            parts.clear()
            linked.clear()

    for m in tokens(page):
        text = m["text"]
        if text is not None:
            parts.append(text)
            if links:
                linked.append(text)
            continue
        tag = m["tag"]
        if tag is None:
            if m["raw"] or m["empty"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["end"] else 1
            linked.append(" ")
        elif tag == "br":
            parts.append(" ")
            linked.append(" ")
        if tag not in BLOCKS:
            if tag not in VOID and not m["end"] and m["attrs"]:
                kind = _kind(tag, m["attrs"])
                if kind[0] == BOILER or kind[1] >= 0.75:  # a notice or an advert inside a line
                    close()
                    stack.append((tag, state))
                    state = _inside(state, tag, kind)
            elif m["end"] and any(t == tag for t, _ in stack[-1:]):
                close()
                state = stack.pop()[1]
            continue
        close()
        links = 0 if tag != "a" and not m["end"] and tag not in LOOSE else links
        form = OTHER if m["end"] else PARAGRAPH if tag == "p" else ITEM if tag == "li" else HEADING if len(tag) == 2 and tag[1].isdigit() else OTHER
        if m["end"]:
            if any(t == tag for t, _ in stack):
                while stack:
                    name, state = stack.pop()
                    if name == tag:
                        break
        elif tag not in LOOSE or m["attrs"] and _kind(tag, m["attrs"])[:3] != (None, 0.0, 0.0):
            if not m["attrs"].endswith("/"):
                if tag in LOOSE:  # an element such as p ends with the next of its name
                    while stack and stack[-1][0] in LOOSE:
                        state = stack.pop()[1]
                stack.append((tag, state))
                state = _inside(state, tag, _kind(tag, m["attrs"]))
        else:
            while stack and stack[-1][0] in LOOSE:
                state = stack.pop()[1]
    close()
    return out


FEATURES = (
    "words", "density", "words before", "density before", "words after", "density after", "zone", "bad names", "good names", "bad names outside",
    "page has article", "heading", "paragraph", "item", "paragraph before", "paragraph after", "legal",
)


def features(found: list[tuple]) -> np.ndarray:
    """A row of FEATURES per block; ``found`` has the fields of a block after its text."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    x = np.array(found, dtype=float)
    form, zone, good = x[:, 6], x[:, 2], x[:, 4]
    own = np.column_stack([x[:, 0], x[:, 1] / np.maximum(x[:, 0], 1)])
    facts = np.column_stack([own, form == PARAGRAPH])
    edge = np.zeros((1, 3))
    before, after = np.vstack([edge, facts[:-1]]), np.vstack([facts[1:], edge])
    article = np.full(len(x), float(((zone >= MAIN) | (zone == PLAIN) & (good >= 0.5)).any()))
    return np.column_stack([
        own, before[:, :2], after[:, :2], zone, x[:, 3], good, x[:, 5], article, form == HEADING, form == PARAGRAPH, form == ITEM, before[:, 2], after[:, 2], x[:, 7],
    ]).astype(float)


def training_pages(pages: int = 600, seed: int = 7) -> list[list[tuple]]:
    """The labelled table: invented pages, each a list of (words, linked, zone, bad, good, outer, form, legal, label) in page order.

    Every page has paragraphs long and short, and some of: menus, a title, lists, a linked sentence alone, adverts, notices, related links, comments,
    a form, a footer. A quarter of the pages has semantic elements, a quarter whole names, a quarter names of which a part speaks, and a
    quarter nothing but plain blocks.
    """
    rng = random.Random(seed)
    out = []
    for k in range(pages):
        style = k % 4  # 0 elements, 1 whole names, 2 names in part, 3 plain
        frame = rng.choice([0.0, 0.0, 0.34, 0.5])  # a wrapper of all of the page
        loose = rng.random() < 0.3  # paragraphs without an element of their own
        rows: list[tuple] = []

        def put(words: int, density: float, label: int, form: int = OTHER, legal: int = 0, good: float = 0.0, bad: float = 0.0, zone: int | None = None, outer: float = 0.0) -> None:
            place = zone if zone is not None else PLAIN
            rows.append((words, round(words * density), place, bad, good, max(outer, frame if bad or good or place > 0 else 0.0), form, legal, label))

        def boiler(words: int, density: float, form: int = OTHER, legal: int = 0) -> None:
            """Boilerplate outside the article."""
            if style == 0 and rng.random() < 0.8:
                put(words, density, 0, form, legal, zone=BOILER, bad=rng.choice([0.0, 0.5, 1.0]))
            elif style in (0, 1):
                put(words, density, 0, form, legal, bad=1.0, good=rng.choice([0.0, 0.0, 0.5]), outer=rng.choice([0.0, 0.0, 1.0]))
            elif style == 2:
                put(words, density, 0, form, legal, bad=rng.choice([0.5, 0.67, 1.0]) if words < 30 or density > 0.3 else rng.choice([0.75, 1.0]))
            else:
                put(words, density, 0, form, legal)

        zone = rng.choice([MAIN, ARTICLE, ARTICLE]) if style == 0 else PLAIN
        good = {0: rng.choice([0.0, 0.0, 1.0]), 1: rng.choice([1.0, 1.0, 0.5]), 2: rng.choice([1.0, 0.5, 0.5])}.get(style, 0.0)
        bad = rng.choice([0.0, 0.34, 0.5]) if style == 2 else 0.0
        whole_form = style == 3 and rng.random() < 0.15  # all of a page inside one form

        def article(words: int, density: float, form: int, label: int = 1) -> None:
            # A paragraph may speak of rights too; without any names only a long one tells.
            legal = int(rng.random() < 0.1 and form == PARAGRAPH and (style != 3 or words >= 25))
            put(words, density, label, form, legal, good=good, bad=0.5 if whole_form else bad, zone=zone)

        def inside(words: int, density: float, form: int = OTHER, legal: int = 0) -> None:
            """Boilerplate inside the article that its names tell."""
            if rng.random() < 0.5:
                put(words, density, 0, form, legal, bad=1.0, zone=zone)
            else:
                put(words, density, 0, form, legal, bad=rng.choice([0.0, 0.5]), good=rng.choice([0.0, 0.5, 1.0]), zone=zone, outer=1.0)

        if rng.random() < 0.7:
            if rng.random() < 0.5:
                boiler(rng.randint(1, 4), rng.choice([0.0, 1.0]), rng.choice([OTHER, HEADING]))
            for _ in range(rng.randint(2, 8)):
                boiler(rng.randint(1, 4), 1.0, rng.choice([OTHER, ITEM]))
        if rng.random() < 0.4:
            boiler(rng.randint(8, 30), rng.choice([0.0, 0.1, 0.2]), rng.choice([OTHER, PARAGRAPH]), 1)
        if rng.random() < 0.4 and style != 3:
            boiler(rng.randint(3, 14), rng.choice([0.0, 0.0, 1.0]))
        text = OTHER if loose else PARAGRAPH
        if rng.random() < 0.8:
            article(rng.randint(1, 14), 0.0, HEADING)
        for _ in range(rng.randint(1, 7)):
            what = rng.random()
            long = what < (0.75 if loose else 0.5)
            if long:
                article(rng.choice([rng.randint(14, 40), rng.randint(30, 180)]), rng.choice([0.0, 0.0, 0.05, 0.1, 0.25]), text)
            elif what < 0.78:
                article(rng.randint(1, 13) if not loose else rng.randint(8, 13), rng.choice([0.0, 0.0, 0.0, 0.3]), text)
            elif what < 0.84:
                near = lambda: rng.randint(4, 14) if not loose and rng.random() < 0.6 else rng.randint(20, 60)
                article(near(), 0.0, text)
                article(rng.randint(4, 14), 1.0, PARAGRAPH)  # a linked sentence alone
                article(near(), 0.0, text)
            elif what < 0.92:
                article(rng.randint(1, 7), 0.0, HEADING)
                article(rng.randint(16, 70), 0.0, text)
            else:
                for _ in range(rng.randint(2, 5)):
                    article(rng.randint(2, 20), rng.choice([0.0, 0.0, 0.2]), ITEM)
                article(rng.randint(16, 70), 0.0, text)
            if rng.random() < 0.1 and style != 3:
                inside(rng.randint(2, 14), rng.choice([0.0, 1.0]))
        if rng.random() < 0.6:  # related links in a row, a short line above them
            if style != 3:
                inside(rng.randint(1, 4), 0.0, rng.choice([OTHER, HEADING]))
            for _ in range(rng.randint(2, 6)):
                put(rng.randint(3, 12), 1.0, 0, rng.choice([OTHER, ITEM, PARAGRAPH]), good=good, bad=bad, zone=zone)
        if rng.random() < 0.4:
            for _ in range(rng.randint(2, 4)):
                put(rng.randint(1, 2), 1.0, 0, rng.choice([OTHER, ITEM]), good=good, bad=bad, zone=zone)
        if rng.random() < 0.5 and style != 3:
            for _ in range(rng.randint(1, 4)):
                inside(rng.randint(1, 4), 0.0)
                inside(rng.randint(3, 70), rng.choice([0.0, 0.0, 0.1]), PARAGRAPH)
        if rng.random() < 0.5 and style != 3:
            boiler(rng.randint(1, 3), 0.0, HEADING)
            for _ in range(rng.randint(1, 4)):
                boiler(rng.randint(5, 45), rng.choice([0.0, 0.3, 0.6, 1.0]), rng.choice([OTHER, PARAGRAPH, ITEM]))
        if rng.random() < 0.4:
            for _ in range(rng.randint(1, 3)):
                put(rng.randint(1, 4), 0.0, 0, bad=0.5 if style else 1.0, zone=BOILER)
        if rng.random() < 0.4:
            for _ in range(rng.randint(1, 3)):
                boiler(rng.randint(1, 4), 1.0, rng.choice([OTHER, ITEM]))
        if rng.random() < 0.6:
            boiler(rng.randint(3, 24), rng.choice([0.0, 0.0, 0.2, 0.5]), rng.choice([OTHER, PARAGRAPH]), 1)
        out.append(rows)
    return out + [_short_page(rng) for _ in range(pages // 5)]


def _short_page(rng: random.Random) -> list[tuple]:
    """A page that is a title at most, one or two paragraphs and then links: those are the article, however short the page, and a short line alone above links is a menu's."""
    style = rng.randrange(4)
    zone = rng.choice([MAIN, ARTICLE]) if style == 0 else PLAIN
    good = {0: rng.choice([0.0, 1.0]), 1: 1.0, 2: 0.5}.get(style, 0.0)
    form = rng.choice([PARAGRAPH, PARAGRAPH, OTHER])
    rows = []
    if rng.random() < 0.5:
        rows.append((rng.randint(1, 12), 0, zone, 0.0, good, 0.0, HEADING, 0, 1))
    for _ in range(rng.choice([1, 1, 2])):
        # Without an element or a name only some length tells an article's first paragraph from a line above a menu.
        rows.append((rng.randint(6 if style != 3 and form == PARAGRAPH else 14, 180), 0, zone, 0.0, good, 0.0, form, 0, 1))
    if zone != PLAIN and rng.random() < 0.3:  # lines of a word or two, and no link
        rows += [(rng.randint(1, 4), 0, zone, 0.0, good, 0.0, form, 0, 1) for _ in range(rng.randint(3, 8))]
        return rows if rng.random() < 0.5 else rows[-3:]
    for _ in range(rng.randint(2, 6)):
        words = rng.randint(1, 10)
        rows.append((words, words, zone, 0.0, good, 0.0, rng.choice([ITEM, ITEM, PARAGRAPH, OTHER]), 0, 0))
    if rng.random() < 0.5:
        rows.append((rng.randint(3, 24), 0, BOILER if style == 0 else PLAIN, float(style in (1, 2)), 0.0, 0.0, OTHER, 1, 0))
    return rows


class Tree:
    """A decision tree on Gini impurity; ties go to the first feature and the lowest cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4):
        self.nodes: list[tuple] = []
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        at, n = len(self.nodes), len(y)
        self.nodes.append((None, None, None, float(y.mean() >= 0.5)))
        best = (n * y.mean() * (1 - y.mean()) - 1e-9, None)
        if depth and 0 < y.mean() < 1:
            low = np.arange(1, n)
            for k in range(x.shape[1]):
                order = np.argsort(x[:, k], kind="stable")
                values, below = x[order, k], np.cumsum(y[order])[:-1]
                rest = below[-1] + y[order[-1]] - below
                cost = below * (1 - below / low) + rest * (1 - rest / (n - low))
                cost[(values[1:] == values[:-1]) | (low < least) | (n - low < least)] = np.inf
                i = int(cost.argmin())
                if cost[i] < best[0] - 1e-12:
                    best = (float(cost[i]), (k, float(values[i] + values[i + 1]) / 2))
        if best[1]:
            k, cut = best[1]
            low = x[:, k] <= cut
            left = self._grow(x[low], y[low], depth - 1, least)
            right = self._grow(x[~low], y[~low], depth - 1, least)
            self.nodes[at] = (k, cut, (left, right), self.nodes[at][3])
        return at

    def __call__(self, row) -> bool:
        at = 0
        while self.nodes[at][0] is not None:
            k, cut, below, _ = self.nodes[at]
            at = below[int(row[k] > cut)]
        return bool(self.nodes[at][3])


@lru_cache(maxsize=1)
def trained_tree() -> Tree:
    """The tree learned from the labelled table."""
    pages = training_pages()
    x = np.vstack([features([b[:-1] for b in page]) for page in pages])
    return Tree(x, np.array([b[-1] for page in pages for b in page], dtype=float))


def main_text(page: str, tree: Tree) -> str:
    """Content blocks of a page in order, joined by a line feed."""
    found = blocks(page)
    rows = features([b[1:] for b in found]).tolist()
    return "\n".join(b.text for b, row in zip(found, rows, strict=True) if tree(row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty pages give an empty text; broken and cut-off markup is read as far as it goes. Nothing is capped. Repeated rows
    are all kept; other columns play no part.
    """
    narrow = only(pages, page_id=id_col, url=url_col, html=html_col)
    schema = T.StructType([*narrow.schema.fields[:2], T.StructField("text", T.StringType())])
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                texts = pa.array([main_text(x.as_py() or "", tree) for x in some.column(2)], pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), texts], ["page_id", "url", "text"])

    return narrow.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
