"""Main text of web pages: flat text blocks, told by a decision tree from their words, links and neighbours.

A page is cut into blocks at tags that break the line. Of each block count the number of words, the share of them in links
(link density), both of the block before and after, whether the block is a paragraph or a heading, and what stands around
it: an article or main part, or a part whose tag, class, id or role names a menu, footer, sidebar, notice, advert, comment
or the like. A CART tree learned from `html_labels` (some three hundred labelled blocks; a fixed table, read whole) decides.

Scripts, styles, comments of the markup, form controls and hidden parts never make blocks. `<br>` is white space. Tags that
aren't closed end with what is around them; a script or a comment that isn't closed takes the rest of the page; a tag cut off
at the end is dropped. Character references are decoded once. Null html counts as empty, null ids and addresses are
returned as they are, repeated rows are rows of their own, other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gramwise.llm.common import slices
from gramwise.llm.html_labels import PAGES

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
#: Tags whose content is text up to their end tag; nothing of it is shown, or it is a control's.
RAW = frozenset(("script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp", "template"))
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Content that isn't text of the page.
SKIPPED = frozenset(("head", "svg", "math", "object", "canvas", "video", "audio", "select", "button", "datalist", "label", "map", "progress", "meter"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Those of them that hold others and end where they are closed.
PARTS = BLOCKS - frozenset("body html hr p li dd dt option td th tr tbody thead tfoot".split()) | SKIPPED
HEADINGS, PARAGRAPHS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6")), frozenset(("p", "blockquote", "pre"))
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content main post entry story".split())
BESIDE_TAGS = frozenset(("nav", "footer", "aside", "menu", "dialog", "dir"))
#: A form around an article is no form of it; a header within an article is the article's.
FORM_TAGS, HEADER_NAMES = frozenset(("form", "fieldset")), frozenset(("header", "masthead"))
BESIDE_NAMES = frozenset(
    "ad ads adv advert advertisement adverts adsense banner bookmark breadcrumb breadcrumbs byline captcha comment commentlist comments complementary consent contentinfo cookie cookies copyright dialog disclaimer discussion donate footer gdpr latest legal login menu modal nav navbar navigation newsletter notice overlay paginate pager pagination paywall popular popup privacy promo promoted promotion recommended register related reply replies respond search share sharebar sharing shoutbox sidebar signin signup skip social sponsor sponsored subscribe survey tagcloud teaser toolbar topbar trending widget".split()
)
NAMES = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
LETTERS = re.compile(r"[a-zA-Z]+")


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    kind: int  # 2 a paragraph, 1 a heading, else 0
    main: bool
    beside: bool


class Part(NamedTuple):
    tag: str
    main: bool
    beside: bool
    form: bool
    skipped: bool


@lru_cache(1 << 12)
def _named(attributes: str) -> tuple[frozenset[str], bool]:
    """The words of a tag's class, id and role, and whether it is hidden."""
    words, hidden = set(), False
    for name, *values in NAMES.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name == "style":
            hidden |= bool(HIDDEN.search(value))
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        else:
            words.update(x.lower() for pattern in (PIECES, LETTERS) for x in pattern.findall(unescape(value)))
    return frozenset(words), hidden


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack = [Part("", False, False, False, False)]
    texts: list[tuple[str, bool]] = []
    link, kind, at = False, 0, 0

    def end() -> None:
        """The block ends here, with what stands around it."""
        if texts:
            text = " ".join("".join(t for t, _ in texts).split())
            if text:
                top = stack[-1]
                linked = sum(len(t.split()) for t, in_link in texts if in_link)
                out.append(Block(text, len(text.split()), linked, kind, top.main, top.beside or top.form))
            texts.clear()

    def said(raw: str) -> None:
        if raw and not stack[-1].skipped:
            texts.append((unescape(raw) if "&" in raw else raw, link))

    while found := TOKEN.search(page, at):
        said(page[at : found.start()])
        at = found.end()
        closing, tag, attributes, closed = found.groups()
        if tag is None:
            continue
        if not closed:  # cut off at the end of the page
            break
        tag = tag.lower()
        if tag in RAW and not closing:
            last = RAW_END[tag].search(page, at)
            at = last.end() if last else len(page)
            continue
        if tag == "br":
            said(" ")
        elif tag == "a":
            link = not closing
        if tag not in BLOCKS and tag not in PARTS:
            continue
        if tag in BLOCKS:
            end()
            kind = 0 if closing else 1 if tag in HEADINGS else 2 if tag in PARAGRAPHS else 0
        if tag not in PARTS:
            continue
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
        elif not attributes.endswith("/") or tag not in SKIPPED:
            top, (names, hidden) = stack[-1], _named(attributes) if attributes else (frozenset(), False)
            own_main = tag in MAIN_TAGS
            beside = top.beside or tag in BESIDE_TAGS or bool(names & BESIDE_NAMES) or not top.main and (tag == "header" or bool(names & HEADER_NAMES))
            form = tag in FORM_TAGS or top.form and not own_main
            stack.append(Part(tag, top.main or own_main or bool(names & MAIN_NAMES), beside, form, top.skipped or hidden or tag in SKIPPED))
    else:
        said(page[at:])
    end()
    return out


#: words, link density, those of the block before and after, paragraph or heading, main part, part beside it.
def features(page: list[Block]) -> np.ndarray:
    words = np.array([0, *(b.words for b in page), 0], float)
    linked = np.array([0, *(b.linked for b in page), 0], float)
    density = np.minimum(linked / np.maximum(words, 1), 1)
    n = len(page)
    rest = np.array([(b.kind, b.main, b.beside) for b in page], float).reshape(n, 3)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], rest])


class Node(NamedTuple):
    feature: int  # -1: a leaf
    most: float  # up to this to the left
    left: int
    right: int
    keep: bool


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> list[Node]:
    """A CART tree: splits by the least Gini impurity, the first of equals, halfway between values, until leaves are pure."""
    nodes: list[Node] = []

    def impure(k: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = k / np.maximum(n, 1)
        return n * 2 * p * (1 - p)

    def add(rows: np.ndarray, left_depth: int) -> int:
        here = len(nodes)
        own, total = y[rows], len(rows)
        nodes.append(Node(-1, 0.0, 0, 0, bool(own.sum() * 2 > total)))
        if left_depth == 0 or own.all() or not own.any():
            return here
        best = (np.inf, -1, 0.0)
        for f in range(x.shape[1]):
            values = np.unique(x[rows, f])
            for most in (values[:-1] + values[1:]) / 2:
                low = x[rows, f] <= most
                cost = float(impure(own[low].sum(), low.sum()) + impure(own[~low].sum(), (~low).sum()))
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(most))
        if best[1] < 0:
            return here
        low = x[rows, best[1]] <= best[2]
        left, right = add(rows[low], left_depth - 1), add(rows[~low], left_depth - 1)
        nodes[here] = nodes[here]._replace(feature=best[1], most=best[2], left=left, right=right)
        return here

    add(np.arange(len(y)), depth)
    return nodes


def kept(nodes: list[Node], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), int)
    feature, most, left, right, keep = (np.array(c) for c in zip(*nodes, strict=True))
    while (inner := np.flatnonzero(feature[at] >= 0)).size:
        now = at[inner]
        at[inner] = np.where(x[inner, feature[now]] <= most[now], left[now], right[now])
    return keep[at]


@lru_cache(1)
def learned() -> tuple[Node, ...]:
    """The tree of the labelled table."""
    xs, ys = [], []
    for page in PAGES:
        found, labels, before, html = [], [], 0, ""
        for piece, label in page:
            html += piece
            found = blocks(html)
            labels += [label] * (len(found) - before)
            before = len(found)
        xs.append(features(found))
        ys.append(np.array(labels, bool))
    return tuple(grow(np.concatenate(xs), np.concatenate(ys)))


def main_text(page: str, nodes: tuple[Node, ...]) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = kept(nodes, features(found))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, its blocks in page order joined by an empty line."""
    nodes = learned()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x or "", nodes) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(*[F.col(f"`{c}`").alias(c) for c in ("page_id", "url", "html")])
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
