"""The main text of a page as the best-scoring run of its words and tags.

A page is a sequence of words and tags. Words score above zero and tags below, both with weights
learned from labelled pages: pages whose <article> marks the content. How often words under a
block tag are content gives the words' weight, how often a tag stands in the content its cost. The
contiguous run with the largest sum, found in one linear scan, is the content region. Elements that
are never text (scripts, forms, menus, ...) or that call themselves an advert, a notice, a sidebar
or a comment score nothing and are left out of it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemlab.llm.common import draw

LABELLED_PAGES = 500
SEED = 9
LEAST_TAG_COST = 0.02
MOST_WEIGHT = 4.0

RAW = "script|style|noscript|template|textarea|svg|math|iframe|title|select|object|canvas|audio|video"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*(?:(?<=/)>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[/!?a-zA-Z][^<>]*+(?:>|\Z)""",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav header footer aside form menu dialog button fieldset label head".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar "
    "comment comments disqus replies respond cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup share sharing social related recommended breadcrumb breadcrumbs pagination "
    "pager menu nav navbar navigation footer header masthead toolbar widget login search copyright skip "
    "complementary contentinfo navigation search".split()
)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
NAME_PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Names of wrappers that say what stands beside the text.
LAYOUT = re.compile(r"\b(?:has|with|no|without)[-_][a-z]+")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
#: Parts of a name that say nothing about what the element holds.
BOXES = frozenset(
    "area bar block body box button buttons card container content entry form group inner item items link links list outer "
    "panel post posts row section site slot text title top unit wrap wrapper".split()
)
READERS = frozenset("comment comments disqus replies reply".split())


def _names(attributes: str) -> Iterator[tuple[list[str], bool]]:
    """The parts of each name that an element has, and whether the name is a class."""
    for found in ATTRIBUTE.finditer(attributes):
        value = LAYOUT.sub("", CAMEL.sub("-", found[2] or found[3] or found[4] or "").lower())
        is_class = found[1].lower() == "class"
        for name in value.split() if is_class else [value]:
            yield NAME_PARTS.findall(name), is_class


def _called(parts: list[str], words: frozenset[str]) -> bool:
    """Whether a name has one of the words and no part beside them that means something else."""
    return not words.isdisjoint(parts) and all(p in words or p in CLUTTER or p in BOXES for p in parts)


def _clutter(attributes: str, name: str = "", marked: bool = False) -> bool:
    """Whether an element's names say that it is no content.

    Outside the marked region one word of the list is enough. Inside it the whole name must say
    so (`ad-box`, not `social-history`), and headings are content. An article has to be called a
    reader's comment; one inside the marked region also goes if all its classes are clutter.
    """
    if HIDDEN.search(attributes):
        return True
    if name == "article":
        found = list(_names(attributes))
        classes = [parts for parts, is_class in found if is_class]
        if any(_called(parts, READERS) for parts, _ in found):
            return True
        return marked and bool(classes) and all(_called(parts, CLUTTER) for parts in classes)
    if not marked:
        return any(not CLUTTER.isdisjoint(parts) for parts, _ in _names(attributes))
    return name not in HEADINGS and any(_called(parts, CLUTTER) for parts, _ in _names(attributes))


class Piece:
    """A text between tags or a tag: what it is, under which block, whether it may be content."""

    __slots__ = ("kind", "name", "text", "left_out", "cluttered", "marked")

    def __init__(self, kind: str, name: str, text: str, left_out: int, cluttered: int, marked: int) -> None:
        self.kind, self.name, self.text = kind, name, text
        self.left_out, self.cluttered, self.marked = left_out > 0, cluttered > 0, marked > 0


class Open:
    """The open elements of a page: counts beside the stack, so that a step never walks through it."""

    def __init__(self) -> None:
        # Elements, and how they are left out: 0 not, 1 by what they are, 2 by what they are called.
        self.stack: list[tuple[str, int]] = []
        self.blocks: list[str] = []
        self.named: Counter = Counter()
        self.left_out = self.cluttered = self.marked = 0

    def push(self, name: str, out: int) -> None:
        self.stack.append((name, out))
        self._count(name, out, 1)
        if name not in INLINE:
            self.blocks.append(name)

    def pop(self) -> str:
        name, out = self.stack.pop()
        self._count(name, out, -1)
        if name not in INLINE:
            self.blocks.pop()
        return name

    def _count(self, name: str, out: int, by: int) -> None:
        self.named[name] += by
        self.left_out += by * (out > 0)
        self.cluttered += by * (out > 1)
        self.marked += by * (name in CONTENT)

    def close(self, name: str) -> None:
        """The end tag of `name` closes all that is open inside it; without a start it says nothing."""
        if self.named[name]:
            while self.pop() != name:
                pass

    def piece(self, kind: str, name: str, text: str = "") -> Piece:
        return Piece(kind, name, text, self.left_out, self.cluttered, self.marked)

    def text(self, text: str) -> Piece:
        return self.piece("text", self.blocks[-1] if self.blocks else "body", text)


def pieces(page: str) -> Iterator[Piece]:
    """The page's pieces. An <article> or <main> ends what was left open before it.

    The work grows with the length of the page, whatever is left open: each element is opened and
    closed once.
    """
    open_ = Open()
    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            yield open_.text(page[at : found.start()])
        at = found.end()
        if not found[3]:
            continue
        name, closing = found[3].lower(), bool(found[2])
        if closing:
            yield open_.piece("tag", name)
            open_.close(name)
        elif name not in VOID and not found[4].endswith("/"):
            inside = open_.marked
            if name in CONTENT and not inside:
                open_ = Open()
            elif name == "p" or name in HEADINGS or name == "li":
                # These end a paragraph or item that was left open.
                while open_.stack and (open_.stack[-1][0] in INLINE or open_.stack[-1][0] in ("p", name)):
                    open_.pop()
            never = name in NEVER and not (name == "header" and open_.marked)
            known = name not in ("html", "body", "main") and _clutter(found[4], name, open_.marked > 0)
            open_.push(name, 1 if never else 2 * known)
            yield Piece("tag", name, "", open_.left_out, open_.cluttered, inside)
        else:
            yield open_.piece("tag", name)
    if at < len(page):
        yield open_.text(page[at:])


def page_counts(page: str | None) -> Counter:
    """(kind, name, in the content) -> how many; empty for a page without marked content.

    What calls itself clutter says nothing about the tags that it is made of.
    """
    counts: Counter = Counter()
    for piece in pieces(page or ""):
        if piece.cluttered:
            continue
        n = 1 if piece.kind == "tag" else len(piece.text.split())
        counts[piece.kind, piece.name, piece.marked and not piece.left_out] += n
    return counts if any(inside for *_, inside in counts) else Counter()


def learn_weights(pages: DataFrame, id: str = "page_id", page: str = "html", most: int = LABELLED_PAGES) -> dict[tuple[str, str], float]:
    """Weights from at most `most` labelled pages, chosen by hash so that reruns agree."""
    labelled = pages.where(F.lower(F.col(page)).contains("<article") | F.lower(F.col(page)).contains("<main"))
    drawn = labelled.select(F.col(page).alias("page"), draw(SEED, F.col(id), F.col(page)).alias("_draw"))
    n = labelled.count()
    # A little more than is kept, so that the sort sees few pages however many there are.
    share = min(1.0, (2 * most + 20) / n) if n else 1.0
    sample = drawn.where(F.col("_draw") <= share * 2.0**62).orderBy("_draw").limit(most).drop("_draw")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for text in batch["page"]:
                total.update(page_counts(text))
            rows = [(*key, n) for key, n in total.items()]
            yield pd.DataFrame(rows, columns=["kind", "name", "inside", "n"]).astype({"n": "int64", "inside": "bool"})

    shape = "kind string, name string, inside boolean, n long"
    found = sample.mapInPandas(count, shape).groupBy("kind", "name", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_from({(r["kind"], r["name"], r["inside"]): r["n"] for r in found})


def weights_from(counts: dict[tuple[str, str, bool], int]) -> dict[tuple[str, str], float]:
    """A word scores the log odds of being content under its block, a tag minus at least a little."""
    weights = {}
    for kind, name in {(kind, name) for kind, name, _ in counts}:
        inside, outside = counts.get((kind, name, True), 0), counts.get((kind, name, False), 0)
        odds = math.log((inside + 0.5) / (outside + 0.5))
        odds = max(-MOST_WEIGHT, min(MOST_WEIGHT, odds))
        weights[kind, name] = odds / MOST_WEIGHT if kind == "text" else min(-LEAST_TAG_COST, odds / MOST_WEIGHT)
    return weights


#: For what no labelled page had: words are text and tags are rather not.
UNSEEN = {"text": 0.5, "tag": -0.1}


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous run with the largest sum, as [start, stop); empty if no score is above 0."""
    best = total = 0.0
    start = stop = since = 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, since = 0.0, i
        total += score
        if total > best:
            best, start, stop = total, since, i + 1
    return start, stop


def main_text(page: str | None, weights: dict[tuple[str, str], float]) -> str:
    """Blocks of the best region in page order, joined by one space."""
    found = list(pieces(page or ""))
    scores = []
    for piece in found:
        weight = weights.get((piece.kind, piece.name), UNSEEN[piece.kind])
        if piece.kind == "text":
            weight *= len(piece.text.split())
        scores.append(0.0 if piece.left_out else weight)
    start, stop = best_run(np.array(scores))
    blocks, block = [], []
    for piece in found[start:stop]:
        if piece.kind == "text":
            if not piece.left_out:
                block.append(html.unescape(piece.text))
        elif piece.name not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    return " ".join(" ".join(blocks).split())


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", most: int = LABELLED_PAGES) -> DataFrame:
    """(id, url, text, n_chars) for every page.

    NULL html counts as empty and gives an empty text. Repeated rows are all returned; other
    columns are not read, whatever their names. An empty table gives an empty one. Without
    labelled pages the weights for unseen tags are used. Very long pages are read whole, in time
    that grows with their length. Of runs with equal sums the first is taken.
    """
    weights = learn_weights(pages, id, page, most)
    rows = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"))
    kind = rows.schema["id"].dataType.simpleString()

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch["page"]]
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pd.DataFrame({"id": batch["id"], "url": batch["url"], "text": texts, "n_chars": sizes})

    return rows.mapInPandas(take, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id)
