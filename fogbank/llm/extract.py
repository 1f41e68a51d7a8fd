"""Main text of HTML pages (operator 13): flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks: the text between two block-level tags, with its number of words, how many of them are
links, whether it is a heading or a list item, and what its surroundings say (an article, or navigation, an advert,
comments, ...). The tree sees a block's own words and link density, those of the blocks before and after it, and these marks.
It is grown by Gini impurity on ``labelled.OUTLINES``, a small labelled table in the code.

Python only takes the markup apart, page by page inside mapInArrow, in lots of at most LOT_BYTES of HTML; the neighbours, the
tree and the joining of the kept blocks are expressions of Spark over the page's array of blocks. There is no shuffle. The
tokeniser is one linear pass over the page: unclosed comments, scripts and tags end with the page, an unclosed button or list
of options with the block around it, ends of elements that aren't open are ignored, and elements whose end is implied (p, li,
cells) are closed by their successors.

White space inside a block becomes one space, character references are decoded, br is white space. Null or empty pages have
an empty text; repeated rows stay repeated; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fogbank.llm import labelled
from fogbank.llm.common import lots

LOT_BYTES = 4 << 20
#: Growth of the tree stops at this depth and at leaves of this many blocks.
MAX_DEPTH, LEAST_LEAF = 8, 2

# Elements by what they do to the text.
RAW = "script style title textarea iframe noscript template xmp"
UNREAD = "svg math object select button canvas audio video datalist map applet"
BLOCKS = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
)
HEADINGS = "h1 h2 h3 h4 h5 h6"
#: An element of the first kind is closed by another one, up to the element that holds both.
IMPLIED = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tr": ("tr", "table")}
#: Elements, and words of class, id, role and itemprop, that say what their content is. LASTING: also for articles within.
ASIDE_TAGS, LASTING_TAGS, MAIN_TAGS = "form header fieldset legend", "nav aside footer dialog menu search", "article main"
ASIDE_WORDS = (
    "ad adbox ads adsbygoogle adsense adslot adunit advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies copyright "
    "dialog footer gdpr header hidden legal login masthead menu menus modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination "
    "popular popup privacy promo promotion promotions rail recommendations recommended related search share sharing sidebar signup skip social "
    "sponsor sponsored submenu subscribe subscription taboola toast toolbar topbar trending widget widgets"
)
LASTING_WORDS = "comment commentary comments commentlist discussion disqus replies reply respond responses"
MAIN_WORDS = "article articlebody content entry main maincontent post prose story"
#: A header of an article is part of it; "has-sidebar" is no sidebar.
OF_ARTICLES, NOT_THE_THING = "header", "has layout no with without"

SETS = {k: frozenset(v.split()) for k, v in {
    "unread": UNREAD, "blocks": BLOCKS, "headings": HEADINGS, "aside_tags": ASIDE_TAGS, "lasting_tags": LASTING_TAGS, "main_tags": MAIN_TAGS,
    "aside": ASIDE_WORDS, "lasting": LASTING_WORDS, "main": MAIN_WORDS, "neutral": NOT_THE_THING, "void": "hr",
}.items()}

TAG = re.compile(
    r"<!--(?:.*?-->|.*+)"
    r"|<(" + "|".join(RAW.split()) + r")(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</\1(?=[\s/>])[^>]*+>|.*+)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>?"
    r"|<[!?/][^>]*+>?",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|itemprop|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|$))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

NONE, MAIN, ASIDE, LASTING = 0, 1, 2, 3


@lru_cache(maxsize=4096)
def said(tag: str, attributes: str) -> tuple[int, bool]:
    """What an element says of its content, and whether it is only a header, which is part of an article."""
    named: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return LASTING, False
        if name not in ("style", "aria-hidden"):
            for one in value.split():
                tokens = {w.lower() for w in WORD.findall(one)}
                named |= set() if tokens & SETS["neutral"] else tokens
    if tag in SETS["lasting_tags"] or named & SETS["lasting"]:
        return LASTING, False
    unwanted = (named & SETS["aside"]) | ({tag} & SETS["aside_tags"])
    if unwanted and not (unwanted == {OF_ARTICLES} and named & SETS["main"]):
        return ASIDE, unwanted == {OF_ARTICLES}
    return (MAIN if tag in SETS["main_tags"] or named & SETS["main"] else NONE), False


class Page:
    """Takes one page apart into blocks: (text, words, linked words, place, heading, item)."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, int, int, int, int, int]] = []
        self.open: list[tuple[str, int]] = []  # block elements, and the place that holds inside each
        self.count: Counter[str] = Counter()
        self.pieces: list[tuple[str, bool]] = []
        self.linked = False
        self.unread: str | None = None  # the element whose text is being left out
        self.nested = 0

    def read(self, html: str) -> list[tuple[str, int, int, int, int, int]]:
        at = 0
        for m in TAG.finditer(html):
            if m.start() > at and not self.unread:
                self.pieces.append((html[at : m.start()], self.linked))
            at = m.end()
            end, tag, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
            if tag:
                self.tag(tag.lower(), bool(end), attributes or "")
        if at < len(html) and not self.unread:
            self.pieces.append((html[at:], self.linked))
        self.flush()
        return self.blocks

    def tag(self, tag: str, end: bool, attributes: str) -> None:
        if self.unread:
            self.nested += (tag == self.unread) * (-1 if end else 1)
            if not self.nested:
                self.unread = None
            if not (end and self.count[tag]):
                return
            self.unread = None  # a block around it ends
        if tag == "a":
            self.linked = not end
        elif tag in SETS["unread"] and not end and not attributes.rstrip().endswith("/"):
            self.unread, self.nested = tag, 1
        elif tag == "br":
            self.pieces.append((" ", self.linked))
        elif tag in SETS["blocks"]:
            self.flush()
            if end:
                self.linked = False
                if self.count[tag]:
                    self.close({tag}, frozenset())
                return
            if self.count["p"]:
                self.close({"p"}, frozenset())
            if tag in IMPLIED:
                closed, within = IMPLIED[tag]
                self.close(set(closed.split()), frozenset(within.split()))
            if tag not in SETS["void"]:
                self.open.append((tag, self.place_inside(tag, attributes)))
                self.count[tag] += 1

    def close(self, tags: set[str], stop: frozenset[str]) -> None:
        """Closes the innermost of tags, with all in it, unless one of stop is further in (or none is open)."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name in tags:
                for gone, _ in self.open[i:]:
                    self.count[gone] -= 1
                del self.open[i:]
                return
            if name in stop:
                return

    def place_inside(self, tag: str, attributes: str) -> int:
        outside = self.open[-1][1] if self.open else NONE
        if outside == LASTING or tag in ("html", "body"):
            return outside
        place, only_header = said(tag, attributes)
        if place == NONE or (only_header and outside == MAIN):
            return outside
        return place

    def flush(self) -> None:
        """The text since the last block-level tag becomes a block, if there is any."""
        if not self.pieces:
            return
        text = " ".join(entities.unescape("".join(p for p, _ in self.pieces)).split())
        if text:
            linked = sum(len(entities.unescape(p).split()) for p, link in self.pieces if link)
            words = text.count(" ") + 1
            tag, place = self.open[-1] if self.open else ("", NONE)
            self.blocks.append((text, words, min(words, linked), place, int(tag in SETS["headings"]), int(self.count["li"] > 0 or tag in ("dt", "dd"))))
        self.pieces.clear()


FIELDS = (("text", pa.string()), ("words", pa.int32()), ("linked", pa.int32()), ("place", pa.int32()), ("heading", pa.int32()), ("item", pa.int32()))
BLOCK_TYPE = "struct<text:string,words:int,linked:int,place:int,heading:int,item:int>"
FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "main", "aside", "heading", "item")


def text_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lot_bytes: int = LOT_BYTES) -> DataFrame:
    """page_id, url, blocks of each row of pages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in lots(batch, 2, lot_bytes):
                found = [Page().read(t) if t else [] for t in texts]
                flat = [b for blocks in found for b in blocks]
                columns = list(zip(*flat, strict=True)) or [()] * len(FIELDS)
                struct = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, struct)], ["page_id", "url", "blocks"]
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    read = pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    return read.mapInArrow(rows, f"page_id {kinds[0]}, url {kinds[1]}, blocks array<{BLOCK_TYPE}>")


@dataclass(frozen=True)
class Node:
    """A split (rows with feature <= bar go to low) or, without a feature, a leaf."""

    keep: bool
    feature: int | None = None
    bar: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH, least: int = LEAST_LEAF) -> Node:
    """A tree by greatest fall of the Gini impurity; of equal splits the first feature's lowest."""
    leaf = Node(bool(2 * y.sum() > len(y)))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return leaf
    best = (1e-9, None, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        gain = (len(y) * _gini(ones[-1], len(y)) - n * _gini(ones[:-1], n) - (len(y) - n) * _gini(ones[-1] - ones[:-1], len(y) - n)) / len(y)
        gain[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = 0
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-12:
            best = (gain[i], f, (v[i] + v[i + 1]) / 2)
    _, f, bar = best
    if f is None:
        return leaf
    low = x[:, f] <= bar
    return Node(leaf.keep, f, float(bar), grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def _gini(ones, n):
    p = ones / n
    return 2 * p * (1 - p)


def decide(node: Node, row) -> bool:
    while node.feature is not None:
        node = node.low if row[node.feature] <= node.bar else node.high
    return node.keep


def features_of(blocks: list[tuple[str, int, int, int, int, int]]) -> np.ndarray:
    """The tree's inputs for one page's blocks."""
    own = [(b[1], b[2] / b[1]) for b in blocks]
    around = [(0, 0.0), *own, (0, 0.0)]
    return np.array([[*around[i + 1], *around[i], *around[i + 2], b[3] == MAIN, b[3] >= ASIDE, b[4], b[5]] for i, b in enumerate(blocks)], dtype=float).reshape(-1, len(FEATURES))


@lru_cache(maxsize=1)
def fit() -> Node:
    """The tree of the labelled table."""
    x, y = [], []
    for page in labelled.pages():
        blocks = Page().read(page)
        x.append(features_of(blocks))
        y += [b[0].startswith(labelled.KEPT) for b in blocks]
    return grow(np.concatenate(x), np.array(y, dtype=int))


def kept(blocks: Column, tree: Node) -> Column:
    """The blocks that the tree keeps, in order."""

    def density(b: Column) -> Column:
        return b["linked"] / b["words"]

    def test(b: Column, i: Column) -> Column:
        before, after = F.when(i > 0, F.get(blocks, i - 1)), F.get(blocks, i + 1)
        values = dict(
            words=b["words"], density=density(b), words_before=F.coalesce(before["words"], F.lit(0)), density_before=F.coalesce(density(before), F.lit(0.0)),
            words_after=F.coalesce(after["words"], F.lit(0)), density_after=F.coalesce(density(after), F.lit(0.0)),
            main=F.when(b["place"] == MAIN, 1).otherwise(0), aside=F.when(b["place"] >= ASIDE, 1).otherwise(0), heading=b["heading"], item=b["item"],
        )
        walk = lambda node: F.lit(node.keep) if node.feature is None else F.when(values[FEATURES[node.feature]] <= node.bar, walk(node.low)).otherwise(walk(node.high))
        return walk(tree)

    return F.filter(blocks, test)


def main_text(pages: DataFrame, tree: Node | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text: the kept blocks of each page, joined by line ends."""
    cut = text_blocks(pages, id_col, url_col, html_col)
    texts = F.transform(kept(F.col("blocks"), tree or fit()), lambda b: b["text"])
    return cut.select("page_id", "url", F.array_join(texts, "\n").alias("text"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


#: What the pages of the given tables should give: all of them hold their text in one article.
OP13_SQL = r"""WITH body AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS inner_html FROM pages),
parts AS (
  SELECT page_id, url, regexp_split_to_array(regexp_replace(inner_html, '<br>|</?b>', ' ', 'g'), '</?(?:h1|p)>') AS cut FROM body),
decoded AS (
  SELECT page_id, url, list_transform(cut, lambda x: trim(regexp_replace(
    replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS blocks FROM parts),
joined AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10)) AS text FROM decoded)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined"""
