"""Main text of web pages by a conditional random field over the blocks of the page.

A page is cut into leaf blocks: runs of text between block-level tags, with the tags,
classes, ids and roles of their ancestors.  A linear-chain field labels each block
main text or not from these, from the block's text, its neighbours' and its place;
Viterbi decoding keeps runs together.

The field is fitted on the labelled pages of ``labelled_pages``, some twenty makes of
site with their main text marked by hand, and on nothing of the table that it is
applied to: every page of every table gets the same model.

Malformed markup never fails: an unclosed comment, tag or declaration ends with the page
and gives no text, a bogus declaration is a comment, and a stray ``<`` is text.  Hidden
elements give no text.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import labelled_pages
from graphloom.llm.crf import ChainCRF

PAGES_PER_MAKE = 10

# Tag names by role in a page, and words that mark containers in class, id and role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template head title textarea select svg math iframe object canvas audio video".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - {"br", "button", "label", "option"}
MARKS = {
    "content": "content article post story entry main body text prose".split(),
    "comment": "comment comments reply replies respond disqus discussion feedback".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo banner promoted".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs links".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup privacy".split(),
    "edge": "header footer masthead copyright legal colophon topbar bottom site-header site-footer".split(),
    "side": "sidebar side aside widget related recommended trending share sharing social tags author-box".split(),
}
_MARK_OF = {word: kind for kind, words in MARKS.items() for word in words}
#: Elements whose content is raw text up to their end tag.
RAW_TAGS = frozenset("script style title textarea iframe xmp noembed noframes".split())
TAG_FEATURES = "article main section nav header footer aside form ul ol table div blockquote figure a button label".split()
LEAF_FEATURES = "p div li h1 h2 h3 td a span label button blockquote pre".split()


class Block:
    """Text of one leaf block and what stands around it."""

    __slots__ = ("text", "tags", "marks", "leaf", "linked", "main")

    def __init__(self, text: str, tags: frozenset, marks: frozenset, leaf: str, linked: int, main: bool = False):
        self.text, self.tags, self.marks, self.leaf, self.linked, self.main = text, tags, marks, leaf, linked, main


_MARKUP = re.compile(
    r"<!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))"  # a comment, up to the end of the page if need be
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|(?<==)\"[^\"]*\"|(?<==)'[^']*'|(?<==\s)\"[^\"]*\"|(?<==\s)'[^']*'|[\"'])*?)(?P<close>>|\Z)"
    r"|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|\Z)",  # any other declaration is a comment
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(k.lower(), references.unescape(a or b or c)) for k, a, b, c in _ATTR.findall(text)]


@functools.cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


class _Blocks:
    """The blocks of one page, with what is open kept as counts and places, so that a tag or block costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, frozenset, bool]] = []
        self.open: Counter[str] = Counter()
        self.marks: Counter[str] = Counter()
        #: Places in the stack, ascending: of block tags, of paragraphs, of what a paragraph's end is not sought beyond, of heads.
        self.leaves: list[int] = []
        self.paragraphs: list[int] = []
        self.walls: list[int] = []
        self.heads: list[int] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = 0
        self.silent = 0
        self.main = False

    def feed(self, page: str) -> None:
        at = 0
        while at < len(page):
            m = _MARKUP.search(page, at)
            if m is None:
                self.handle_data(page[at:])
                return
            if m.start() > at:
                self.handle_data(page[at : m.start()])
            at = m.end()
            if m.group("comment") in ("main", "/main"):  # only labelled pages have these
                self.flush()
                self.main = m.group("comment") == "main"
            tag = m.group("tag")
            if tag is None or not m.group("close"):
                continue
            tag = tag.lower()
            if m.group("end"):
                self.handle_endtag(tag)
                continue
            self.handle_starttag(tag, _attributes(m.group("attrs")) if m.group("attrs") else [])
            if tag in RAW_TAGS:  # its text is silent; the end tag comes next
                stop = _raw_end(tag).search(page, at)
                at = stop.start() if stop else len(page)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            tags = frozenset(t for t in TAG_FEATURES if self.open[t])
            marks = frozenset(m for m in MARKS if self.marks[m])
            leaf = self.stack[self.leaves[-1]][0] if self.leaves else "body"
            self.blocks.append(Block(text, tags, marks, leaf, min(self.linked, len(text)), self.main))
        self.parts, self.linked = [], 0

    def push(self, tag: str, marks: frozenset, silent: bool) -> None:
        at = len(self.stack)
        for places, kept in ((self.leaves, tag in BLOCK_TAGS), (self.paragraphs, tag == "p"), (self.walls, tag in CLOSES_P and tag not in ("p", "li")), (self.heads, tag == "head")):
            if kept:
                places.append(at)
        self.stack.append((tag, marks, silent))
        self.open[tag] += 1
        self.marks.update(marks)
        self.silent += silent

    def pop_to(self, at: int) -> None:
        for tag, marks, silent in self.stack[at:]:
            self.silent -= silent
            self.open[tag] -= 1
            self.marks.subtract(marks)
        del self.stack[at:]
        for places in (self.leaves, self.paragraphs, self.walls, self.heads):
            while places and places[-1] >= at:
                places.pop()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        # the head's end tag may be left out: body ends it, and so does a block that is in no other silent tag
        if tag == "body" or (tag in BLOCK_TAGS and self.silent == 1):
            if self.heads:
                self.pop_to(self.heads[0])
        if tag in BLOCK_TAGS:
            self.flush()
            if tag in CLOSES_P:  # an open paragraph, with all that was left open in it, ends here
                if self.paragraphs and (not self.walls or self.paragraphs[-1] > self.walls[-1]):
                    self.pop_to(self.paragraphs[-1])
            if tag == "li" and self.stack and self.stack[-1][0] == "li":
                self.pop_to(len(self.stack) - 1)
        if tag in VOID_TAGS:
            return
        named = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v).lower()
        words = re.split(r"[\s_]+|(?<=[a-z])-(?=[a-z])", named) + named.split() if named else []
        hidden = any(k == "hidden" or (k == "style" and _HIDING.search(v)) for k, v in attrs)
        if hidden and tag not in BLOCK_TAGS and not self.parts:
            self.flush()
        self.push(tag, frozenset(_MARK_OF[w] for w in words if w in _MARK_OF), tag in SILENT_TAGS or hidden)

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCK_TAGS or any(t in BLOCK_TAGS for t, _, _ in self.stack[i:]):
                    self.flush()
                self.pop_to(i)
                return

    def handle_data(self, data: str) -> None:
        if not self.silent:
            data = references.unescape(data)
            self.parts.append(data)
            if any(t == "a" for t, _, _ in self.stack[-4:]):
                self.linked += len(data)


def page_blocks(html: str | None) -> list[Block]:
    """Leaf blocks of a page in page order; none for null, empty or text-free markup."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.flush()
    return parser.blocks


def block_features(blocks: list[Block]) -> np.ndarray:
    """One row of numbers per block."""
    rows = []
    shape = [(np.log1p(len(b.text)), b.linked / len(b.text)) for b in blocks]
    around = [(0.0, 0.0), *shape, (0.0, 0.0)]
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        rows.append(
            [t in b.tags for t in TAG_FEATURES]
            + [m in b.marks for m in MARKS]
            + [b.leaf == t for t in LEAF_FEATURES]
            + [
                shape[i][0], np.log1p(words), shape[i][1], b.text[-1] in ".!?", "©" in b.text, n < 25, n > 200,
                i == 0, i == len(blocks) - 1, i / len(blocks), *around[i], *around[i + 2],
            ]
        )
    return np.array(rows, dtype=np.float64)


def fit(makes: list[str] | None = None, each: int = PAGES_PER_MAKE) -> ChainCRF:
    """The field fitted on ``each`` labelled pages of every make, or of those named."""
    pages = [page_blocks(page) for page in labelled_pages.rendered(makes, each)]
    x = np.vstack([block_features(blocks) for blocks in pages])
    y = np.array([int(b.main) for blocks in pages for b in blocks])
    return ChainCRF(2, l2=1e-4, steps=200).fit(x, y, np.array([len(blocks) for blocks in pages]))


def agreement(model: ChainCRF, makes: list[str], each: int = PAGES_PER_MAKE) -> tuple[float, float]:
    """Precision and recall, in characters, of a field on labelled pages of some makes."""
    kept = right = wanted = 0
    for page in labelled_pages.rendered(makes, each):
        blocks = page_blocks(page)
        for b, label in zip(blocks, model.decode(block_features(blocks), np.array([len(blocks)])).tolist(), strict=True):
            kept, wanted, right = kept + label * len(b.text), wanted + b.main * len(b.text), right + (label and b.main) * len(b.text)
    return right / max(1, kept), right / max(1, wanted)


def _extracted(model: ChainCRF):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pages = [page_blocks(h) for h in part.column("html").to_pylist()]
                full = [p for p in pages if p]
                x = np.vstack([block_features(p) for p in full]) if full else np.zeros((0, 1))
                kept = iter(model.decode(x, np.array([len(p) for p in full], dtype=np.int64)).tolist())
                texts = [" ".join(b.text for b in p if next(kept)) for p in pages]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return run


def extract(pages: DataFrame, model: ChainCRF) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``page_id, url, html``.

    A null or empty page, one without text and one without main text give an empty
    text.  Repeated rows give equal results; other columns are ignored; an empty table
    gives an empty result.
    """
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extracted(model), "page_id long, url string, text string, n_chars long")
