"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks of text at block-level tags. Each block is described by its own number
of words and link density, by those of the blocks before and after it, by the kind of its element and
by where it stands. A decision tree says which blocks are main text. It is trained on the blocks
of some small pages that are labelled block by block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearsay.llm.frames import slices

#: Tags that end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "iframe legend li link main menu meta nav noscript ol optgroup option p pre search section "
    "select summary table tbody td template tfoot th thead title tr ul".split()
)
#: Tags whose content is not markup.
RAW_TAGS = frozenset("script style textarea noscript template iframe svg canvas audio video".split())
#: Of these, tags that hide the rest of a page that never closes them; others end at once.
TO_THE_END = frozenset(("script", "style"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE_TAGS = frozenset(("p", "blockquote", "pre", "dd", "figcaption", "caption"))
#: Elements that hold the article, and how surely.
MAIN_TAGS = {"article": 2, "main": 1}
#: Tags whose content is never main text, and words in class or id that say the same.
SIDE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset head search".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentary disqus reply replies respond".split())
#: Those that name a whole thread, also as the id of a section.
THREAD_WORDS = frozenset(("comments", "disqus", "commentlist"))
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notification alert popup modal overlay sidebar menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login widget pagination "
    "pager copyright disclaimer toolbar skip hidden".split()
)
#: Words that say nothing of their own beside such a word. With any other word ("related-work",
#: "notice-board") a class or id is a name, not a mark.
PLAIN_WORDS = frozenset(
    "area articles author bar block body bottom box button buttons container content count footer "
    "form header holder inner item items left link links list main meta outer page panel posts "
    "right row section site slot stories text thread title top unit wrap wrapper zone".split()
)
#: Elements that end where a sibling of theirs starts, and what they cannot reach beyond.
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",),
            "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: For headings and sections, whose ids are slugs of their text.
_CLASSES = re.compile(r"""\b(?:class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(
    r"""\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    marked: bool
    main: int
    kind: float  # 1 a paragraph, 0.5 an item of a list, 0 something else
    heading: bool


@dataclass
class _Open:
    tag: str
    marked: bool  # never main text
    soft: bool  # said so by class or id alone: a main element inside counts more
    main: int


def _marks(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is marked as a side matter, firmly or by class or id alone."""
    if tag in SIDE_TAGS:
        return True, False
    if not attributes:
        return False, False
    if _HIDDEN.search(attributes):
        return True, False
    if tag in ("body", "html"):
        return False, False
    names = _names(_MARKS, attributes)
    if any(words & THREAD_WORDS and _says(words, COMMENT_WORDS) for words in names):
        return True, False
    if tag in HEADINGS or tag == "section":
        names = _names(_CLASSES, attributes)
    if any(_says(words, COMMENT_WORDS) for words in names):
        return True, False
    return False, tag not in MAIN_TAGS and any(_says(words, SIDE_WORDS) for words in names)


def _names(marks: re.Pattern, attributes: str) -> list[set[str]]:
    """The words of each class, id and role."""
    return [{w.lower() for w in _WORD.findall(name) if not w.isdigit()}
            for found in marks.findall(attributes) for name in "".join(found).split()]


def _says(words: set[str], side: frozenset[str]) -> bool:
    return bool(words & side) and words <= SIDE_WORDS | COMMENT_WORDS | PLAIN_WORDS


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in its order. Broken markup is read as browsers would, roughly:
    an end tag without a start is ignored, and one that skips open elements ends those too."""
    found: list[Block] = []
    stack: list[_Open] = []
    is_open: Counter[str] = Counter()
    pieces: list[tuple[str, bool]] = []
    heading = False
    links = 0
    unclosed: set[str] = set()  # raw tags without an end tag further on

    def flush() -> None:
        if not pieces:
            return
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            top = stack[-1] if stack else _Open("", False, False, 0)
            linked = sum(len(t.split()) for t, in_link in pieces if in_link)
            # scripts that do not part words with spaces count by length
            words = max(len(text.split()), len(text) // 16)
            inner = next((o.tag for o in reversed(stack) if o.tag in BLOCK_TAGS), "")
            kind = 1.0 if inner in PROSE_TAGS else 0.5 if inner == "li" else 0.0
            found.append(Block(text, words, linked, top.marked or top.soft, top.main, kind, heading))
        pieces.clear()

    def close(at: int) -> None:
        for element in stack[at:]:
            is_open[element.tag] -= 1
        del stack[at:]

    def start(tag: str, attributes: str) -> None:
        nonlocal heading
        limits = SIBLINGS.get(tag)
        for at in range(len(stack) - 1, -1, -1):
            open_tag = stack[at].tag
            if open_tag == "p" and tag in BLOCK_TAGS or limits and open_tag == tag:
                close(at)
                break
            if open_tag in BLOCK_TAGS and (not limits or open_tag in limits):
                break
        if tag in VOID_TAGS:
            return
        firm, soft = _marks(tag, attributes)
        top = stack[-1] if stack else _Open("", False, False, 0)
        main = max(top.main, MAIN_TAGS.get(tag, 0))
        if tag == "header" and not main:
            firm = True
        softly = (top.soft and tag not in MAIN_TAGS) or soft
        stack.append(_Open(tag, top.marked or firm, softly, main))
        is_open[tag] += 1

    # Beyond the last ">" no tag ends: an unfinished one there is dropped, what stands before it is
    # text.
    ends = page.rfind(">") + 1
    unfinished = re.compile(r"<[a-zA-Z/!?]").search(page, ends)
    size = unfinished.start() if unfinished else len(page)
    at = 0
    while at < size:
        match = _TAG.search(page, at, ends) if at < ends else None
        stop = match.start() if match else size
        if stop > at:
            pieces.append((html.unescape(page[at:stop]), links > 0))
        if match is None:
            break
        at = match.end()
        if match.group(1):
            pieces.append((match.group(1), links > 0))
        tag = (match.group(3) or match.group(6) or "").lower()
        if not tag:
            continue
        ending = bool(match.group(2) or match.group(5))
        attributes = match.group(4) or match.group(7) or ""
        if tag in RAW_TAGS:
            if not ending and not attributes.rstrip().endswith("/"):
                end = None
                if tag not in unclosed:
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in TO_THE_END:
                    at = size
                else:
                    unclosed.add(tag)
            pieces.append((" ", False))
            continue
        if tag == "a":
            links = max(0, links - 1) if ending else 1
            continue
        if tag == "br":
            pieces.append((" ", False))
            continue
        if tag in BLOCK_TAGS:
            flush()
            heading = tag in HEADINGS and not ending
            if tag not in VOID_TAGS:
                links = 0
        if ending:
            for i in range(len(stack) - 1, -1, -1) if is_open[tag] else ():
                if stack[i].tag == tag:
                    if tag not in BLOCK_TAGS and any(o.tag in BLOCK_TAGS for o in stack[i + 1:]):
                        break
                    flush()
                    close(i)
                    break
        elif tag in BLOCK_TAGS or any(_marks(tag, attributes)):
            if tag not in BLOCK_TAGS:
                flush()
            start(tag, attributes)
    flush()
    return found


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "kind", "heading", "marked", "place")


def described(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block. ``place`` is 1 inside an article, 0.75 inside the main
    element of a page without one, 0.25 inside the main element beside the article, 0 elsewhere on
    such pages, and 0.5 on pages without either."""
    if not found:
        return np.zeros((0, len(FEATURES)))
    words = np.array([b.words for b in found], float)
    links = np.array([min(1.0, b.linked / b.words) for b in found])
    level = max((b.main for b in found if not b.marked), default=0)
    places = {0: (0.5, 0.5, 0.5), 1: (0.0, 0.75, 0.75), 2: (0.0, 0.25, 1.0)}[level]
    place = np.array([places[b.main] for b in found])

    def shifted(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        if by > 0:
            out[by:] = values[:-by]
        else:
            out[:by] = values[-by:]
        return out

    return np.column_stack([
        words, links, shifted(words, 1), shifted(links, 1), shifted(words, -1), shifted(links, -1),
        np.array([b.kind for b in found]), np.array([b.heading for b in found], float),
        np.array([b.marked for b in found], float), place,
    ])


#: Labelled pages: pieces of markup with one block each (a number stands for so many words), after
#: it 1 for main text.
PAGES = (
    # an article among everything that a site has
    "<header><p>4</p></header> 0|<nav><ul><li><a>1</a> 0|<li><a>2</a> 0|<li><a>1</a></ul></nav> 0|"
    "<div class=ad>9</div> 0|<div>7</div> 0|<article><h1>9</h1> 1|<p>45</p> 1|<p>3</p> 1|"
    "<p>80 <a>4</a></p> 1|<h2>3</h2> 1|<p>22</p> 1|<ul><li>2</li> 1|<li>6</li> 1|"
    "<li><a>3</a></li></ul> 1|<p><a>2</a></p> 1|<p>1</p></article> 1|<div class=comments><p>30</p> 0|"
    "<p>4</p></div> 0|<aside><p>12</p></aside> 0|<p>25</p> 0|<footer>8</footer> 0",
    # a linked title, links and side matters within the article, prose outside of it
    "<div>6</div> 0|<p>40</p> 0|<article><h1><a>6</a></h1> 1|<p>60</p> 1|<div class=ad>20</div> 0|"
    "<p>30</p> 1|<div class=share><a>1</a></div> 0|<p>5</p> 1|<form>4</form> 0|"
    "<div class=notice>60</div> 0|<h2 class=title>3</h2> 1|<ul><li><a>5</a></li> 1|<li><a>4</a></li> 1|"
    "<li><a>7</a></li></ul> 1|<p>100</p></article> 1|<p>20</p> 0|<div><a>2</a> 1</div> 0",
    "<article>1</article> 1|<p>3</p> 0", "<article><p><a>8</a></p></article> 1",
    "<article><p>1</p> 1|<ul><li><a>1</a></li> 1|<li><a>1</a></li></ul> 1|<div>2</div> 1|"
    "<ul><li><a>3</a></li> 1|<li><a>2</a></li></ul> 1|<div>8</div></article> 1",
    # the main element around the article
    "<nav><a>2</a></nav> 0|<main><h1>6</h1> 1|<p>25</p> 1|<article><p>60</p> 1|<p>8</p></article> 1|"
    "<ul><li><a>5</a></li> 0|<li><a>6</a></li></ul> 0|<div>4</div> 0|<p><a>3</a></p></main> 0|<p>9</p> 0",
    # the main element alone
    "<nav><a>1</a></nav> 0|<div>5</div> 0|<main><h1><a>5</a></h1> 1|<p>3</p> 1|<p>50</p> 1|<ul><li>3</li> 1|"
    "<li>4</li></ul> 1|<p>2</p> 1|<p>14 <a>2</a></p> 1|<div><a>2</a></div> 0|<div><a>1</a></div> 0|"
    "<ul><li><a>4</a></li> 0|<li><a>5</a></li> 0|<li><a>3</a></li></ul></main> 0|<p>30</p> 0|"
    "<footer>6</footer> 0",
    # neither: link lists, a title, prose and short paragraphs
    "<div><a>1</a></div> 0|<div><a>2</a></div> 0|<div><a>1</a></div> 0|<h1>6</h1> 1|<p>4</p> 1|<p>60</p> 1|"
    "<p>14 <a>2</a></p> 1|<p>2</p> 1|<h2>2</h2> 1|<p>35</p> 1|<p>5</p> 1|<ul><li><a>2</a></li> 0|"
    "<li><a>3</a></li></ul> 0|<div>4</div> 0|<ul><li><a>3</a></li> 0|<li><a>1</a></li></ul> 0|"
    "<p><a>1</a></p> 0",
    "<p>1</p> 1|<p>1</p> 1|<p>3</p> 1", "<h1>1</h1> 1|<p>30</p> 1|<p>2</p> 1", "<p>1</p> 1",
    "<h1>2</h1> 1|<p>2</p> 1|<h2>1</h2> 1|<p>1</p> 1|<ul><li>2</li> 1|<li>3</li> 1|<li>1</li></ul> 1",
    # neither, in plain divisions or none
    "1 0", "<div>2</div> 0", "<div>40</div> 1",
    "<div>40</div> 1|<div>5</div> 1|<div>60</div> 1|<div>3</div> 1|<div>30</div> 1|<div><a>2</a></div> 0|"
    "<div>6</div> 0",
    "<div>2</div> 0|<ul><li><a>2</a></li> 0|<li><a>1</a></li></ul> 0|<div>1</div> 0|<ul><li><a>1</a></li> 0|"
    "<li><a>2</a></li></ul> 0|<p>50</p> 1|<p>30</p> 1|<div><a>2</a> 1 <a>2</a></div> 0|<div>6</div> 0",
    # much linked prose, and lines of links with a few words
    "<p>40</p> 1|<p>10 <a>10</a></p> 1|<p>30</p> 1|<div><a>6</a> 4</div> 0|<div><a>9</a> 2</div> 0|"
    "<p><a>4</a></p> 0",
    "<h2><a>5</a></h2> 1|<p>40</p> 1|<h2><a>3</a></h2> 1|<p>25</p> 1|<p><a>2</a></p> 0",
    # titles of link lists, and of prose
    "<ul><li><a>2</a></li> 0|<li><a>1</a></li></ul> 0|<p>2</p> 0|<ul><li><a>1</a></li> 0|<li><a>2</a></li></ul> 0|"
    "<h1>5</h1> 1|<p>40</p> 1|<p>3</p> 1|<p>25</p> 1|<h3>2</h3> 0|<ul><li><a>2</a></li> 0|"
    "<li><a>4</a></li></ul> 0|<h3>1</h3> 0|<div><a>3</a></div> 0|<p>1</p> 0|<div><a>1</a></div> 0",
    "<div><a>2</a></div> 0|<div>1</div> 0|<div><a>1</a></div> 0|<div>35</div> 1|<div>50</div> 1|<div>4</div> 1|"
    "<div>20</div> 1|<div><a>2</a></div> 0|<div>3</div> 0|<div><a>4</a></div> 0",
    # side matters on pages without an article
    "<p>60</p> 1|<div class=sidebar>45</div> 0|<p>30</p> 1|<div class=cookie-notice>12</div> 0|<p>9</p> 1|"
    "<div class=comment-list><p>25</p> 0|<p>3</p></div> 0|<h2>4</h2> 1|<p>20</p> 1|"
    "<h2 class=related>2</h2> 0|<div class=related><p>16</p></div> 0|<footer>9</footer> 0",
)
#: The pages count with their texts shorter and longer, too.
SCALES = (0.5, 1.0, 3.0)


def labelled() -> np.ndarray:
    """FEATURES and label of every block of the labelled pages."""
    rows = []
    for page in PAGES:
        pieces = [piece.rsplit(" ", 1) for piece in page.split("|")]
        for scale in SCALES:
            def words(number: re.Match, scale: float = scale) -> str:
                return "word " * max(1, round(int(number.group()) * scale))

            markup = [re.sub(r"(?<![\w<])\d+", words, piece) for piece, _ in pieces]
            found = blocks("".join(markup))
            if len(found) != len(pieces):
                raise ValueError(f"{len(found)} blocks for {len(pieces)} labels: {page}")
            labels = [[float(label)] for _, label in pieces]
            rows.append(np.hstack([described(found), labels]))
    return np.concatenate(rows)


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 10):
    """A classification tree: the label of a leaf, or (feature, threshold, below, above). Each
    split takes the threshold with the least Gini impurity, the first of equals."""
    if depth == 0 or labels.min() == labels.max():
        return int(2 * labels.sum() >= len(labels))
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for threshold in (values[:-1] + values[1:]) / 2:
            below = rows[:, feature] < threshold
            impurity = sum(
                side.sum() * labels[side].mean() * (1 - labels[side].mean())
                for side in (below, ~below)
            )
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, feature, threshold
    if best is None:
        return int(2 * labels.sum() >= len(labels))
    _, feature, threshold = best
    below = rows[:, feature] < threshold
    return (feature, float(threshold), grow(rows[below], labels[below], depth - 1),
            grow(rows[~below], labels[~below], depth - 1))


def trained(table: np.ndarray | None = None):
    table = labelled() if table is None else table
    return grow(table[:, :-1], table[:, -1])


def decide(tree, row: np.ndarray) -> int:
    while isinstance(tree, tuple):
        feature, threshold, below, above = tree
        tree = below if row[feature] < threshold else above
    return tree


def main_text(page: str | None, tree) -> str:
    """The main text of a page: its blocks of main text, each on one line, parted by an empty
    line. A null or empty page has none."""
    found = blocks(page or "")
    chosen = [b.text for b, row in zip(found, described(found)) if decide(tree, row)]
    return "\n\n".join(chosen)


def extract(pages: DataFrame, page: str = "html") -> DataFrame:
    """All rows with text and n_chars (its code points), which replace columns of those names.
    Each page is read whole and by itself, so repeated rows get the same text."""
    kept = pages.drop("text", "n_chars")
    schema = kept.withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("bigint")).schema
    tree = trained()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part in slices(batch):
                texts = [main_text(x, tree) for x in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    schema.names,
                )

    return kept.mapInArrow(batches, schema)
