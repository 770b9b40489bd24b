"""Main text of web pages: flat text blocks judged by a small decision tree.

A page is cut at its block tags into a flat list of blocks. A block's features
are its word count and link density, those of its neighbours, and what encloses
it (an article or main element, a frame, a class, id or role that tells of
something else). A tree trained on the labelled blocks in ``LABELLED`` tells article blocks from the
rest; it is trained anew in a moment and sent with the tasks.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselight.llm.words import batch_rows

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p"
    " pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN_TAGS = frozenset(["article", "main"])
FRAME_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
HINTS = re.compile(
    r"(?<![a-z])(ads?|advert\w*|banner|breadcrumbs?|byline|comments?|cookies?|consent|disqus|footer|foot"
    r"|header|masthead|menu|modal|nav|navigation|newsletter|notices?|pagination|popup|promo\w*|related"
    r"|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])",
    re.IGNORECASE,
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# What a tag holds beside its name: a quoted value may hold ">".
_REST = r"""(?>=\s*(?:"[^"]*"|'[^']*')|[^>])*+"""
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<title\b{_REST}>.*?(?:</title\s*>|(?=<(?:body|{'|'.join(sorted(BLOCK_TAGS))})\b)|\Z)"
    rf"|<(script|style|textarea)\b{_REST}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_REST})>"
    r"|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
# Elements without text of the page. One that is never closed hides what comes
# before the next block tag; a head without an end tag hides nothing.
HIDDEN_TAGS = frozenset("button head iframe noscript select svg template".split())
_NESTING = frozenset(["svg", "template"])
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)

FEATURES = "words links before before_links after after_links in_main framed hinted".split()
# Labelled blocks: words, link density in percent of words, both for the block
# before and after; whether it lies in an article or main element, in a menu,
# header, footer, aside or form within or without it, under a name that tells
# of something else; and whether it is main text.
LABELLED = """
1 100 0 0 1 100 0 1 0 0
1 100 1 100 1 100 0 1 0 0
2 100 1 100 6 0 0 1 0 0
3 100 3 100 20 0 0 1 1 0
1 100 1 100 5 0 0 0 1 0
1 100 1 100 60 0 0 0 0 0
4 0 1 100 12 0 0 0 1 0
9 0 2 100 10 0 0 0 1 0
25 0 1 100 8 0 0 0 1 0
60 0 30 0 40 0 0 0 1 0
14 0 90 0 0 0 0 1 0 0
8 0 45 0 0 0 0 1 0 0
3 0 6 0 0 0 0 1 0 0
70 5 50 0 0 0 0 1 0 0
30 0 12 0 14 0 0 1 0 0
12 30 200 0 0 0 0 1 1 0
10 0 80 0 30 0 1 1 0 0
40 0 90 0 25 0 1 1 0 0
6 80 120 0 0 0 1 1 0 0
18 0 70 0 22 0 1 0 1 0
55 0 60 0 40 0 1 0 1 0
120 0 80 0 90 0 1 0 1 0
5 60 100 0 18 0 1 0 1 0
35 0 20 0 30 0 1 1 1 0
4 100 90 0 3 100 1 0 1 0
10 0 8 0 60 0 1 0 0 1
6 0 1 100 90 0 1 0 0 1
1 0 25 0 120 0 1 0 0 1
3 0 70 0 80 0 1 0 0 1
12 0 40 0 14 0 1 0 0 1
45 0 10 0 60 0 1 0 0 1
80 4 60 0 40 0 1 0 0 1
150 0 90 0 130 0 1 0 0 1
250 2 80 0 12 0 1 0 0 1
60 0 150 0 9 0 1 0 0 1
2 0 30 0 5 0 1 0 0 1
20 30 60 0 40 0 1 0 0 1
7 50 60 0 30 0 1 0 0 1
1 100 40 0 30 0 1 0 0 1
4 100 60 0 55 0 1 0 0 1
40 0 6 0 70 0 0 0 0 1
90 0 40 0 60 0 0 0 0 1
130 3 90 0 20 0 0 0 0 1
25 0 60 0 80 0 0 0 0 1
8 0 2 100 60 0 0 0 0 1
15 0 90 0 70 0 0 0 0 1
3 0 60 0 75 0 0 0 0 1
4 100 5 100 3 100 0 0 0 0
6 70 4 100 10 60 0 0 0 0
12 60 3 100 2 100 0 0 0 0
2 50 1 100 1 100 0 0 0 0
150 0 90 0 130 0 0 0 1 0
200 0 10 0 100 0 1 0 1 0
95 2 40 0 60 0 0 0 1 0
110 0 60 0 90 0 0 1 0 0
90 10 60 0 80 0 1 1 0 0
180 0 70 0 95 0 0 1 1 0
85 0 0 0 60 0 0 1 0 0
60 0 0 0 0 0 0 0 0 1
30 0 0 0 0 0 0 0 0 1
200 0 0 0 4 0 0 0 0 1
30 0 6 0 9 0 0 0 0 1
5 0 2 0 6 0 1 0 0 1
9 0 0 0 3 0 1 0 0 1
3 0 1 0 60 0 1 0 0 1
2 0 0 0 0 0 1 0 0 1
4 0 1 0 30 0 1 0 0 1
1 0 1 0 2 0 1 0 0 1
7 0 40 0 20 60 1 0 0 1
30 0 25 0 6 80 1 0 0 1
60 0 80 0 45 0 0 0 1 0
45 0 50 0 120 0 0 0 1 0
50 4 90 0 60 0 0 1 0 0
75 0 45 0 45 3 0 1 0 0
140 0 45 0 200 0 0 1 1 0
48 0 60 0 50 0 1 0 1 0
65 0 110 0 70 0 1 1 0 0
300 0 48 0 52 0 0 0 1 0
120 0 5 0 3 50 0 0 1 0
70 0 4 0 2 100 0 0 1 0
45 0 6 0 5 0 0 0 1 0
90 0 5 20 6 0 1 0 1 0
160 0 4 0 1 100 0 0 1 0
28 0 60 0 80 0 0 0 1 0
20 0 90 0 75 0 0 1 0 0
12 0 55 0 60 0 1 0 1 0
6 0 48 0 90 0 0 0 1 0
18 0 70 0 45 0 1 1 0 0
14 0 60 0 3 100 0 0 0 1
9 0 45 0 1 100 0 0 0 1
25 0 50 0 20 0 0 0 0 1
20 0 30 0 0 0 0 0 0 1
22 0 70 0 4 0 0 0 0 1
35 0 1 100 40 0 0 0 0 1
90 0 2 100 0 0 0 0 0 1
70 0 1 100 1 100 0 0 0 1
110 5 60 0 2 100 0 0 0 1
5 0 60 0 45 0 0 0 0 1
9 0 30 0 25 0 0 0 0 1
7 0 8 0 60 0 0 0 0 1
10 0 1 100 30 0 0 0 0 1
2 0 60 0 1 100 1 0 0 0
1 0 40 0 2 100 1 0 0 0
3 0 120 0 1 100 1 0 0 0
2 0 1 100 1 100 1 0 0 0
4 100 80 0 1 100 1 0 0 0
2 100 4 100 0 0 1 0 0 0
30 0 90 0 1 100 1 0 0 1
45 0 5 100 3 100 1 0 0 1
25 0 60 0 2 100 1 0 0 1
2 0 1 0 1 0 1 0 0 1
1 0 8 0 5 0 1 0 0 1
8 0 10 0 0 0 1 0 0 1
4 0 16 0 90 0 1 0 0 1
1 0 90 0 16 0 1 0 0 1
2 0 20 0 16 0 1 0 0 1
10 0 13 0 5 0 1 0 0 1
12 0 80 0 0 0 0 0 0 1
6 0 9 0 8 0 0 0 0 1
8 0 20 0 5 0 0 0 0 1
5 0 30 0 0 0 0 0 0 1
8 0 1 100 6 0 1 0 0 1
5 0 1 100 10 0 1 0 0 1
1 0 1 100 3 0 1 0 0 1
40 0 3 0 70 0 0 0 0 1
12 0 9 0 2 0 1 0 0 1
25 0 3 0 8 0 0 0 0 1
6 0 60 0 1 100 1 0 0 1
8 0 75 0 2 100 1 0 0 1
5 0 40 0 3 100 0 0 0 1
18 0 80 0 1 100 0 0 0 1
"""


@dataclass
class Block:
    text: str
    words: int
    links: float
    in_main: bool
    framed: bool
    hinted: bool


@dataclass(eq=False)
class _Element:
    """An open element; ``plain`` counts the words outside links in a main one."""

    name: str
    is_main: bool = False
    frames: bool = False
    hints: bool = False
    hides: bool = False
    loose: bool = False
    plain: int = 0


def _closed(tokens: list[re.Match]) -> set[int]:
    """Which start tags of hidden elements have an end tag."""
    opened, closed = {}, set()
    for i, m in enumerate(tokens):
        name = (m[3] or "").lower()
        if name not in HIDDEN_TAGS or m[4].endswith("/"):
            continue
        starts = opened.setdefault(name, [])
        if not m[2]:
            if name not in _NESTING:
                starts.clear()
            starts.append(i)
        elif starts:
            closed.add(starts.pop())
    return closed


def blocks(page: str) -> list[Block]:
    """Texts between block tags, in page order; blocks without text are left out.

    The frame and the name of an element that holds the page's own text say nothing of
    its blocks; those of any other do.
    """
    found: list[tuple[Block, list[_Element], int]] = []
    held: list[tuple[str, bool]] = []
    opened: list[_Element] = []
    linked = 0
    hidden = False

    def close_block():
        if not held:
            return
        text = " ".join(html.unescape("".join(t for t, _ in held)).split())
        if text:
            words = len(text.split())
            in_links = sum(len(html.unescape(t).split()) for t, link in held if link)
            for o in opened:
                o.plain += max(0, words - in_links)
            in_main = any(o.is_main for o in opened)
            rank = next((int(o.name[1]) for o in opened if re.fullmatch("h[1-6]", o.name)), 0)
            found.append((Block(text, words, min(1.0, in_links / words), in_main, False, False), [*opened], rank))
        held.clear()

    at = 0
    tokens = list(_TOKEN.finditer(page))
    closed = _closed(tokens)
    for i, m in enumerate(tokens):
        if m.start() > at and not hidden:
            held.append((page[at : m.start()], linked > 0))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in BLOCK_TAGS:
            # An unclosed hidden element, or a head, ends here.
            if hidden:
                while any(o.loose or o.name == "head" for o in opened):
                    opened.pop()
                hidden = any(o.hides for o in opened)
            if not hidden:
                close_block()
                linked = 0
        elif name == "a" and not hidden:
            linked = max(0, linked - 1) if m[2] else linked + 1
        elif name == "br" and not hidden:
            held.append((" ", False))
        if name in _VOID or m[4].endswith("/"):
            continue
        if m[2]:
            if any(o.name == name for o in opened):
                while opened.pop().name != name:
                    pass
        elif name in HIDDEN_TAGS:
            if i in closed or name != "head":
                opened.append(_Element(name, hides=True, loose=i not in closed))
        elif name in BLOCK_TAGS or name in ("span", "b", "i"):
            if name in BLOCK_TAGS:
                # Paragraphs and inline elements left open end with the block.
                while opened and opened[-1].name in ("p", "span", "b", "i"):
                    opened.pop()
            named = " ".join("".join(x) for x in _NAMES.findall(m[4])) if m[4] else ""
            # The header of an article holds its title, not the site's.
            frames = name in FRAME_TAGS and not (name == "header" and any(o.is_main for o in opened))
            hints = name not in ("html", "body") and bool(HINTS.search(named))
            opened.append(_Element(name, name in MAIN_TAGS, frames, hints))
        was, hidden = hidden, any(o.hides for o in opened)
        if was and not hidden and name in BLOCK_TAGS:
            close_block()
            linked = 0
    if not hidden:
        held.append((page[at:], linked > 0))
    close_block()
    own = _around_text(found)
    for block, around, _ in found:
        block.framed = any(o.frames and o not in own for o in around)
        block.hinted = any(o.hints and o not in own for o in around)
    return [block for block, *_ in found]


def _around_text(found: list[tuple[Block, list[_Element], int]]) -> set[_Element]:
    """Elements around the page's own text.

    That is the article or main element with most words outside links that no frame or name
    marks, but for such as are also around the first heading of the highest rank. Without one it is
    that heading and the longest block not marked otherwise; only elements that hold both are around it.
    """
    ranks = [rank for *_, rank in found if rank]
    headed = next((set(around) for _, around, rank in found if ranks and rank == min(ranks)), set())

    def unmarked(around: list[_Element]) -> bool:
        return not any((o.frames or o.hints) and o not in headed for o in around)

    mains = {o: around[: i + 1] for _, around, _ in found for i, o in enumerate(around) if o.is_main}
    own = [o for o, around in mains.items() if unmarked(around)]
    if not own and not ranks:
        own = [o for o in mains if not o.hints]
    if own:
        return set(mains[max(own, key=lambda o: o.plain)])
    plain = [(b.words * (1 - b.links), around) for b, around, _ in found if unmarked(around)]
    return headed & set(max(plain, key=lambda x: x[0])[1]) if headed and plain else set()


def features(found: list[Block]) -> np.ndarray:
    rows = np.zeros((len(found), len(FEATURES)))
    for i, b in enumerate(found):
        rows[i, [0, 1, 6, 7, 8]] = b.words, b.links, b.in_main, b.framed, b.hinted
    rows[1:, 2:4] = rows[:-1, 0:2]
    rows[:-1, 4:6] = rows[1:, 0:2]
    return rows


def _impurity(labels: np.ndarray) -> float:
    p = labels.mean()
    return p * (1 - p) * len(labels)


def train(rows: np.ndarray, labels: np.ndarray, depth: int = 6):
    """A classification tree by Gini impurity: (feature, threshold, below, above) or a label."""
    if depth == 0 or labels.min() == labels.max():
        return bool(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            below = rows[:, f] <= cut
            cost = _impurity(labels[below]) + _impurity(labels[~below])
            if best is None or cost < best[0] - 1e-12:
                best = cost, f, cut, below
    if best is None:
        return bool(labels.mean() >= 0.5)
    _, f, cut, below = best
    return (
        f, float(cut),
        train(rows[below], labels[below], depth - 1),
        train(rows[~below], labels[~below], depth - 1),
    )


def labelled() -> tuple[np.ndarray, np.ndarray]:
    table = np.array([line.split() for line in LABELLED.split("\n") if line], float)
    table[:, [1, 3, 5]] /= 100
    return table[:, :-1], table[:, -1]


def is_main(tree, row: np.ndarray) -> bool:
    while not isinstance(tree, bool):
        f, cut, below, above = tree
        tree = below if row[f] <= cut else above
    return tree


def main_text(page: str | None, tree) -> str:
    found = blocks(page) if page else []
    rows = features(found)
    return "\n\n".join(b.text for b, row in zip(found, rows) if is_main(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of (page_id, url, html).

    White space within a block becomes one space, blocks are joined by an empty
    line. A page without html or without main text has the text ''. Of elements
    that are never closed, comments, scripts, styles and text areas end
    with the page, titles and other hidden ones at the next block tag. Other columns are
    not read. Rows that repeat are each returned; a very long page is read whole.
    """
    tree = train(*labelled())

    def run(batches):
        for batch in batch_rows(batches):
            texts = [main_text(h, tree) for h in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
