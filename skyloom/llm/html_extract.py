"""Main text of web pages: flat text blocks judged by a decision tree.

A page is cut into blocks at block-level tags. A block is described by its word count and link density, by those of the
blocks before and after it, and by what its elements say of their purpose; a decision tree, grown here on the blocks of
a few labelled pages, keeps or drops it.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.common import map_rows, raw

#: Fixed values of HTML: elements of raw text, other elements whose content is not text of the page, elements that break
#: the flow, void elements.
RAW = "script|style|textarea|title|iframe|xmp"
HIDDEN = "noscript|template|svg|math|object|select|canvas|audio|video|map|button|datalist"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags whose end another start of the same kind implies.
ALONE = frozenset("p li dt dd td th tr option".split())
#: Elements that hold no article: one that starts inside means that their end tag is missing.
NO_ARTICLE = frozenset("nav header menu ul ol li p h1 h2 h3 h4 h5 h6".split())

# A hidden element ends with its end tag. Where that is missing, as the next element of its kind or the end of the
# article shows, only what comes before the next block is hidden.
TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<({RAW})(?=[\s/>])[^>]*+>(?:.*?</\1(?=[\s/>])[^>]*+>|[^<]*+)"
    rf"|<({HIDDEN})(?=[\s/>])(?:[^>]*/>|[^>]*+>(?:(?:(?!</?(?:article|main|body|html)[\s>]|<\2[\s/>]).)*?</\2\s*+>|(?:[^<]++|<(?!/?(?:{'|'.join(sorted(BLOCK))})[\s/>]))*+))"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+>?""",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role|aria-label|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN_ATTRIBUTE = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words in class, id and role that tell what an element is for.
SIDE = frozenset("ad ads adv advert advertisement advertising adverts banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside widget widgets related recommended recommendations popular trending share sharing social cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe subscription signup login comment comments reply replies respond disqus discussion search form pagination pager toolbar masthead copyright legal disclaimer contentinfo complementary skip tags toc outbrain taboola".split())
HEAD = frozenset("header banner masthead topbar".split())
MAIN = frozenset("article articlebody main content post entry story".split())


@dataclass
class Block:
    text: str
    words: int
    density: float
    side: float
    head: bool
    main: bool
    heading: bool


def _purpose(tag: str, attributes: str) -> tuple[float, bool, bool]:
    """(how surely it stands beside the text, page or section header, main text), as the element says.

    A name counts by the share of its parts that say so: all of "cookie-notice", half of "share-bar", a third of "notice-board-history".
    """
    side = float(tag in ("nav", "footer", "aside", "form", "dialog", "menu", "search", "fieldset", "label", "option"))
    head, main = tag == "header", tag in ("article", "main")
    if attributes:
        if HIDDEN_ATTRIBUTE.search(attributes):
            side = 1.0
        for m in ATTRIBUTE.finditer(attributes):
            for name in (m[1] or m[2] or m[3] or "").split():
                parts = {p.lower() for p in PART.findall(name)}
                if not parts:
                    continue
                known = parts & SIDE
                if tag in ("article", "main", "body", "html"):
                    known &= {"comment", "comments"}
                elif tag in HEADING or {"article", "body"} <= parts:
                    known = set()
                side = max(side, len(known) / len(parts))
                head |= not parts.isdisjoint(HEAD)
                main |= not parts.isdisjoint(MAIN)
    return side, head, main and side < 0.5


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, character references decoded and white space closed up."""
    out: list[Block] = []
    stack: list[tuple[str, float, bool, bool]] = []
    buffer: list[str] = []
    linked = [0]
    in_link = 0

    def close() -> None:
        text = " ".join("".join(buffer).split())
        if text:
            n = text.count(" ") + 1
            side = max((s[1] for s in stack), default=0.0)
            out.append(Block(text, n, min(1.0, linked[0] / n), side, any(s[2] for s in stack), any(s[3] for s in stack), any(s[0] in HEADING for s in stack)))
        buffer.clear()
        linked[0] = 0

    def put(chunk: str) -> None:
        if chunk:
            chunk = html.unescape(chunk)
            buffer.append(chunk)
            if in_link:
                linked[0] += len(chunk.split())

    at = 0
    for m in TOKEN.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = m[4]
        if tag is None:
            if (m[1] or m[2] or "svg").lower() not in ("svg", "math", "map"):
                buffer.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m[3] else 1
        elif tag == "br":
            buffer.append(" ")
        if tag not in BLOCK:
            continue
        close()
        if m[3]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            while stack and stack[-1][0] in ("option", "optgroup") and tag not in ("option", "optgroup"):
                stack.pop()
            if tag in ALONE and stack and stack[-1][0] == tag:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if tag in ("article", "main"):
                while stack and stack[-1][0] in NO_ARTICLE:
                    stack.pop()
                # a form around the article is the page's, not a form to fill in
                stack[:] = [("div", 0.0, h, t) if n == "form" else (n, x, h, t) for n, x, h, t in stack]
            stack.append((tag, *_purpose(tag, m[5])))
            in_link = 0 if tag in ("nav", "article", "section", "footer") else in_link
    put(page[at:])
    close()
    return out


FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "side", "head", "main", "page has main", "heading")


def vectors(bs: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block; a neighbour that is not there has no words and density -1."""
    has_main = float(any(b.main and b.side < 0.5 for b in bs))
    rows = []
    for i, b in enumerate(bs):
        before, after = bs[i - 1] if i else None, bs[i + 1] if i + 1 < len(bs) else None
        near = [x for n in (before, after) for x in ((n.words, n.density) if n else (0, -1.0))]
        rows.append([b.words, b.density, *near, b.side, b.head, b.main, has_main, b.heading])
    return np.array(rows, np.float64).reshape(-1, len(FEATURES))


#: The labelled pages, a line for each block: 1 for main text, the elements around it (tag.class), its words, and how
#: many of them are links. Blocks of one page that begin alike lie in the same elements, but for the last one.
PAGES = """
0 nav>ul>li 1 1
0 nav>ul>li 2 2
0 nav>ul>li 1 1
0 div.ad 9 0
1 article>h1 9 0
1 article>p 60 2
1 article>p 120 0
1 article>p 1 0
1 article>p 80 0
1 article>p 3 0
0 footer 14 0

0 header>div 2 1
0 header>h1 6 0
0 header>p 12 0
0 nav>ul>li 1 1
0 nav>ul>li 1 1
0 div.cookie-notice 30 1
1 main>article>header>h1 8 0
0 main>article>header>p 5 1
0 main>article>header>p 14 0
1 main>article>p 45 4
1 main>article>h2 4 0
1 main>article>p 150 3
1 main>article>ul>li 3 0
1 main>article>ul>li 2 0
1 main>article>ul>li 4 4
1 main>article>ul>li 3 3
1 main>article>ul>li 2 2
1 main>article>p 70 0
0 main>article>div.share-bar 2 2
0 main>article>form.newsletter-signup 16 0
1 main>article>p 30 0
0 main>section.comments>h2 2 0
0 main>section.comments>p 60 0
0 main>section.comments>p 25 0
0 aside>h3 3 0
0 aside>p 40 2
0 aside>ul>li 7 7
0 footer>p 9 0
0 footer>ul>li 1 1

1 article>p 8 0

0 nav>ul>li 1 1
1 article>p 4 0
0 footer 6 0

0 nav>ul>li 1 1
0 div.ad 20 0
1 article>h1 2 0
1 article>p 1 0
0 footer 30 0

0 nav>a 1 1
0 div 25 0
0 div 60 0
1 article>p 6 6
1 article>p 9 0
1 article>p 1 1
0 div 80 0
0 div 12 0

0 header>p 10 0
1 main>p 2 0
1 main>p 3 3
1 main>h2 2 2
1 main>ul>li 1 1
1 main>ul>li 2 1
0 footer>p 60 0

0 div>p 60 0
0 div>p 5 0
1 article>p 12 12
1 article>p 200 30
1 article>p 4 1
0 div>p 150 0
0 div>p 3 0

0 div>p 20 1
0 div 6 0
1 article>p 11 0
1 article>div.notice-board-history>p 50 0
1 article>div.notice-board-history>p 12 0
1 article>blockquote>p 30 0
1 article>p 20 10
0 article>p.advert 12 0
1 article>table>tr>td 2 0
1 article>table>tr>td 1 0
1 article>p 5 5
0 article>aside>p 40 0
0 article>nav>ul>li 3 3
0 article>footer>p 8 2
0 div 40 0
0 div 3 3

0 div>span 1 1
0 div>div 1 1
0 div>div 2 2
0 div>div 1 1
1 div>h1 6 0
1 div>p 70 1
1 div>p 3 0
1 div>p 90 4
1 div>p 18 0
1 div>p 25 6
0 div>div 4 4
0 div>div 3 3
0 div>div 9 0

0 p 6 0
0 ul>li 1 1
0 ul>li 1 1
1 p 40 0
1 ul>li 3 0
1 ul>li 2 0
1 ul>li 4 0
1 p 55 3
0 ul>li 8 8
0 ul>li 7 7
0 ul>li 9 8

0 div>p 4 0
0 div>p 2 2
0 div>p 3 3
1 h1 7 0
1 p 22 0
1 p 17 0
1 p 30 2
0 p 2 2
0 p 1 1
0 p 5 1

1 p 1 0

1 p 6 0

1 p 5 0
1 p 8 0
1 p 2 0
1 p 9 0

1 h1 3 0
1 p 4 0
1 p 60 2
1 p 7 0

0 ul>li 1 1
0 ul>li 2 2
1 p 5 0
1 p 30 0
1 p 4 0
1 p 3 0

0 p 2 2
1 p 50 0
1 p 3 0
0 p 9 0
0 p 1 1

1 p 16 0

1 h1 4 0
1 p 12 0

1 p 18 0
1 p 2 0
1 p 25 0

0 p 1 1

0 ul>li 2 2
0 ul>li 1 1
0 ul>li 2 2

0 nav>a 1 1
0 aside>p 60 0
0 footer>p 12 0

1 p 45 0
1 p 5 0
0 section.comments>p 70 0
0 section.comments>p 18 0
0 div.footer>p 30 0

0 div.sidebar>p 30 0
0 div.sidebar>h3 2 0
1 div.page>h2 5 0
1 div.page>p 35 2
1 div.page>p 28 0
0 div.page>div.related>h3 3 0
0 div.page>div.related>p 8 8
0 div.page>div.related>p 22 0
0 div.legal 50 0

0 div.site-header>p 5 0
0 div.site-header>p 20 0
1 div.post-content>p 33 0
1 div.post-content>p 6 0
1 div.post-content>h3 3 0
1 div.post-content>p 44 8
0 div.post-tags 3 3
0 div 25 0
"""


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """FEATURES and labels of the blocks of PAGES: the pages are written as HTML and read like any others."""
    x, y = [], []
    for page in PAGES.strip().split("\n\n"):
        lines = [line.split() for line in page.split("\n")]
        out, open_ = [], []

        def close(down_to: int, out: list[str] = out, open_: list[str] = open_) -> None:
            while len(open_) > down_to:
                out.append(f"</{open_.pop().split('.')[0]}>")

        for _, path, words, links in lines:
            elements = path.split(">")
            same = 0
            while same < min(len(open_), len(elements) - 1) and open_[same] == elements[same]:
                same += 1
            close(same)
            for e in elements[same:]:
                tag, _, name = e.partition(".")
                out.append(f'<{tag} class="{name}">' if name else f"<{tag}>")
                open_.append(e)
            n, k = int(words), int(links)
            out.append(" ".join(["<a href=/>w</a>"] * k + ["w"] * (n - k)))
        close(0)
        bs = blocks("".join(out))
        assert [b.words for b in bs] == [int(w) for _, _, w, _ in lines]
        x.append(vectors(bs))
        y += [float(label) for label, *_ in lines]
    return np.concatenate(x), np.array(y)


class Tree:
    """A binary decision tree grown by Gini impurity until leaves are pure; of equal splits the first feature's wins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 12):
        self.value, self.feature = float(y.mean()), -1
        if depth == 0 or y.min() == y.max():
            return
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (left, ~left))
                if best is None or impurity < best[0] - 1e-12:
                    best = impurity, f, cut, left
        if best is not None:
            _, self.feature, self.cut, left = best
            self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature < 0:
            return np.full(len(x), self.value >= 0.5)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


_TREE: list[Tree] = []


def tree() -> Tree:
    if not _TREE:
        _TREE.append(Tree(*labelled()))
    return _TREE[0]


def main_text(page: str) -> str:
    """The kept blocks of a page, joined by newlines."""
    bs = blocks(page)
    if not bs:
        return ""
    keep = tree().predict(vectors(bs))
    return "\n".join(b.text for b, k in zip(bs, keep) if k)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", content: str = "html") -> DataFrame:
    """One row per page: key, url, text (empty if none), n_chars.

    Null and empty pages have an empty text, and an empty table gives no rows. Pages are taken whole, however long, and
    broken markup is read as it stands: a missing end tag hides no text behind the next block. Repeated rows give
    repeated rows; nulls in the other two columns stay; further columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (key, url)}

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t.as_py().decode("utf-8", "replace")) for t in b.column(2)]
        cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=[key, url, "text", "n_chars"])

    return map_rows(pages.select(key, url, raw(pages[content]).alias("t")), f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars bigint", run)
