"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text at block-level tags.  A linear classifier (the weights below) gives each
block a log-odds of being article text from its ancestors, class and id words, length, punctuation and link
density.  Positive log-odds become capacities from the source, negative ones to the sink; neighbouring
blocks and successive blocks of one parent are tied by edges whose capacity falls with their distance in
the element tree.  The maximum flow separates article from boilerplate, and the article's blocks are joined
in page order.  What is marked as boilerplate by its element, class or id costs more than everything that could
speak for it, so it goes at any length, also inside the article.  A page without an article element or container
has the prior that what is not marked belongs to its text.

Boilerplate words in a class or id mark what lies below them, but not on ``html``, ``body`` and ``main`` elements
and not on the page's article or elements around it (the ``article`` element with most text, or else the ``main``
element with most text): those hold the article itself.

Defined cases: a null or empty page, and a page without an article block, give an empty text; broken
markup (unclosed or stray tags, cut-off pages, unknown entities) is read as browsers do: what opens ends
with its parent; repeated rows and null urls pass through; an empty table gives an empty result; other
columns are ignored; pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import load, prepare

# Elements whose content is never text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "canvas", "audio", "video",
       "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# Elements that begin and end blocks.
BLOCK = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div",
         "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
         "html", "label", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
         "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# A start tag closes an open element of these kinds (unless a container of the second kind lies between).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
# Tags and class or id words of boilerplate, of article containers, and words that count outside articles only.
BOILER_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label"}
BOILER_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies
consent gdpr notice alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead
social share sharing comment comments disqus reply replies related recommended newsletter subscribe subscription signup login
search pagination pager widget widgets copyright legal toolbar tags skip paywall outbrain taboola""".split())
ARTICLE_TAGS = {"article", "main"}
ARTICLE_WORDS = set("article story entry post content articlebody storybody main".split())
# On an article element these say that it is no article of the page's own.
OTHER_WORDS = set("ad ads advert advertisement sponsored promo promotion comment comments reply replies related recommended".split())
HEADER = "header"
# Elements that hold a page or an article: boilerplate words on them say what else they hold.
WHOLE_TAGS = {"html", "body", "main"}

# Log-odds of the block classifier.
W_START, W_ARTICLE, W_CONTAINER, W_BOILER, W_OUTSIDE, W_PLAIN = -1.0, 5.0, 2.0, -25.0, -3.0, 1.5
W_WORD, MAX_WORDS, W_SENTENCE, MAX_SENTENCES, W_LINKS, W_HEADING = 0.1, 30, 0.4, 4, -4.0, 0.5
SMOOTH, SMOOTH_SIBLING = 1.0, 0.5    # capacity between neighbours and between successive blocks of one parent
SCALE = 1000                         # capacities are whole numbers

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SENTENCE = re.compile(r"[.!?…。]")


@dataclass
class Block:
    text: str
    score: float
    node: int   # the block's own element


@dataclass
class Page:
    blocks: list[Block]
    parent: list[int]   # of every element; the page itself is 0
    depth: list[int]


class _Open(NamedTuple):
    """An open element, with what holds for the text in it."""
    tag: str
    node: int
    article: int      # the article or main element around
    container: bool   # inside an article container
    boiler: bool      # inside boilerplate by its tag
    mark: int         # the innermost element around that is boilerplate unless it holds the page's article


def _attribute_words(attributes: str) -> tuple[set[str], bool]:
    words, hidden = set(), False
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "itemprop"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif bare or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            hidden = True
    return words, hidden


def parse_blocks(page: str) -> Page:
    """Blocks of text with their log-odds, and the element tree."""
    stack = [_Open("", 0, 0, False, False, 0)]
    opened: Counter = Counter()   # open elements by tag
    parent, depth = [0], [0]
    articles: dict[int, tuple[str, int, bool]] = {}   # tag, the article around, whether its words are boilerplate's
    found: list[tuple[str, int, _Open]] = []
    parts: list[str] = []
    linked, in_link = 0, False

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((text, linked, stack[-1]))
            parts.clear()
        linked = 0

    def pop_to(kinds: set[str], fences: set[str] = frozenset()) -> None:
        if not any(opened[k] for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                opened.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in fences:
                return

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[7]
        if text is not None:
            data = html.unescape(text) if "&" in text else text
            parts.append(data)
            if in_link:
                linked += len(data)
            continue
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:   # comment, declaration
            continue
        tag = tag.lower()
        if closing:
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                close()
                in_link = False
                if tag == "p" or tag in CLOSES:
                    pop_to({tag}, {"article", "body", "div", "section", "table", "ul", "ol"})
                else:
                    pop_to({tag})
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = True
        elif tag in BLOCK:
            close()
            in_link = False
            pop_to({"p"}, {"article", "body", "div", "section", "table", "td", "li", "button"})
            if tag in CLOSES:
                pop_to(*CLOSES[tag])
            if tag in VOID:
                continue
            top = stack[-1]
            words, hidden = _attribute_words(attributes) if attributes else (set(), False)
            node = len(parent)
            parent.append(top.node)
            depth.append(depth[top.node] + 1)
            article = top.article
            marked = tag == "form" or (tag not in WHOLE_TAGS and (words & BOILER_WORDS or (HEADER in words and not article)))
            if tag in ARTICLE_TAGS and not (tag == "article" and words & OTHER_WORDS):
                articles[node] = (tag, article, bool(marked))
                article = node
            boiler = top.boiler or hidden or (tag in BOILER_TAGS and tag != "form") or (tag == HEADER and not article)
            stack.append(_Open(tag, node, article, top.container or bool(words & ARTICLE_WORDS), boiler, node if marked else top.mark))
            opened[tag] += 1
    close()
    around = _around_article(found, articles, parent) if any(place.mark for _, _, place in found) else set()
    # Marks around the article hold no boilerplate; if the innermost one does not, none of those around it does.
    places = [place._replace(boiler=place.boiler or bool(place.mark and place.mark not in around)) for _, _, place in found]
    plain = not articles and not any(p.container and not p.boiler for p in places)
    blocks = [Block(text, _score(text, linked, place, bool(articles), plain), place.node)
              for (text, linked, _), place in zip(found, places)]
    return Page(blocks, parent, depth)


def _around_article(found: list[tuple], articles: dict[int, tuple[str, int, bool]], parent: list[int]) -> set[int]:
    """The page's article and the elements around it.

    It is the article element, or else the main element, with most text; one with boilerplate words of its own only
    if there is no other.
    """
    size = dict.fromkeys(articles, 0)
    for text, _, place in found:
        if place.article and not place.boiler:
            size[place.article] += len(text)
    for node in sorted(size, reverse=True):   # an article's text is text of the article around it too
        if articles[node][1]:
            size[articles[node][1]] += size[node]
    best = max((n for n in size if size[n]), key=lambda n: (not articles[n][2], articles[n][0] == "article", size[n], -n), default=0)
    out = set()
    while best:
        out.add(best)
        best = parent[best]
    return out


def _score(text: str, linked: int, place: _Open, any_article: bool, plain: bool) -> float:
    words = text.count(" ") + 1
    score = (W_START + W_WORD * min(words, MAX_WORDS) + W_SENTENCE * min(len(_SENTENCE.findall(text)), MAX_SENTENCES)
             + W_LINKS * min(1.0, linked / len(text)))
    if place.article:
        score += W_ARTICLE
    elif any_article:
        score += W_OUTSIDE
    if place.boiler:
        score += W_BOILER
    elif place.container:
        score += W_CONTAINER
    elif plain:
        score += W_PLAIN
    if place.tag in HEADINGS:
        score += W_HEADING
    return score


def _tree_distance(page: Page, a: int, b: int) -> int:
    """Steps between two elements, or more than ``SCALE`` where the way is that long."""
    parent, depth = page.parent, page.depth
    steps = 0
    while a != b and steps <= SCALE:
        if depth[a] >= depth[b]:
            a = parent[a]
        else:
            b = parent[b]
        steps += 1
    return steps


def smoothness(page: Page) -> list[tuple[int, int, int]]:
    """Edges ``(i, j, capacity)`` between neighbours and between successive blocks of one parent."""
    edges = []
    last_of: dict[int, int] = {}
    for j, block in enumerate(page.blocks):
        if j:
            edges.append((j - 1, j, int(SCALE * SMOOTH / (1 + _tree_distance(page, page.blocks[j - 1].node, block.node)))))
        # The container is the element around the block's own element.
        around = page.parent[block.node]
        i = last_of.get(around)
        if i is not None and i != j - 1:
            edges.append((i, j, int(SCALE * SMOOTH_SIBLING)))
        last_of[around] = j
    return [e for e in edges if e[2] > 0]


def min_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Source side of the minimum cut (maximum flow by Dinic's level graphs).

    A positive ``unary`` is a capacity from the source, a negative one to the sink; edges hold both ways.
    """
    n = len(unary)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[int] = []

    def add(u: int, v: int, there: int, back: int) -> None:
        graph[u].append(len(to))
        to.append(v)
        room.append(there)
        graph[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, c in enumerate(unary):
        if c > 0:
            add(source, i, c, 0)
        elif c < 0:
            add(i, sink, -c, 0)
    for i, j, c in edges:
        add(i, j, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []   # edges from the source to u
        u = source
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[u] < len(graph[u]):
                e = graph[u][nxt[u]]
                if room[e] and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == source:
                    break
                level[u] = -2   # dead end
                e = path.pop()
                u = to[e ^ 1]
                continue
            path.append(e)
            u = to[e]


def main_text(page: str) -> str:
    tree = parse_blocks(page)
    blocks = tree.blocks
    if not blocks:
        return ""
    unary = [int(round(SCALE * b.score)) for b in blocks]
    if min(unary) > 0:
        content = [True] * len(blocks)
    elif max(unary) <= 0:
        content = [False] * len(blocks)
    else:
        content = min_cut(unary, smoothness(tree))
    return " ".join(b.text for b, keep in zip(blocks, content) if keep)


def _run(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = pa.array([main_text(h.as_py()) for h in batch.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    found = rows.mapInArrow(_run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extraction": op7_html_extraction}
