"""Main text of pages by minimum cut.

A page's markup is cut into text blocks. A linear classifier over a block's own features (length, share of links, sentence marks, its
element) and over what encloses it (kinds of elements, words of class names, whether the page's article lies elsewhere) gives a log-odds
cost, which becomes the capacity from the source (content) or to the sink (boilerplate). Smoothness edges join neighbouring blocks, the
stronger the nearer they are in the tree of elements, and blocks of one parent, the stronger if they are of one kind. The minimum cut labels the
blocks; a block on the source's side is content. A block's own evidence is weak (within two or so), as are the edges, so that a short paragraph
among paragraphs stays and a sentence among links goes; only elements that the page itself names navigation, footer, form and so on are strong.

Only scripts, styles and comments of the markup are never text. Each page is labelled alone. Scanning is linear in the page's length; the maximum
flow is found by blocking flows.

Edge cases: null or empty html gives an empty text; markup may be broken or end anywhere: a tag that is never closed ends before the next
one, a quote that is never closed is no quote, and neither is any after it; text without any markup is one block; pages may be of any length
and depth; a page of boilerplate only has an empty text; repeated rows are treated alike; `keep` columns of any name are returned, but
a kept one named text or n_chars gives two columns of that name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import load, pieces

#: Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded mfenced menclose semantics annotation object canvas svg text tspan g path circle rect line use defs iframe noscript q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements within which a start closes nothing that is open outside.
ENCLOSES = {"p": {"div", "article", "section", "td", "li", "body", "blockquote"}, "other": {"ul", "ol", "dl", "table", "menu", "select"}}
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Log-odds that an element adds for its whole subtree.
ELEMENT = {"nav": -4.5, "footer": -4.5, "aside": -4.5, "form": -4.5, "button": -4.5, "select": -4.5, "textarea": -4.5, "menu": -4.5, "dialog": -4.5, "head": -9.0, "fieldset": -3.0, "header": -3.0, "label": -1.5}
REGION = {"article": 1.2, "main": 0.8}
#: Log-odds for words of an element's class, id or role; one of each sign counts.
AGAINST, FOR = -4.0, 1.0
AGAINST_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promoted
    comment comments disqus respond reply replies discussion
    nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc
    sidebar aside widget widgets related recommended recommendations trending
    footer copyright colophon masthead topbar toolbar contentinfo complementary
    cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login paywall
    share sharing social""".split()
)
FOR_WORDS = frozenset("article post entry story content body main".split())
#: A block's own log-odds: bias; per doubling of its length beyond LENGTH characters, within bounds; share of links; a sentence mark at its end; its element.
BIAS, PER_DOUBLING, LENGTH, SHORTEST, LONGEST, LINKS, SENTENCE, OUTSIDE = 0.6, 0.9, 48, -1.0, 2.0, -4.0, 0.5, -3.2
KIND = {"p": 0.5, "blockquote": 0.5, "pre": 0.5, "h1": 1.0, "h2": 0.3, "h3": 0.3, "h4": 0.3, "h5": 0.3, "h6": 0.3, "td": -0.2}
#: Smoothness: of neighbours at distance 2 in the tree (less in proportion beyond), of blocks of one parent, and the factor where their elements differ.
NEIGHBOUR, SIBLING, UNLIKE = 1.5, 1.0, 0.25

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}


class Element:
    """An open element: what it and those around it say for and against content."""

    __slots__ = ("against", "depth", "inline", "links", "name", "parent", "region", "support")

    def __init__(self, name, parent, against=0.0, support=0.0, region=0.0, links=False):
        self.name, self.parent = name, parent
        self.against, self.support, self.region, self.links = against, support, region, links
        self.inline = name in INLINE
        self.depth = parent.depth + (not self.inline) if parent else 0


class Block:
    __slots__ = ("element", "links", "near", "text")

    def __init__(self, text, element, links, near):
        self.text, self.element, self.links, self.near = text, element, links, near


def _opened(name: str, rest: str, up: Element) -> Element:
    against, support, region = up.against + ELEMENT.get(name, 0.0) * (name != "header" or not up.region), up.support, max(up.region, REGION.get(name, 0.0))
    if rest and name not in ("html", "body"):
        words: set = set()
        for m in _ATTRIBUTE.finditer(rest):
            words.update(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()))
        if words & AGAINST_WORDS:
            against += AGAINST
        elif words & FOR_WORDS:
            support = FOR
    return Element(name, up, against, support, region, up.links or name == "a")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order. near: depth of the innermost element that a block shares with the one before."""
    out: list[Block] = []
    stack = [Element("", None)]
    runs = [Counter()]  # open inline elements since each open block element
    open_: Counter = Counter()  # open block elements
    text: list[str] = []
    linked, low = 0, 0

    def flush():
        nonlocal linked, low
        if text:
            t = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if t:
                home = stack[-1]
                while home.inline:
                    home = home.parent
                out.append(Block(t, stack[-1] if stack[-1].inline and len(stack) > 1 and stack[-1].against != home.against else home, min(1.0, linked / len(t)), min(low, home.depth)))
                low = home.depth
            text.clear()
        linked = 0

    def add(raw):
        nonlocal linked
        text.append(raw)
        if stack[-1].links:
            linked += len(raw.strip())

    def pop_to(k):
        nonlocal low
        for x in stack[k:]:
            if x.inline:
                runs[-1][x.name] -= 1
            else:
                runs.pop()
                open_[x.name] -= 1
        del stack[k:]
        low = min(low, stack[-1].depth)

    def close(names, until):
        if any(open_[x] for x in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in names:
                    pop_to(k)
                    return
                if stack[k].name in until:
                    return

    at, n, quotes, ends = 0, len(page), True, page.rfind(">")
    while at < n:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        after = page[start + 1 : start + 2]
        m = _NAME.match(page, start)
        if m is None and after not in ("!", "?", "/"):  # a sign, not a tag
            add(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        tag_at = m.end() if m else start + 1
        if tag_at > ends:  # no tag is closed any more
            at = page.find("<", start + 1)
            at = at if at >= 0 else n
            continue
        found = _REST.match(page, tag_at) if quotes and m else None
        quotes = quotes and (m is None or found is not None)
        at = found.end() if found else page.find(">", tag_at) + 1
        if m is None:
            continue
        name, rest = m[1].lower(), page[tag_at : at - 1]
        if page[start + 1] == "/":
            if name in INLINE:
                if runs[-1][name]:
                    k = len(stack) - 1
                    while stack[k].name != name:
                        k -= 1
                    if stack[k].against != stack[k].parent.against:
                        flush()
                    pop_to(k)
            elif open_[name]:
                flush()
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                pop_to(k)
            else:
                flush()
            continue
        if name in RAW:
            end = _END[name].search(page, at) if not rest.endswith("/") or name == "script" else None
            at = end.end() if end else at if rest.endswith("/") and name != "script" else n
            continue
        whole = name in VOID or rest.endswith("/")
        if name in INLINE:
            if name == "br":
                text.append(" ")
            if not whole:
                x = _opened(name, rest, stack[-1])
                if x.against != stack[-1].against:
                    flush()
                stack.append(x)
                runs[-1][name] += 1
            continue
        flush()
        if name in ENDS_P:
            close(("p",), ENCLOSES["p"])
        if name in CLOSES:
            close(CLOSES[name], ENCLOSES["other"])
        if whole:
            continue
        while stack[-1].inline and stack[-1].name != "a":  # a block ends the marks that are open around it
            pop_to(len(stack) - 1)
        stack.append(_opened(name, rest, stack[-1]))
        runs.append(Counter())
        open_[name] += 1
    flush()
    return out


def cost(block: Block, has_region: bool) -> float:
    """Log-odds that a block is content."""
    x, size = block.element, len(block.text)
    value = BIAS + max(SHORTEST, min(LONGEST, PER_DOUBLING * math.log2(size / LENGTH))) + LINKS * block.links + KIND.get(x.name, 0.0)
    value += SENTENCE if block.text[-1] in ".!?…\"”»:;。！？" else 0.0
    value += x.against if x.against else x.support + x.region
    return value + (OUTSIDE if has_region and not (x.region and not x.against) else 0.0)


def cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut; costs above 0 tie a node to the source, below to the sink."""
    if all(c > 0 for c in costs) or not edges:
        return [c > 0 for c in costs]
    n = len(costs)
    source, sink = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a, b, ab, ba):
        graph[a].append(len(to))
        to.append(b)
        room.append(ab)
        graph[b].append(len(to))
        to.append(a)
        room.append(ba)

    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0.0)
        elif c < 0:
            edge(i, sink, -c, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    tiny = 1e-9
    while True:  # blocking flows over levels
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                back = 0
                for k, e in enumerate(path):
                    room[e] -= flow
                    room[e ^ 1] += flow
                for k, e in enumerate(path):
                    if room[e] <= tiny:
                        back = k
                        break
                u = to[path[back] ^ 1]
                del path[back:]
                continue
            while nxt[u] < len(graph[u]):
                e = graph[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(graph[u]):
                e = graph[u][nxt[u]]
                path.append(e)
                u = to[e]
            elif u == source:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def graph(found: list[Block]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of the blocks and the smoothness edges between them."""
    has_region = any(b.element.region and not b.element.against for b in found)
    edges, last = [], {}
    for i, b in enumerate(found):
        x, parent = b.element, id(b.element.parent)
        if i:
            y = found[i - 1].element
            distance = max(2, x.depth + y.depth - 2 * min(b.near, x.depth, y.depth))
            like = 1.0 if x.name == y.name and x.parent is y.parent or x is y else UNLIKE
            edges.append((i - 1, i, 2 * NEIGHBOUR * like / distance))
        kind = (parent, x.name)
        if last.get(kind, i - 1) < i - 1:
            edges.append((last[kind], i, SIBLING))
        last[kind] = i
    return [cost(b, has_region) for b in found], edges


def label(found: list[Block]) -> list[bool]:
    return cut(*graph(found))


def extract(page) -> str:
    """Main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, kept in zip(found, label(found)) if kept)


def extract_text(df: DataFrame, html_: str = "html", keep=("page_id", "url")) -> DataFrame:
    """df's `keep` columns with text and n_chars (code points)."""
    rows = df.select(F.struct(*keep).alias("kept"), F.col(html_).alias("html"))

    def apply(batches):
        for whole in batches:
            for batch in pieces(whole, "html"):
                text = [extract(x) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["kept", "text", "n_chars"])

    return rows.mapInArrow(apply, f"kept {rows.schema['kept'].dataType.simpleString()}, text string, n_chars bigint").select("kept.*", "text", "n_chars")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))
