"""Main text of web pages by minimum-cut labelling.

A page is read into blocks of text.  A small linear classifier turns each block's
features (enclosing elements, length, share of linked text, punctuation, what the
names of the elements around it suggest) into a cost of calling it content or boilerplate:
the terminal capacities of a graph.  Edges between neighbouring blocks and between consecutive
blocks of the same container make it costly to label them differently.  The
minimum cut, found by maximum flow, is the labelling of least total cost.

Names of classes and ids are hints, not verdicts: a hint against an element counts little where
another of its names speaks for it or where it holds most of the page's text inside
an article.  If nothing is content although the page has text, the page is cut again
without names and without the classifier's bias against short text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.frames import mapped

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<[!?][^>]*>?|</?[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^'\"<>])*>|[^<]+|<",
    re.S | re.I,
)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-\w]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "textarea", "title", "select", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = {"article", "div", "section", "body", "table", "ul", "ol"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# The classifier: weights of elements and roles, and of what names suggest.
BAD_ELEMENTS = {"nav": 7.0, "footer": 7.0, "aside": 7.0, "button": 7.0, "menu": 6.0, "dialog": 7.0, "head": 9.0}
#: Elements that some pages put around everything: they count less where they hold most of the text.
WRAPPERS = {"form": 7.0, "fieldset": 6.0, "header": 6.0}
GOOD_ELEMENTS = {"article": 4.0, "main": 2.5}
BAD_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "toolbar"}
#: A part of a name that speaks against its element wherever it stands; the second kind less where the element holds most of the text.
BAD_PARTS = {"ad", "ads", "adsense", "adslot", "advert", "adverts", "advertisement", "advertising", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "nav", "navbar", "navigation", "newsletter", "outbrain", "pager", "pagination", "sidebar", "signup", "taboola", "toolbar", "topbar"}
MILD_PARTS = {"copyright", "masthead", "modal", "overlay", "paywall", "popup", "promo", "promotion", "recommended", "recommendations", "related", "sharing", "social", "sponsor", "sponsored", "subscribe", "widget", "widgets"}
#: Names that speak against their element only as a whole.
BAD_NAMES = {"alert", "banner", "disclaimer", "foot", "header", "legal", "menu", "notice", "notices", "notification", "rail", "replies", "reply", "respond", "search", "share", "side", "skip", "tag", "tags"}
#: Parts that speak for an element whose name has no part against it.
GOOD_PARTS = {"article", "body", "content", "entry", "main", "post", "story", "text"}
BAD_NAME_COST, MIXED_NAME_COST, GOOD_NAME_GAIN = 8.0, 1.5, 1.5
BIAS, LINKS, ENDS, PARAGRAPH = 1.2, 4.0, 0.4, 0.8
#: Share of the page's text from which an element counts as the page itself, and characters that make a page's text.
MOST, ENOUGH = 0.5, 250
#: Edge weights: neighbours, neighbours across a region border, same container.
NEAR, FAR, SIBLING = 0.6, 0.1, 0.8
_UNITS = 1000
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")


@dataclass(slots=True)
class Element:
    """An element of the page: its parent and what it says about its text by itself."""

    name: str
    parent: int
    #: weight that always counts, weight of a wrapper, hint of its names
    fixed: float = 0.0
    wrapper: float = 0.0
    hint: float = 0.0
    mild: bool = True
    region: int = 0
    in_article: bool = False
    #: unlinked characters inside
    mass: int = 0


@dataclass(slots=True)
class Block:
    """Text between block borders."""

    container: int
    region: int
    weight: float
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _attributes(tag: str) -> dict[str, str]:
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(tag, _TAG.match(tag).end())}


def name_hint(names: str, article: bool = False) -> float:
    """What class and id names suggest; names on both sides, or an article element, leave little of a hint against."""
    good = bad = False
    for name in names.split():
        parts = {p.lower() for p in _PARTS.findall(name)}
        if parts & (BAD_PARTS | MILD_PARTS) or name.lower() in BAD_NAMES:
            bad = True
        elif parts & GOOD_PARTS:
            good = True
    if bad:
        return -MIXED_NAME_COST if good or article else -BAD_NAME_COST
    return GOOD_NAME_GAIN if good else 0.0


def _element(name: str, tag: str, parent: int, above: Element) -> Element:
    out = Element(name, parent, region=above.region, in_article=above.in_article or name in GOOD_ELEMENTS)
    out.fixed = GOOD_ELEMENTS.get(name, 0.0) - BAD_ELEMENTS.get(name, 0.0)
    # an article may have its own header
    out.wrapper = 0.0 if above.in_article and name == "header" else WRAPPERS.get(name, 0.0)
    if len(tag) > len(name) + 2 and name not in INLINE:
        found = _attributes(tag)
        if name not in ("html", "body"):
            names = f"{found.get('class', '')} {found.get('id', '')}"
            out.hint = name_hint(names, name in GOOD_ELEMENTS)
            out.mild = BAD_PARTS.isdisjoint(p.lower() for p in _PARTS.findall(names))
        if found.get("role", "").lower() in BAD_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            out.fixed -= BAD_NAME_COST
    return out


def read_page(page: str) -> tuple[list[Element], list[Block]]:
    """Elements and non-empty blocks of a page in order, with white space squeezed and references decoded.

    Every tag is handled in time that does not grow with the page, but for the elements it closes.
    """
    tokens = _TOKEN.findall(page)
    elements = [Element("", 0)]
    stack = [0]
    depth: Counter[str] = Counter()
    #: end tags of raw elements still to come: one that is never closed hides nothing
    closers = Counter(m[2].lower() for t in tokens if t.startswith("</") and (m := _TAG.match(t)) and m[2].lower() in RAW)
    skip = ""
    out: list[Block] = []
    current: Block | None = None

    def close(at: int) -> None:
        for n in stack[at:]:
            depth[elements[n].name] -= 1
        del stack[at:]

    for token in tokens:
        if token[0] != "<" or token == "<":
            if skip:
                continue
            if current is None:
                top = next(n for n in reversed(stack) if elements[n].name not in INLINE)
                current = Block(top, elements[top].region, 0.0, elements[top].name)
                out.append(current)
            current.parts.append(token)
            if depth["a"]:
                current.linked += len(token.strip())
            continue
        match = _TAG.match(token)
        if not match:
            continue
        closing, name = match[1] == "/", match[2].lower()
        if closing and name in RAW:
            closers[name] -= 1
        if skip:
            if closing and name == skip:
                skip = ""
            continue
        if name in ("script", "style"):
            continue
        if name in RAW:
            if not closing and not token.endswith("/>") and closers[name] > 0:
                skip = name
            current = current if name in ("svg", "math", "noscript") else None
            continue
        if name == "br":
            if current:
                current.parts.append(" ")
            continue
        if name not in INLINE:
            current = None
        if name in VOID:
            continue
        if closing:
            if depth[name]:
                at = len(stack) - 1
                # an inline end tag does not close a block around it
                while elements[stack[at]].name != name and (name not in INLINE or elements[stack[at]].name in INLINE):
                    at -= 1
                if elements[stack[at]].name == name:
                    close(at)
        else:
            ends = {"p"} if name in CLOSES_P else set()
            ends |= SAME_CLOSES.get(name, set())
            if any(depth[e] for e in ends):
                at = next(i for i in range(len(stack) - 1, -1, -1) if not i or elements[stack[i]].name in ends or elements[stack[i]].name in BORDERS)
                if elements[stack[at]].name in ends:
                    close(at)
            element = _element(name, token, stack[-1], elements[stack[-1]])
            if element.fixed or element.wrapper or element.hint:
                element.region = len(elements)
            stack.append(len(elements))
            depth[name] += 1
            elements.append(element)
    kept = []
    for block in out:
        block.text = " ".join(_html.unescape("".join(block.parts)).split())
        if block.text:
            elements[block.container].mass += max(0, len(block.text) - block.linked)
            kept.append(block)
    for n in range(len(elements) - 1, 0, -1):
        elements[elements[n].parent].mass += elements[n].mass
    return elements, kept


def weigh(elements: list[Element], blocks: list[Block], names: bool = True) -> None:
    """Gives every block the classifier's weight of the elements around it."""
    total = elements[0].mass
    weights = [0.0] * len(elements)
    for n, e in enumerate(elements[1:], 1):
        most = total and e.mass >= MOST * total
        wrapper = e.wrapper * (1 - e.mass / total) if most else e.wrapper
        hint = e.hint if names else 0.0
        if hint < 0 and e.mild and most and e.in_article:
            hint = max(hint, -MIXED_NAME_COST)
        weights[n] = weights[e.parent] + e.fixed - wrapper + hint
    for block in blocks:
        block.weight = weights[block.container]


def belief(block: Block, bias: float = BIAS) -> float:
    """Log-odds that a block is content."""
    n = len(block.text)
    links = min(1.0, block.linked / n)
    score = block.weight + (PARAGRAPH if block.tag == "p" or block.tag in HEADINGS else 0.0) + min(2.0, n / 80) - bias - LINKS * links
    if block.text[-1] in ".!?…。\"'":
        score += ENDS
    return score


class Flow:
    """Maximum flow by augmenting along shortest paths in levels."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, forth: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(forth)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                b = self.to[e]
                if self.room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self, source: int, sink: int) -> list[int]:
        """Saturates the graph; returns levels, -1 for nodes cut off from the source."""
        while (level := self.levels(source))[sink] >= 0:
            place = [0] * len(self.edges)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    first = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.to[path[first] ^ 1]
                    del path[first:]
                    continue
                edges = self.edges[at]
                while place[at] < len(edges):
                    e = edges[place[at]]
                    if self.room[e] and level[self.to[e]] == level[at] + 1:
                        break
                    place[at] += 1
                if place[at] < len(edges):
                    path.append(edges[place[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    place[at] += 1
                else:
                    break
        return level


def label_blocks(blocks: list[Block], bias: float = BIAS) -> list[bool]:
    """True for content: the labelling of least cost."""
    n = len(blocks)
    flow, source, sink = Flow(n + 2), n, n + 1
    last: dict[int, int] = {}
    for i, block in enumerate(blocks):
        cost = round(_UNITS * belief(block, bias))
        if cost > 0:
            flow.add(source, i, cost)
        elif cost < 0:
            flow.add(i, sink, -cost)
        if i:
            w = round(_UNITS * (NEAR if block.region == blocks[i - 1].region else FAR))
            flow.add(i - 1, i, w, w)
        if block.container in last and last[block.container] != i - 1:
            w = round(_UNITS * SIBLING)
            flow.add(last[block.container], i, w, w)
        last[block.container] = i
    level = flow.run(source, sink)
    return [level[i] >= 0 for i in range(n)]


def main_text(page: str | None) -> str:
    """Content blocks of a page, joined by line feeds."""
    elements, blocks = read_page(page or "")
    weigh(elements, blocks)
    labels = label_blocks(blocks)
    if not any(labels):
        weigh(elements, blocks, names=elements[0].mass < ENOUGH)
        labels = label_blocks(blocks, bias=0.0)
    return "\n".join(b.text for b, ok in zip(blocks, labels, strict=True) if ok)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` with one row per page.

    ``text`` holds the blocks labelled content in page order, joined by line feeds, with
    references decoded and white space inside a block squeezed; it is empty for null
    and empty pages and pages without content.  Pages are read whole whatever
    their length or damage.  Null ids and repeated rows are kept as they are; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            chars = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), chars], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return mapped(rows, run, "page_id long, url string, text string, n_chars long")
