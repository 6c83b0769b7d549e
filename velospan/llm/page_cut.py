"""Main text of web pages by a minimum cut over their blocks.

A page is cut into blocks of text. What a block is made of gives it a cost as content
and a cost as boilerplate; those are the capacities to the two terminals of a graph.
Blocks that follow each other, and blocks below one parent, are tied by edges that
cost something to cut. The minimum cut is the labelling of least total cost, so a
short line between paragraphs stays with them and a long advert does not.
Every page is worked on alone, by what Arrow batches Spark hands to a task.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velospan.llm.columns import require

# HTML element names by what they do to the text.
_HIDDEN = set("script style noscript template iframe svg math canvas object head title audio video map".split())
_BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "td tfoot th thead tr ul button select textarea label".split()
)
_VOID = {"hr"}
_BOILERPLATE = set("nav footer aside form button select textarea label menu dialog search option fieldset".split())
#: Containers that an article can only be in because their end tag is missing.
_LEFT_OPEN = {"nav", "header", "footer", "form", "menu"}
_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Beginnings of words in class and id names.
_BAD_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?\w*|advertis\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumb\w*|crumbs?|header|masthead|topbar|"
    r"foot|footer\w*|side|sidebar\w*|sidenav|widget\w*|cookie\w*|consent|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|"
    r"subscri\w*|signup|login|comment\w*|repl(?:y|ies)|disqus\w*|respond|discuss\w*|share\w*|sharing|social\w*|related\w*|recommend\w*|"
    r"teaser\w*|pagination|pager|toolbar|copyright|legal|form|search\w*|hidden|feedback)(?=$|[\s_-])",
    re.I,
)
_GOOD_NAMES = re.compile(r"(?:^|[\s_-])(?:article\w*|content|post|entry|story|main|prose|body)(?=$|[\s_-])", re.I)
# Names that tell what an element has around or in it, or a state of it, not what it is.
_NOT_ITSELF = re.compile(
    r"(?:^|[_-])(?:has|have|with|without|no|not)[_-]|[_-](?:open|opened|closed|collapsed|expanded|visible|hidden|active|enabled|disabled|layout)$", re.I
)
#: The head of an article, which is not that of the page.
_OWN_HEAD = re.compile(r"(?:^|[_-])(?:entry|post|article|story)[_-]+header$", re.I)
# A tag ends at a > outside of quotes; a < outside of quotes before that begins another one. No part is
# gone back into, so broken markup costs no more than its length.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^<>]*+>|<(?=[a-zA-Z/!?])[^<]*+\Z", re.S
)
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_END_MARKS = tuple(".!?…:;\"'”»)")

#: Costs of parting neighbours: below one parent, close by, and farther; and of parting siblings.
SAME_PARENT, CLOSE, FAR, SIBLINGS = 0.9, 0.3, 0.1, 0.5
#: Logits for what surrounds a block.
BOILERPLATE, ARTICLE, OUTSIDE_ARTICLE = -8.0, 3.0, -2.5
#: Logit for a class or id name of boilerplate, and its share that is left at every level further down.
NAMED, NAMED_LEFT = -8.0, 0.9


def _names_boilerplate(told: str, in_article: bool) -> bool:
    """Whether a class or id name says that the element itself is boilerplate."""
    for one in told.split():
        own_head = _OWN_HEAD.search(one) or in_article and one.lower() == "header"
        if _BAD_NAMES.search(one) and not _NOT_ITSELF.search(one) and not own_head:
            return True
    return False


@dataclass
class _Element:
    name: str
    number: int
    bad: bool
    article: bool
    good: bool
    unseen: bool
    named: float = 0.0


@dataclass
class Block:
    """One block: its text, what it stands in, and the part of it that is link text."""

    text: str
    tag: str
    path: tuple[int, ...]
    bad: bool
    article: bool
    good: bool
    linked: float
    named: float = 0.0


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Element] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    links: int = 0
    linked_chars: int = 0
    elements: int = 0

    def flush(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            raw = sum(map(len, self.parts))
            self.parts = []
            top = self.stack[-1] if self.stack else _Element("", 0, False, False, False, False)
            if text and not top.unseen:
                path = tuple(e.number for e in self.stack)
                share = min(1.0, self.linked_chars / max(1, raw))
                self.blocks.append(Block(text, top.name, path, top.bad, top.article, top.good, share, top.named))
        self.linked_chars = 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        if self.links:
            self.linked_chars += len(text)

    def open(self, name: str, attributes: str) -> None:
        self.flush()
        self.links = 0
        if self.stack and self.stack[-1].name == "p" or name in ("li", "dt", "dd", "option", "td", "th", "tr"):
            self._end_open(name)
        outer = self.stack[-1] if self.stack else _Element("", 0, False, False, False, False)
        told = ""
        role = False
        if "=" in attributes:
            for key, *values in _NAMES.findall(attributes):
                value = "".join(values)
                if key.lower() == "role":
                    role |= value.lower() in _ROLES
                    told += " main" if value.lower() in ("main", "article") else ""
                elif key.lower() == "itemprop":
                    told += " article" if value.lower() == "articlebody" else ""
                else:
                    told += " " + value
        article = name in ("article", "main")
        whole = article or name in ("html", "body")
        named_bad = not whole and bool(told) and _names_boilerplate(told, outer.article)
        bad = name in _BOILERPLATE or role or (name == "header" and not outer.article)
        article_named = name == "article" and bool(re.search(r"comment|repl(?:y|ies)|teaser", told, re.I))
        inherited = outer.bad
        if article and inherited and self._only_left_open():
            inherited = False
        self.elements += 1
        self.stack.append(
            _Element(
                name,
                self.elements,
                inherited or bad or article_named,
                outer.article or article,
                outer.good or (not whole and bool(_GOOD_NAMES.search(told)) and not named_bad),
                outer.unseen or ("hidden" in attributes or "none" in attributes) and bool(_UNSEEN.search(attributes)),
                NAMED if named_bad else 0.0 if name == "main" else outer.named * NAMED_LEFT,
            )
        )
        if name in _VOID:
            self.stack.pop()

    def _only_left_open(self) -> bool:
        """Whether every boilerplate container around is one that never holds an article."""
        outer_bad = False
        for element in self.stack:
            if element.bad and not outer_bad and element.name not in _LEFT_OPEN:
                return False
            outer_bad = element.bad
        return True

    def _end_open(self, name: str) -> None:
        """A block ends an open paragraph; a list item or cell ends the one before it."""
        if self.stack and self.stack[-1].name == "p":
            self.stack.pop()
        ends = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}
        while self.stack and self.stack[-1].name in ends.get(name, (name,)) and name not in ("div", "section", "p"):
            self.stack.pop()

    def close(self, name: str) -> None:
        self.flush()
        self.links = 0
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].name == name:
                del self.stack[at:]
                break


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; markup that is broken off at the end is left out."""
    reader, at = _Reader(), 0
    for token in iter(lambda: _TOKEN.search(page, at), None):
        if token.start() > at:
            reader.add(page[at : token.start()])
        at = token.end()
        name = (token.group(2) or "").lower()
        if not name:
            continue
        ending = bool(token.group(1))
        if name in _HIDDEN:
            if not ending and not token.group(3).endswith("/"):
                at = _after_end(page, name, at)
        elif name in _BLOCKS:
            reader.close(name) if ending else reader.open(name, token.group(3))
        elif name == "br":
            reader.add(" ")
        elif name == "a":
            reader.links = 0 if ending else 1
    reader.add(page[at:])
    reader.flush()
    return reader.blocks


_ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in _HIDDEN}
_BODY = re.compile(r"<body\b", re.I)


def _after_end(page: str, name: str, at: int) -> int:
    end = _ENDS[name].search(page, at)
    if end:
        return end.end()
    # A head whose end tag is missing ends where the body begins; other hidden parts take the rest.
    body = _BODY.search(page, at) if name in ("head", "title") else None
    return body.start() if body else len(page)


def logit(block: Block, has_article: bool) -> float:
    """How much likelier content is than boilerplate, as a logit.

    That is the capacity to the terminal of content less the one to that of boilerplate,
    and a cut's labels depend on their difference alone.
    """
    if block.bad:
        return BOILERPLATE
    n, text = len(block.text), block.text
    score = ARTICLE if block.article else OUTSIDE_ARTICLE if has_article else 0.0
    score += 1.5 if block.good else 0.0
    score += 2.0 if n >= 200 else 1.0 if n >= 80 else -0.7 if n < 25 else 0.0
    score += 0.7 if text.endswith(_END_MARKS) else 0.0
    score -= (4.0 if block.article else 6.0) * block.linked
    score += {"p": 0.8, "h1": 1.0, "pre": 0.5, "blockquote": 0.5, "td": -0.5, "th": -0.5}.get(block.tag, 0.0)
    score -= 0.3 if block.tag == "li" and not block.article else 0.0
    score += block.named
    return score - (3.0 if text.startswith(("©", "(c) ", "Copyright")) else 0.0)


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Ties of each block to the one before it and to its last sibling."""
    ties, last = [], {}
    for i, block in enumerate(blocks):
        # Paragraphs and the like are elements themselves: their parent is one level up.
        parent = block.path[:-1]
        if i:
            before = blocks[i - 1].path[:-1]
            shared = next((k for k, (x, y) in enumerate(zip(parent, before)) if x != y), min(len(parent), len(before)))
            apart = len(parent) + len(before) - 2 * shared
            ties.append((i - 1, i, SAME_PARENT if not apart else CLOSE if apart <= 2 else FAR))
        sibling = last.get(parent)
        if sibling is not None and sibling != i - 1:
            ties.append((sibling, i, SIBLINGS))
        last[parent] = i
    return ties


def minimum_cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: a true label costs -net where net is below 0, a false one net above 0, a parted edge its weight.

    Nodes whose own cost outweighs all their edges have only one label in any minimum;
    they are settled first and pull their neighbours. What is left is solved by maximum
    flow; nodes that the source still reaches are true.
    """
    n = len(net)
    net, near = list(net), [[] for _ in range(n)]
    for a, b, w in edges:
        near[a].append((b, w))
        near[b].append((a, w))
    weight = [sum(w for _, w in x) for x in near]
    label: list[bool | None] = [None] * n
    queue = deque(i for i in range(n) if abs(net[i]) > weight[i])
    while queue:
        i = queue.popleft()
        if label[i] is not None:
            continue
        label[i] = net[i] > 0
        for j, w in near[i]:
            if label[j] is None:
                net[j] += w if label[i] else -w
                weight[j] -= w
                if abs(net[j]) > weight[j] + 1e-12:
                    queue.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        reached = _source_side(rest, net, near, label)
        for i in rest:
            label[i] = i in reached
    return [bool(x) for x in label]


def _source_side(rest: list[int], net: list[float], near: list, label: list) -> set[int]:
    """Nodes on the source's side of a minimum cut: what the source reaches when no flow can be added.

    Flow is added in phases. A phase numbers nodes by their distance from the source and
    fills every shortest way; each node remembers which of its edges have no way left.
    """
    tiny = 1e-9
    place = {i: k for k, i in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    # Edge e goes to ends[e] and has room[e] left; its reverse is e ^ 1.
    ends: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(ends))
        out[b].append(len(ends) + 1)
        ends.extend((b, a))
        room.extend((there, back))

    for i, k in place.items():
        if net[i] > 0:
            join(source, k, net[i], 0.0)
        elif net[i] < 0:
            join(k, sink, -net[i], 0.0)
        for j, w in near[i]:
            if label[j] is None and place[j] > k:
                join(k, place[j], w, w)
    while True:
        level = [-1] * len(out)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > tiny and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return {i for i, k in place.items() if level[k] >= 0}
        tried = [0] * len(out)
        way: list[int] = []
        while True:
            a = ends[way[-1]] if way else source
            if a == sink:
                flow = min(room[e] for e in way)
                for e in way:
                    room[e] -= flow
                    room[e ^ 1] += flow
                # Go on from before the first edge that is full now.
                del way[next(k for k, e in enumerate(way) if room[e] <= tiny) :]
                continue
            edges = out[a]
            while tried[a] < len(edges):
                e = edges[tried[a]]
                if room[e] > tiny and level[ends[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(edges):
                way.append(edges[tried[a]])
            elif way:
                way.pop()
                tried[ends[way[-1]] if way else source] += 1
            else:
                break


def main_text(page: str | None) -> str:
    """Content blocks in page order, one to a line; empty for null, empty or content-free pages."""
    blocks = blocks_of(page or "")
    has_article = any(b.article and not b.bad and not b.named for b in blocks)
    net = [logit(b, has_article) for b in blocks]
    called = [b for b in blocks if b.article and not b.bad and b.named]
    if called and not has_article:
        # The only article stands in what a name calls boilerplate: it outweighs the name if it is the larger part.
        rest = sum(len(b.text) for b, x in zip(blocks, net, strict=True) if x > 0 and not b.named)
        if sum(len(b.text) for b in called) > rest:
            for b in called:
                b.named = 0.0
            net = [logit(b, True) for b in blocks]
    kept = minimum_cut(net, edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept, strict=True) if keep)


@F.arrow_udf(T.StringType())
def _extracted(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())


def extract(pages: DataFrame, html_column: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with their main text in column ``name``, which is replaced if it is there.

    A null or empty page has empty text. Repeated rows have equal texts, and an empty
    table gives an empty table.
    """
    text: Column = _extracted(F.col(html_column).cast("string"))
    return require(pages, html_column).withColumn(name, text)
