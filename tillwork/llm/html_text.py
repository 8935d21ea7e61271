"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks at block-level tags; scripts, styles, forms, comments in the markup and
the like never become blocks. A classifier gives every block a cost for either label, from the
elements above it (kind, class and id words), the share of linked text, length and punctuation. The
costs are the capacities from the source (content) and to the sink (boilerplate). Blocks that follow each
other, and blocks of one container, are tied by smoothness edges that grow with the depth of the
container they share. The minimum cut of that graph is the labelling of least total cost; it is
found by maximum flow. Blocks that stay on the source's side are the text.

Pages are independent, so nothing is shuffled. NULL, empty and broken html give what can be read of
it, or the empty text. A very long page is one task's work, which grows little faster than its blocks. White space
means Unicode white space, as in ``str.split``.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import free_name, map_columns

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_BETWEEN = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Element names by their meaning in HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button form dialog".split())
_RAW = frozenset("script style textarea title iframe noscript".split())
_BLOCK = frozenset(
    "address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 header hr "
    "html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ENDS_P = _BLOCK - {"br", "body", "html"}

# Cost of an element above a block (natural logarithm of odds, content over boilerplate).
_ELEMENT = {"nav": -8.0, "aside": -8.0, "footer": -8.0, "menu": -8.0, "header": -6.0, "article": 4.0, "main": 3.0, "h1": 2.0}
_IN_ARTICLE = {"header": -1.0, "footer": -8.0}
_BAD_WORD = -8.0
_GOOD_WORD = 3.0
# Words of class, id and role names.
_BAD = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright disclaimer discussion disqus feedback footer gdpr legal login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notices notification outbrain overlay pager pagination paywall popup promo promoted promotion reactions recommended related replies reply respond responses "
    "share sharing sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola tags toolbar topbar trending "
    "widget widgets header alert alerts".split()
)
# Names such as "with-sidebar" or "tag-social" tell what stands beside a block or what it is about, not what it is.
_ABOUT = frozenset("with without has no category tag topic".split())
# Words that also name what an article is about; they say nothing beside a word of an article, or on an article itself.
_TOPIC = frozenset("alert alerts discussion legal recommended social trending".split())
_GOOD = frozenset("article content entry main post story text body".split())
_ARTICLE_WORDS = _GOOD | {"news"}
_LINKED = -5.0  # all text in links
_PER_WORD, _MOST_BY_LENGTH = 0.04, 2.0
_SHORT = -0.6
_SENTENCE = 0.6
_NEXT, _SHARED, _FAMILY = 0.25, 0.15, 0.5


@dataclass
class _Element:
    tag: str
    number: int
    cost: float
    in_article: bool
    skipped: bool


@dataclass
class Block:
    text: str
    container: int
    path: tuple[int, ...]
    cost: float = 0.0


@dataclass
class _Reader:
    """Blocks of one page; end tags that match nothing are ignored, missing ones are implied."""

    stack: list[_Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    count: int = 0

    def flush(self) -> None:
        if not self.pieces:
            return
        text = " ".join(entities.unescape("".join(self.pieces)).split())
        if text:
            path = tuple(e.number for e in self.stack if e.tag in _BLOCK)
            above = self.stack[-1].cost if self.stack else 0.0
            self.blocks.append(Block(text, path[-2] if self.stack and self.stack[-1].tag in ("p", "li") and len(path) > 1 else path[-1] if path else -1, path, above + block_cost(text, self.linked)))
        self.pieces, self.linked = [], 0

    def add(self, text: str) -> None:
        if text and not (self.stack and self.stack[-1].skipped):
            self.pieces.append(text)
            if any(e.tag == "a" for e in self.stack[-3:]):
                self.linked += len(text.strip())

    def open(self, tag: str, attributes: str) -> None:
        closes = _CLOSES.get(tag, {"p"} if tag in _ENDS_P else ())
        for at in range(len(self.stack) - 1, max(-1, len(self.stack) - 6), -1):
            if self.stack[at].tag in closes:
                del self.stack[at:]
                break
            if self.stack[at].tag in _BLOCK:
                break
        above = self.stack[-1] if self.stack else None
        self.count += 1
        cost, hidden = element_cost(tag, attributes, above is not None and above.in_article)
        inherited = above.cost if above else 0.0
        self.stack.append(_Element(
            tag, self.count, cost + (min(0.0, inherited) if cost <= _BAD_WORD else inherited), tag in ("article", "main") or bool(above and above.in_article),
            hidden or tag in _SKIP or bool(above and above.skipped),
        ))

    def close(self, tag: str) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at].tag == tag:
                del self.stack[at:]
                return


def name_words(text: str) -> set[str]:
    """Words of the names in an attribute, without those that a name only refers to."""
    found = set()
    for name in text.split():
        for word in _WORDS.findall(_BETWEEN.sub(" ", name).lower()):
            found.add(word)
            if word in _ABOUT:
                break
    return found


def element_cost(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """What an element says of the blocks below it, and whether it hides them."""
    cost = (_IN_ARTICLE.get(tag) if in_article else None) or _ELEMENT.get(tag, 0.0)
    if not attributes or tag in ("html", "body", "a"):
        return cost, False
    hidden, words = False, set()
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
        elif name in ("class", "id", "role"):
            words |= name_words(value)
    if in_article:
        words.discard("header")  # an article's own heading
    bad = words & _BAD
    if bad <= _TOPIC and (tag in ("article", "main") or words & _ARTICLE_WORDS):
        bad = set()
    if bad:
        cost += _BAD_WORD
    elif words & _GOOD:
        cost += _GOOD_WORD
    return cost, hidden


def block_cost(text: str, linked: int) -> float:
    words = text.count(" ") + 1
    cost = min(_MOST_BY_LENGTH, _PER_WORD * words) + (_SHORT if words < 5 else 0.0) + (_SENTENCE if text[-1] in ".!?…:\"”»" else 0.0)
    return cost + _LINKED * min(1.0, linked / max(1, len(text)))


def read_blocks(html: str) -> list[Block]:
    reader, at, end = _Reader(), 0, len(html)
    while at < end:
        token = _TOKEN.search(html, at)
        if token is None:
            reader.add(html[at:])
            break
        reader.add(html[at : token.start()])
        at = token.end()
        if token[2] is None:
            continue
        tag = token[2].lower()
        if tag in _BLOCK or tag in _SKIP:
            reader.flush()
        if token[1]:
            reader.close(tag)
        elif tag in _RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in _VOID and not (token[3] or "").endswith("/"):
            reader.open(tag, token[3])
    reader.flush()
    return reader.blocks


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours by the depth they share, and blocks of one container in order."""
    edges, last = [], {}
    for i, block in enumerate(blocks):
        if i:
            shared = 0
            for a, b in zip(blocks[i - 1].path, block.path, strict=False):
                if a != b:
                    break
                shared += 1
            edges.append((i - 1, i, _NEXT + _SHARED * max(0, shared - 2)))
        before = last.get(block.container)
        if before is not None:
            edges.append((before, i, _FAMILY))
        last[block.container] = i
    return edges


_TINY = 1e-12


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side; capacities are the costs (source if positive, else sink) and the edges.

    A node whose own capacity outweighs all its edges lies on that side of every minimum cut; such nodes are settled
    first, and what they are tied to takes the tie as capacity of its own. The maximum flow through the rest is found in
    phases: levels by breadth first search, then all shortest paths of that length, no arc being tried twice.
    """
    cost = list(costs)
    near: list[dict[int, float]] = [{} for _ in cost]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    settled: dict[int, bool] = {}
    waiting = deque(range(len(cost)))
    while waiting:
        u = waiting.popleft()
        if u in settled:
            continue
        ties = sum(near[u].values())
        # Of several minimum cuts the one with the fewest nodes on the source's side counts.
        if cost[u] <= ties + _TINY and cost[u] > -ties:
            continue
        settled[u] = cost[u] > 0
        for v, c in near[u].items():
            cost[v] += c if settled[u] else -c
            del near[v][u]
            waiting.append(v)
        near[u] = {}
    supply = [0.0 if u in settled else max(0.0, c) for u, c in enumerate(cost)]
    demand = [0.0 if u in settled else max(0.0, -c) for u, c in enumerate(cost)]
    while True:
        level, last = _levels(near, supply, demand)
        if last < 0:
            # What the source still reaches is content; the rest is cut off.
            return [settled.get(u, level[u] >= 0) for u in range(len(cost))]
        _fill(near, supply, demand, level, last)


def _levels(near: list[dict[int, float]], supply: list[float], demand: list[float]) -> tuple[list[int], int]:
    """(steps from the source, the least number of steps to a node with demand, -1 if there is none)."""
    level = [0 if s > _TINY else -1 for s in supply]
    front, steps = [u for u, at in enumerate(level) if at == 0], 0
    while front:
        ahead, found = [], False
        for u in front:
            for v, room in near[u].items():
                if room > _TINY and level[v] < 0:
                    level[v] = steps + 1
                    ahead.append(v)
                    found = found or demand[v] > _TINY
        front, steps = ahead, steps + 1
        if found:
            return level, steps
    return level, -1


def _fill(near: list[dict[int, float]], supply: list[float], demand: list[float], level: list[int], last: int) -> None:
    """Push what goes through along paths that rise one level a step, up to nodes with demand at level ``last``."""
    arcs: dict[int, Iterator[int]] = {}
    tried: dict[int, int] = {}

    def following(u: int) -> int:
        """The next node of ``u`` that is not known to lead nowhere; -1 if there is none."""
        if u not in arcs:
            arcs[u] = iter(list(near[u]))
            tried[u] = next(arcs[u], -1)
        while tried[u] >= 0 and not (near[u][tried[u]] > _TINY and level[tried[u]] == level[u] + 1):
            tried[u] = next(arcs[u], -1)
        return tried[u]

    for start in [u for u, s in enumerate(supply) if s > _TINY]:
        path = [start]
        while path and supply[start] > _TINY:
            u = path[-1]
            if level[u] == last and demand[u] > _TINY:
                flow = min(supply[start], demand[u], *(near[a][b] for a, b in zip(path, path[1:], strict=False)))
                supply[start] -= flow
                demand[u] -= flow
                keep = len(path) if demand[u] > _TINY else len(path) - 1
                for i in range(len(path) - 1, 0, -1):
                    a, b = path[i - 1], path[i]
                    near[a][b] -= flow
                    near[b][a] += flow
                    if near[a][b] <= _TINY:
                        keep = i
                del path[max(1, keep):]
                continue
            v = following(u) if level[u] < last else -1
            if v >= 0:
                path.append(v)
                continue
            path.pop()
            if path:
                # Nothing more goes through ``u`` in this phase.
                level[u] = -2


def main_text(html: str | None) -> str:
    blocks = read_blocks(html) if html else []
    content = minimum_cut([b.cost for b in blocks], edges_of(blocks))
    return " ".join(b.text for b, inside in zip(blocks, content, strict=True) if inside)


def extract_text(pages: DataFrame, html: str = "html", result: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``html`` if None) with ``result`` and ``n_chars``, its code points.

    Columns of the pages that have one of these names are left out.
    """
    keep = [c for c in (keep if keep is not None else pages.columns) if c not in (html, result, "n_chars")]
    name = free_name(pages, "_text")

    def work(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for (sources,) in batches:
            yield [[main_text(s) for s in sources]]

    made = map_columns(pages, [html], [(name, T.StringType())], work, keep)
    return made.select(*keep, F.col(name).alias(result), F.length(name).cast("long").alias("n_chars"))
