"""Main text of web pages by minimum-cut labelling (operator 9).

A page becomes a sequence of text blocks.  A classifier turns each block's text, tag and
containers into a capacity towards content or boilerplate; neighbours in page order are
tied by weak edges, and those with one parent by strong ones; the minimum cut labels all
blocks of the page at once.  The classifier alone is unsure of short paragraphs, titles and
paragraphs of links inside an article: their neighbours decide.
"""

from __future__ import annotations

import html
import re
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lectern.llm.common import map_arrow

#: Tags that end one block and begin another.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose inside is no markup: it ends at the end tag alone; without one, for the first
#: two, at the page's end, and the others are passed over.
RAW = frozenset("script style iframe textarea title".split())
#: Tags whose text is no text of the page, up to their end tag or the next block that cannot be inside.
UNSAID = frozenset("svg select button template".split())
#: Tags without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that hold no article, and those that do.
OUTSIDE = frozenset("nav footer aside form dialog head menu fieldset".split())
INSIDE = frozenset("article main".split())
OFF_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|breadcrumbs?|byline|comments?|commentary|consent|cookies?|copyright|discussions?|disqus|feedback|footer|gdpr|guestbook|login|"
    r"masthead|menu|modal|nav|navbar|navigation|newsletter|notice|pager|pagination|popup|promos?|reactions?|recommended|related|replies|reply|respond|responses?|search|share|sharing|"
    r"sidebar|signup|skip|social|sponsor(?:ed)?|subscribe|subscription|tags|thread|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
ON_NAMES = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)
OFF_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

#: Weights of the classifier (nats towards content) and of the smoothness edges.  ASIDE: of
#: what is outside the article, where the page has one.
BIAS, IN_ARTICLE, ASIDE, OFF, LINKS, LENGTH, STOP, NOTICE = -1.5, 1.15, -3.0, -4.0, -2.5, 3.0, 0.3, -1.0
TAG_WEIGHT = {"p": 0.25, "h1": 0.5, "h2": 0.3, "h3": 0.3, "h4": 0.3, "blockquote": 0.3, "pre": 0.3, "li": -0.5, "td": -0.5, "th": -0.5, "option": -3.0}
#: Characters from which a block is long.
LONG = 200
NEXT, SIBLING, SECOND = 0.15, 1.15, 0.4

_TOKEN = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^>"']|["'])*?)(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|itemprop|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")
_NOTICE = re.compile(r"^\s*(?:©|\(c\)|copyright\b)|all rights reserved|we use cookies|enable javascript", re.I)
_ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}
_UNSAID_ENDS = {t: re.compile(rf"</{t}\b[^>]*>?|(?=<(?:{'|'.join(sorted(BLOCK - {'option', 'optgroup'}))})[\s/>])", re.I) for t in UNSAID - {"template"}} | {"template": re.compile(r"</template\b[^>]*>?", re.I)}


@dataclass
class Node:
    tag: str
    up: "Node | None"
    weight: float = 0.0
    inside: bool = False


@dataclass
class Block:
    text: str
    node: Node
    linked: int
    weight: float = field(default=0.0)


def _node(tag: str, attributes: str, up: Node | None) -> Node:
    off = tag in OUTSIDE
    inside = tag in INSIDE
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                off = off or (tag not in ("body", "html") and bool(OFF_NAMES.search(value)))
                inside = inside or bool(ON_NAMES.search(value))
            elif name == "role":
                off = off or value.lower() in OFF_ROLES
                inside = inside or value.lower() in ("main", "article")
            elif name == "itemprop":
                inside = inside or value.lower() == "articlebody"
            else:
                off = off or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    weight = up.weight if up else 0.0
    held = (up.inside if up else False) or inside
    if tag == "header" and not held:
        off = True
    if inside and not off and not (up and up.inside):
        weight += IN_ARTICLE
    if off:
        weight += OFF
    return Node(tag, up, weight, held and not off)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order.  Broken markup: a block's start closes an open
    paragraph; an end tag without a start is passed over; what is open at the end is closed."""
    out: list[Block] = []
    node = Node("", None)
    parts: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal links, linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, node, linked))
            parts.clear()
        links = linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if links:
                linked += len(text.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in RAW or tag in UNSAID:
            if not closing and not m[3].endswith("/"):
                end = (_ENDS if tag in RAW else _UNSAID_ENDS)[tag].search(page, at)
                at = end.end() if end else len(page) if tag in ("script", "style") else at
                if tag == "select":
                    flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK:
            flush()
            if closing:
                up = node
                while up is not None and up.tag != tag:
                    up = up.up
                if up is not None and up.up is not None:
                    node = up.up
            elif tag not in VOID:
                same = {"p": ("p",), "li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr"), "option": ("option",)}.get(tag, ("p",))
                while node.tag in same and node.up is not None:
                    node = node.up
                node = _node(tag, m[3], node)
    say(page[at:])
    flush()
    return out


def weigh(block: Block, aside: float = 0.0) -> float:
    """The classifier's log-odds that a block is content; aside: the weight of standing
    outside an article."""
    text, n = block.text, len(block.text)
    w = BIAS + block.node.weight + TAG_WEIGHT.get(block.node.tag, 0.0) + LINKS * min(1.0, block.linked / n) + LENGTH * min(n, LONG) / LONG
    if not block.node.inside:
        w += aside
    if text[-1] in ".!?:;…。！？\"”»)":
        w += STOP
    if _NOTICE.search(text):
        w += NOTICE
    return w


def weights(found: list[Block]) -> list[float]:
    aside = ASIDE if any(b.node.inside for b in found) else 0.0
    return [weigh(b, aside) for b in found]


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness: neighbours in page order, more where they share a parent, and a block
    with the next but one of the same parent."""
    out = []
    for i, (x, y) in enumerate(zip(found, found[1:])):
        out.append((i, i + 1, NEXT + SIBLING * _together(x.node, y.node)))
    for i, (x, y) in enumerate(zip(found, found[2:])):
        if _together(x.node, y.node):
            out.append((i, i + 2, SECOND))
    return out


def _together(a: Node, b: Node) -> bool:
    return a is b or a.up is not None and (a.up is b.up or a.up is b) or b.up is a


def minimum_cut(weights: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) that minimise the cut: w > 0 is lost where a block is called
    boilerplate, -w where it is called content, and a tie where its ends differ.

    A block whose own weight outdoes all its ties keeps its sign in every minimum cut, so
    it is settled first and its ties become weight of its neighbours; the rest is solved by
    augmenting along shortest paths.
    """
    n = len(weights)
    own = [round(w * 1000) for w in weights]
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, w in ties:
        near[i][j] = near[j][i] = near[i].get(j, 0) + round(w * 1000)
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    own[j] += w if label[i] else -w
                    del near[j][i]
                    queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        s, t = n, n + 1
        room: dict[int, dict[int, int]] = {i: {j: w for j, w in near[i].items() if label[j] is None} for i in rest}
        room[s], room[t] = {}, {}
        for i in rest:
            if own[i] > 0:
                room[s][i], room[i][s] = own[i], 0
            elif own[i] < 0:
                room[i][t], room[t][i] = -own[i], 0
        while True:
            came: dict[int, int] = {s: s}
            line = deque([s])
            while line and t not in came:
                u = line.popleft()
                for v, c in room[u].items():
                    if c > 0 and v not in came:
                        came[v] = u
                        line.append(v)
            if t not in came:
                break
            path, v = [], t
            while v != s:
                path.append((came[v], v))
                v = came[v]
            flow = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= flow
                room[v][u] = room[v].get(u, 0) + flow
        for i in rest:
            label[i] = i in came
    return [bool(x) for x in label]


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line; empty for null, empty or text-free pages."""
    found = blocks(page or "")
    if not found:
        return ""
    keep = minimum_cut(weights(found), edges(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract_main(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    Null and empty pages give an empty text; repeated rows and null ids or urls are kept as
    they are; pages of any length are read whole; other columns are not read.
    """
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def make():
        def one(batch):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

        return one

    return map_arrow(pages.select("page_id", "url", "html"), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", make)
