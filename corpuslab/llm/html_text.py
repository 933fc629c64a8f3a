"""The main text of web pages, found by composite text density.

Every node of the page's tree has the number of characters and tags below it, and how many of them are
in links. Its density is characters per tag, adjusted for links: a node full of links counts little.
A node's density sum is the sum over its children. The node with the largest sum is the core of the
content; the least density on the way from it up to the body is the threshold. Of every branch beside that
way that is as dense as the threshold, its own largest-sum subtree belongs to the content, too. A core
within an ``article`` or ``main`` element stands for all of that element.

What an element is comes first: menus, headers, footers, scripts, styles and the like have no characters at all. So
have forms and what names itself a sidebar, notice, advert or reader comment, unless it holds the text of the page: a
wrapper beside which hardly anything would be left keeps its text, whatever its name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslab.llm.batches import field, texts, with_python

# Elements of HTML and usual names of page parts.
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup
    option p pre search section select summary table tbody td tfoot th thead title tr ul""".split()
)
DROPPED = frozenset(
    """aside audio button canvas datalist dialog footer head header input label math menu nav object
    option search select svg video""".split()
    + sorted(RAW)
)
NAMES = frozenset(
    """ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disqus footer form header login menu modal nav navbar navigation newsletter notice notices
    pager pagination popup promo related replies reply search share sidebar signup social sponsor
    sponsored subscribe toolbar widget""".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split()
)
REMARKS = frozenset("comment comments disqus replies reply".split())
#: Words of a class after which a name tells of a state of the page: "with-sidebar" is no sidebar.
STATES = frozenset("with without has no not".split())
LEAST_CHARS = 200
"""A part with a name is a wrapper only if it has so many characters outside links."""
WRAPPED, WRAPPED_REMARKS = 10, 50
"""It has so many times what is left beside all such parts; the second one if it is named for comments."""
#: What an open element of the key is closed by.
CLOSED_BY = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "td": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "th": {"td", "th", "tr", "tbody", "tfoot", "thead"},
    "tr": {"tr", "tbody", "tfoot", "thead"},
    "p": BLOCK - {"caption", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"},
}
CLOSERS = frozenset().union(*CLOSED_BY.values())
SCOPE = frozenset("html body table td th ul ol dl div article section main aside".split())

#: Elements that only hold the parts of a list or table.
PARTED = frozenset("dir dl menu ol optgroup select table tbody tfoot thead tr ul".split())

_MARK = re.compile(r"<(?=[A-Za-z/!?])")
#: A quote opens a quoted value only straight after "="; elsewhere it is a letter of a name or a value.
_VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+"""
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*+){_VALUE}")
_TAG = re.compile(
    r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+" + re.sub(r"\((?=[\"'\[])", "(?:", _VALUE) + ")*+)>"
)
_READ = frozenset("class id role hidden".split())
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Node:
    __slots__ = ("name", "parent", "children", "dropped", "part", "first", "stop", "chars", "tags",
                 "link_chars", "link_tags", "density", "sum", "in_link")

    def __init__(self, name: str, parent: Node | None, dropped: bool, first: int):
        self.name, self.parent, self.dropped, self.first = name, parent, dropped, first
        self.part = 0
        self.children: list[Node] = []
        self.stop = first
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0
        self.in_link = name == "a" or (parent is not None and parent.in_link)


def _part_words(value: str) -> set[str]:
    """Words of a class or id, without those that tell of a state."""
    found = set()
    for token in value.split():
        for word in _WORD.findall(token):
            if word.lower() in STATES:
                break
            found.add(word.lower())
    return found


def _named_part(name: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is hidden, and the factor that makes it a wrapper if it is named as a part, else 0."""
    if name in ("html", "body", "main"):
        return False, 0
    part = WRAPPED if name == "form" else 0
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes.strip() else ():
        key, value = key.lower(), "".join(values)
        if key not in _READ:
            continue
        if key == "hidden":
            return True, 0
        if key == "role":
            if value.strip().lower() in ROLES:
                part = max(part, WRAPPED)
            continue
        words = _part_words(value)
        if words & REMARKS:
            part = WRAPPED_REMARKS
        elif name != "article" and words & NAMES:
            part = max(part, WRAPPED)
    return False, part


def drop_parts(root: Node) -> None:
    """Drop the parts that are named as such, but for a wrapper and what it is in.

    What a part would give is counted without the parts in it, and without links.
    """
    order = [root]
    for node in order:
        order.extend(c for c in node.children if not c.dropped)
    parts = [n for n in order if n.part]
    if not parts:
        return
    held = {id(n): n.chars - n.link_chars for n in order}
    for node in reversed(order[1:]):
        if not node.part:
            held[id(node.parent)] += held[id(node)]
    fullest = max(parts, key=lambda n: held[id(n)])
    if held[id(fullest)] >= LEAST_CHARS and held[id(root)] * fullest.part < held[id(fullest)]:
        node: Node | None = fullest
        while node is not None:
            node.part, node = 0, node.parent
    for node in parts:
        node.dropped = node.part > 0


def parse(page: str) -> tuple[Node, list]:
    """The tree, and the page's texts and block borders (None) in order.

    Elements that HTML lets stay open are closed by what follows them; end tags without a start
    are left out, and so is a tag that the end of the page cuts off, up to the next ``>`` if it holds one.
    """
    root = Node("#", None, False, 0)
    flow: list[str | None] = []
    stack, at, size = [root], 0, len(page)
    #: How many elements of a name are open, and the depths of those that end or stop an implied end.
    opened: Counter[str] = Counter()
    ends: list[int] = []

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            opened[node.name] -= 1
            if ends and ends[-1] == len(stack):
                ends.pop()
            if node.name in BLOCK:
                flow.append(None)
            node.stop = len(flow)

    def push(node: Node) -> None:
        opened[node.name] += 1
        if node.name in CLOSED_BY or node.name in SCOPE:
            ends.append(len(stack))
        stack.append(node)

    def text(start: int, stop: int) -> None:
        top = stack[-1]
        if start < stop and not top.dropped:
            said = html.unescape(page[start:stop])
            flow.append(said)
            n = len(" ".join(said.split()))
            top.chars += n
            if top.in_link:
                top.link_chars += n

    while at < size:
        mark = _MARK.search(page, at)
        begin = mark.start() if mark else size
        text(at, begin)
        if not mark:
            break
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        tag = _TAG.match(page, begin)
        if not tag:
            # A declaration, or a tag that is cut off.
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if opened[name] > 0:
                while stack[-1].name != name:
                    close(len(stack) - 1)
                close(len(stack) - 1)
            continue
        # An open element is closed by one of its own name, so few lie between two that stop the search.
        for depth in reversed(ends) if name in CLOSERS else ():
            open_name = stack[depth].name
            if name in CLOSED_BY.get(open_name, ()):
                close(depth)
                break
            if open_name in SCOPE and open_name not in CLOSED_BY:
                break
        parent = stack[-1]
        if name in BLOCK:
            flow.append(None)
        hidden, part = _named_part(name, tag[3])
        node = Node(name, parent, parent.dropped or hidden or name in DROPPED, len(flow))
        node.part = part
        parent.children.append(node)
        if name in VOID:
            if name == "br" and not node.dropped:
                flow.append(" ")
            node.stop = len(flow)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else size
            push(node)
        else:
            push(node)
    close(0)
    return root, flow


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums; gives the nodes, parents first."""
    order = [root]
    for node in order:
        order.extend(c for c in node.children if not c.dropped)
    for node in reversed(order):
        for child in node.children:
            if not child.dropped:
                linked = child.name == "a"
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + linked
    body = next((n for n in order if n.name == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in order:
        chars, tags = node.chars, max(1, node.tags)
        links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
        if chars:
            plain = max(1, chars - node.link_chars)
            base = math.log(chars / plain * node.link_chars + share * chars + math.e)
            inside = max(1.0, chars / links * tags / link_tags)
            node.density = chars / tags * math.log(inside + 1e-9) / max(1e-9, math.log(base + 1e-9))
            node.density = max(0.0, node.density) if base > 1.0001 else chars / tags
    for node in order:
        node.sum = sum(c.density for c in node.children if not c.dropped) or node.density
    return order


def _fullest(node: Node) -> Node:
    """The node of the subtree with the largest sum, of those that hold blocks; the outermost of equals."""
    best, todo = node, [node]
    while todo:
        here = todo.pop()
        holds = here.name not in PARTED and any(c.name in BLOCK and not c.dropped for c in here.children)
        if holds and here.sum > best.sum:
            best = here
        todo.extend(c for c in reversed(here.children) if not c.dropped)
    return best


def content_nodes(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    order = measure(root)
    body = next((n for n in order if n.name == "body"), root)
    core = _fullest(body)
    way, node = [core], core
    while node is not body and node.parent is not None:
        node = node.parent
        way.append(node)
    named = [n for n in way if n.name in ("article", "main")]
    if named:
        core = named[-1]
        way = way[way.index(core) :]
    threshold = min((n.density for n in way if n is not body), default=core.density)
    found, passed = [core], set(map(id, way))
    for node in way[1:]:
        found.extend(
            _fullest(c)
            for c in node.children
            if id(c) not in passed and not c.dropped and c.chars and c.density >= threshold
        )
    return sorted(found, key=lambda n: n.first)


def main_text(page: str) -> str:
    """Blocks of the main text, one a line."""
    root, flow = parse(page)
    drop_parts(root)
    hidden, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.dropped:
            hidden.append((node.first, node.stop))
        else:
            todo.extend(node.children)
    for start, stop in hidden:
        for i in range(start, stop):
            if flow[i] is not None:
                flow[i] = ""
    blocks, held = [], []
    for node in content_nodes(root):
        for piece in [*flow[node.first : node.stop], None]:
            if piece is not None:
                held.append(piece)
            elif held:
                blocks.append(" ".join("".join(held).split()))
                held = []
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame, page: str = "html", text: str = "main_text") -> DataFrame:
    """Add the main text of each whole page; empty for null, for an empty page and for one without text.

    An input column with the name of the new one is replaced.
    """

    def setup():
        def make(column):
            return [pa.array([main_text(t) for t in texts(column)], pa.string())]

        return make

    added = T.StructType([T.StructField(text, T.StringType())])
    return with_python(pages, [field(page)], added, setup)


def with_length(extracted: DataFrame, text: str = "text") -> DataFrame:
    return extracted.withColumn("n_chars", F.length(field(text)).cast("long"))
