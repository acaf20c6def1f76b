"""A forgiving HTML parser that builds a small tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

#: Elements without content, fixed by HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: Elements that end the block that they stand in.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Start tags that end an open paragraph, as BLOCK without those that may stand in one.
_ENDS_P = BLOCK - frozenset("br button option optgroup select caption td th tr tbody thead tfoot".split())
#: Start tags that end an open element of these names, up to the container.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "body": (("head",), ("html",)),
}
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>"""
    r"""|</([a-zA-Z][^\s/>]*)[^>]*>"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Deeper elements become children of the last one that is counted, so recursion stays bounded.
MAX_DEPTH = 150


class Node:
    __slots__ = ("tag", "attributes", "parts")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag = tag
        self.attributes = attributes
        self.parts: list[Node | str] = []

    def attribute(self, name: str) -> str | None:
        """The value of an attribute, '' if it has none, null if it is missing."""
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None

    def children(self) -> Iterator[Node]:
        return (p for p in self.parts if isinstance(p, Node))


def parse(text: str) -> Node:
    """The tree of a page, below a node without a name."""
    root = Node("")
    stack = [root]

    def end(names: tuple[str, ...], container: tuple[str, ...]) -> None:
        """Close the outermost open element of these names that lies within the container."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in container:
                return
            if stack[k].tag in names:
                del stack[k:]
                if not any(n in (s.tag for s in stack) for n in names):
                    return
                end(names, container)
                return

    at = 0
    while (m := _TOKEN.search(text, at)) is not None:
        if m.start() > at:
            stack[-1].parts.append(html.unescape(text[at : m.start()]))
        at = m.end()
        if m[1]:
            name = m[1].lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                # A stray end tag of something inline does not close blocks around it.
                if name not in BLOCK and stack[k].tag in BLOCK:
                    break
            continue
        name = (m[2] or m[4] or "").lower()
        if not name:
            continue
        attributes = m[3] if m[2] else m[5]
        if name in _ENDS_P:
            end(("p",), ("table", "article", "section", "div", "li", "td"))
        if name in _ENDS:
            end(*_ENDS[name])
        node = Node(name, attributes)
        stack[-1].parts.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(text, at)
            inner = text[at : close.start() if close else len(text)]
            if name == "title":
                node.parts.append(html.unescape(inner))
            at = close.end() if close else len(text)
        elif name not in VOID and not attributes.endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    if at < len(text):
        stack[-1].parts.append(html.unescape(text[at:]))
    return root
