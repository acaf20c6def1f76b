"""Main text of pages by wrapper induction.

Pages of one host come from one template. Their trees are aligned by simple tree matching and merged
into a template tree: a node is kept with the number of pages that have it, whether its text was the
same on all of them, and how much of it is links. Runs of like siblings (paragraphs, list items) count
as one node.

A page is then aligned with the template of its host. Nodes whose text is the same on the pages of the
host are template; nodes that are mostly links are menus; what is left varies from page to page and is
content. Regions that HTML itself marks as no part of the article (nav, footer, aside, form, ...), or
that class names, ids and roles mark so, are left out, as their text may vary, too.

Templates are merged in each task first, then by host and share of the tasks, then by host, each time
as a fold over a sorted stream that holds one template. They are bounded by ``MAX_NODES``.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coinbrook.llm.common import Batches, by_arrow
from coinbrook.llm.dom import BLOCK, RAW, Node, parse
from coinbrook.sinks.scratch import materialize

#: Nodes of a template; beyond that, those on the fewest pages are forgotten. What is not in the
#: template counts as content.
MAX_NODES = 1500
#: A node is template if so many pages and half of the host's pages have it with the same text.
LEAST_PAGES = 8
LINK_SHARE = 0.6
#: Templates that a task holds before it passes them on.
HELD_HOSTS = 500

#: Elements that are no article text.
OUTSIDE = frozenset(
    "nav footer aside form script style noscript template iframe svg math canvas object audio video "
    "button select textarea datalist dialog menu head".split()
)
#: Elements that never stand for a wrapper around the article.
NO_WRAPPERS = (OUTSIDE - {"form"}) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids that mark a region as no part of the article.
MARKS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement "
    "advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments reply replies respond disqus pagination pager widget toolbar search "
    "skip copyright masthead".split()
)
#: These are so only around an article, not within it.
AROUND = frozenset(("header", "masthead", "banner"))
#: These are so even where they hold articles of their own, as comments and teasers may be marked up.
OTHER_ARTICLES = frozenset(
    "comment comments reply replies respond disqus related recommended recommendations".split()
)
CONTENT_IDS = frozenset("content main maincontent article post story entry articlebody postcontent entrycontent".split())

_VARIES = "*"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", text).lower())


def _names(node: Node) -> set[str]:
    """Words of the class names and the id."""
    return set(_words(f"{node.attribute('class') or ''} {node.attribute('id') or ''}")) if node.attributes else set()


def _hidden(node: Node) -> bool:
    lower = node.attributes.lower()
    if "hidden" in lower and (node.attribute("hidden") is not None or node.attribute("aria-hidden") == "true"):
        return True
    return "style" in lower and bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", node.attribute("style") or ""))


def _marked(node: Node, inside: bool) -> bool:
    """Whether tag, role, class or id say that the node is no article text."""
    if node.tag in OUTSIDE or (node.tag == "header" and not inside):
        return True
    if not node.attributes:
        return False
    if _hidden(node):
        return True
    if "role" in node.attributes.lower() and (node.attribute("role") or "").lower() in ROLES:
        return True
    found = _names(node) & (MARKS | AROUND)
    return bool(found - AROUND if inside else found)


def _weight(node: Node) -> int:
    """Characters of the text below a node that its tags do not rule out."""
    return sum(len(p.strip()) if isinstance(p, str) else _weight(p) for p in node.parts if not (isinstance(p, Node) and p.tag in NO_WRAPPERS))


def _is_main(node: Node) -> bool:
    return node.tag == "main" or bool(node.attributes) and node.attribute("role") == "main"


def _is_named(node: Node) -> bool:
    """Whether the id or property is a usual one of the content."""
    if not node.attributes:
        return False
    return "".join(_words(node.attribute("id") or "")) in CONTENT_IDS or node.attribute("itemprop") == "articleBody"


def _holds_article(node: Node) -> bool:
    return any(
        ((c.tag == "article" or _is_main(c) or _is_named(c)) and not _marked(c, True)) or _holds_article(c)
        for c in node.children()
    )


def _holds(node: Node, tags: tuple[str, ...]) -> bool:
    return any(c.tag in tags or _holds(c, tags) for c in node.children())


def _outside(node: Node, inside: bool, total: int) -> bool:
    """Marked, and not a wrapper around the article or most of the ``total`` characters.

    Names, roles and forms may stand for a wrapper (``has-sidebar``); regions named as comments or
    teasers are wrappers only around nearly all, as they are often longer than the article.
    """
    if not _marked(node, inside):
        return False
    if node.tag in NO_WRAPPERS or _hidden(node):
        return True
    other = bool(_names(node) & OTHER_ARTICLES) and not _holds(node, ("h1", "main"))
    if _holds_article(node):
        return other
    return 10 * _weight(node) <= (9 if other else 5) * total


# -- templates -----------------------------------------------------------------------------


class Slot:
    """A node of a template, or of a page that is about to be merged into one."""

    __slots__ = ("label", "pages", "chars", "links", "text", "kids", "nodes")

    def __init__(self, label: str, pages: int, chars: int, links: int, text: str, kids: list[Slot]) -> None:
        self.label, self.pages, self.chars, self.links = label, pages, chars, links
        #: Digest of the node's own text, '' for none, or a mark that it varies.
        self.text = text
        self.kids = kids
        #: The page's nodes; not kept in templates.
        self.nodes: list[Node] = []

    def to_list(self) -> list:
        return [self.label, self.pages, self.chars, self.links, self.text, [k.to_list() for k in self.kids]]

    @staticmethod
    def from_list(data: list) -> Slot:
        return Slot(*data[:5], [Slot.from_list(k) for k in data[5]])

    def size(self) -> int:
        return 1 + sum(k.size() for k in self.kids)


def _label(node: Node) -> str:
    if not node.attributes:
        return node.tag
    names = " ".join(sorted((node.attribute("class") or "").split())[:3])
    return f"{node.tag}.{re.sub('[0-9]+', '0', names)}#{re.sub('[0-9]+', '0', node.attribute('id') or '')}"


def slots_of(node: Node, in_link: bool = False) -> Slot:
    """The tree of a page as slots. Runs of like siblings are merged."""
    in_link = in_link or node.tag == "a"
    own = " ".join(" ".join(p for p in node.parts if isinstance(p, str)).split())
    digest = hashlib.md5(own.encode("utf-8", "surrogatepass")).hexdigest()[:12] if own else ""
    kids: list[Slot] = []
    for child in node.children():
        if child.tag in RAW or child.tag == "br":
            continue
        slot = slots_of(child, in_link)
        if kids and kids[-1].label == slot.label:
            merge(kids[-1], slot, same_page=True)
        else:
            kids.append(slot)
    chars = len(own) + sum(k.chars for k in kids)
    links = len(own) * in_link + sum(k.links for k in kids)
    made = Slot(_label(node), 1, chars, links, digest, kids)
    made.nodes = [node]
    return made


def _matching(a: list[Slot], b: list[Slot]) -> list[tuple[int, int]]:
    """Simple tree matching of two ordered lists of children: pairs that keep the order and match most."""
    if [x.label for x in a] == [x.label for x in b]:
        return [(k, k) for k in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    score: dict[tuple[int, int], int] = {}
    for i in range(len(a)):
        for j in range(len(b)):
            score[i, j] = _score(a[i], b[j])
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + score[i, j])
    pairs = []
    i, j = len(a), len(b)
    while i and j:
        if score[i - 1, j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def _score(a: Slot, b: Slot) -> int:
    """Number of nodes of the largest common tree below two nodes of one label."""
    if a.label != b.label:
        return 0
    return 1 + sum(_score(a.kids[i], b.kids[j]) for i, j in _matching(a.kids, b.kids))


def merge(into: Slot, other: Slot, same_page: bool = False) -> None:
    """Align two trees of one label and merge the second into the first."""
    if into.text != other.text:
        into.text = _VARIES
    if not same_page:
        into.pages += other.pages
    into.chars += other.chars
    into.links += other.links
    into.nodes = into.nodes + other.nodes
    pairs = _matching(into.kids, other.kids)
    kids: list[Slot] = []
    i = j = 0
    for p, q in [*pairs, (len(into.kids), len(other.kids))]:
        kids += into.kids[i:p] + other.kids[j:q]
        if p < len(into.kids):
            merge(into.kids[p], other.kids[q], same_page)
            kids.append(into.kids[p])
        i, j = p + 1, q + 1
    into.kids = kids


def _prune(template: Slot) -> Slot:
    """Forget the nodes on the fewest pages until the template is within its bound."""
    least = 1
    while template.size() > MAX_NODES:
        least *= 2

        def keep(slot: Slot) -> None:
            slot.kids = [k for k in slot.kids if k.pages >= least]
            for k in slot.kids:
                keep(k)

        keep(template)
    return template


def _forget_nodes(slot: Slot) -> Slot:
    slot.nodes = []
    for k in slot.kids:
        _forget_nodes(k)
    return slot


def _template_batch(templates: dict[str, Slot], share: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(list(templates), pa.string()),
            pa.array([share] * len(templates), pa.int32()),
            pa.array([json.dumps(_prune(t).to_list()).encode() for t in templates.values()], pa.binary()),
        ],
        names=["host", "share", "template"],
    )


def _fold(templates: DataFrame, *keys: str) -> DataFrame:
    """Merge the templates of each key, one after the other."""

    def fold(batches: Batches) -> Batches:
        rows = (r for b in batches for r in b.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: tuple(r[k] for k in keys)):
            first = next(group)
            merged = Slot.from_list(json.loads(first["template"]))
            for row in group:
                merge(merged, Slot.from_list(json.loads(row["template"])))
                _prune(merged)
            yield _template_batch({first["host"]: merged}, first["share"])

    ordered = templates.repartition(*keys).sortWithinPartitions(*keys)
    return by_arrow(ordered, fold, "host string, share int, template binary")


def host_of(url: Column) -> Column:
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.lower(F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame, shares: int = 64) -> DataFrame:
    """``host`` and ``template`` (a tree as JSON) over all pages of each host."""

    def build(batches: Batches) -> Batches:
        share = TaskContext.get().partitionId() % shares
        held: dict[str, Slot] = {}
        for b in batches:
            for host, text in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = _forget_nodes(slots_of(parse(text or "")))
                if host in held:
                    merge(held[host], own)
                    _prune(held[host])
                else:
                    held[host] = own
            if len(held) > HELD_HOSTS:
                yield _template_batch(held, share)
                held = {}
        yield _template_batch(held, share)

    rows = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string"))
    built = by_arrow(rows, build, "host string, share int, template binary")
    return _fold(_fold(built, "host", "share"), "host").select("host", "template")


# -- extraction ----------------------------------------------------------------------------


def _aligned(template: Slot, page: Slot) -> Iterator[tuple[Slot, Slot]]:
    yield template, page
    for i, j in _matching(template.kids, page.kids):
        yield from _aligned(template.kids[i], page.kids[j])


def _varies(slot: Slot) -> bool:
    return slot.text == _VARIES or any(_varies(k) for k in slot.kids)


def template_nodes(template: Slot, page: Slot) -> tuple[set[int], set[int]]:
    """The page's nodes (by ``id``) whose own text is the template's, and those that are menus."""
    constant: set[int] = set()
    menus: set[int] = set()
    if template.pages < LEAST_PAGES or not _varies(template):
        return constant, menus
    for held, own in _aligned(template, page):
        if held.pages < LEAST_PAGES or 2 * held.pages < template.pages:
            continue
        if held.text not in ("", _VARIES) and held.text == own.text:
            constant.update(id(n) for n in own.nodes)
        if held.kids and held.links > LINK_SHARE * held.chars:
            menus.update(id(n) for n in own.nodes)
    return constant, menus


def _roots(root: Node) -> list[Node]:
    """Where the article is: all articles, else the main element, else the whole page."""
    total = _weight(root)

    def search(node: Node, wanted: Callable[[Node], bool]) -> Iterator[Node]:
        for child in node.children():
            if _outside(child, False, total):
                continue
            if wanted(child):
                yield child
            else:
                yield from search(child, wanted)

    for wanted in (lambda n: n.tag == "article", _is_main, _is_named):
        found = [n for n in search(root, wanted) if _weight(n)]
        if found:
            return found
    return [root]


def main_text(html_text: str | None, template: Slot | None) -> str:
    """The article of a page: blocks in order, joined by a space."""
    root = parse(html_text or "")
    constant, menus = template_nodes(template, slots_of(root)) if template else (set(), set())
    roots = _roots(root)
    whole = roots == [root]
    pieces: list[str] = []

    def collect(node: Node, total: int) -> None:
        for part in node.parts:
            if isinstance(part, str):
                if id(node) not in constant:
                    pieces.append(part)
                continue
            # Within an article, links are part of the text.
            if part.tag in RAW or _outside(part, not whole, total) or (whole and id(part) in menus):
                continue
            block = part.tag in BLOCK
            pieces.append(" " * block)
            collect(part, total)
            pieces.append(" " * block)

    for node in roots:
        pieces.append(" ")
        collect(node, _weight(node))
    return " ".join("".join(pieces).split())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    Null html counts as empty and gives an empty text; a null url belongs to the host ''. Hosts with
    under ``LEAST_PAGES`` pages, or whose pages do not differ, have no template to tell by; then only
    the marks of HTML count. Rows that repeat are each extracted. An empty table gives no rows.
    """
    templates = materialize(induce(pages), "templates")
    rows = pages.select("page_id", "url", F.col("html").cast("string"), host_of(F.col("url")).alias("host"))
    rows = rows.join(templates, "host", "left").select("page_id", "url", "html", "host", "template")

    def read(batches: Batches) -> Batches:
        known: dict[str, Slot | None] = {}
        for b in batches:
            texts = []
            hosts, found = b.column("host").to_pylist(), b.column("template")
            for k, (host, text) in enumerate(zip(hosts, b.column("html").to_pylist(), strict=True)):
                if host not in known:
                    if len(known) > HELD_HOSTS:
                        known.clear()
                    data = found[k].as_py()
                    known[host] = Slot.from_list(json.loads(data)) if data else None
                texts.append(main_text(text, known[host]))
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    kinds = {f.name: f.dataType for f in rows.schema}
    done = by_arrow(rows, read, "text string", page_id=kinds["page_id"], url=kinds["url"])
    return done.withColumn("n_chars", F.length("text").cast("long"))
