"""Main text of HTML pages by composite text density.

Every node of the page's tree gets its text's characters per tag, adjusted by
its links. Nodes that hold the main text have children of high density, so the
subtree with the greatest sum of its children's densities is taken; the least
density on its path to the body is the threshold that parts beside the path
must meet. Tags and roles that say what a node is (navigation, footers, scripts,
fields of forms) take it out before. Names only count as evidence: the text of a
form, or of a node whose class or id says advert, sidebar, notice or comments,
counts as link text and for no node above; such a node inside the main subtree
goes if its density so adjusted is below the threshold.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>|</([a-zA-Z][^\s>/]*)[^>]*>|<([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes")}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags and roles whose text is never main text.
_DROPPED = frozenset("script style template noscript iframe noembed noframes head title nav menu footer header aside button select option textarea input datalist".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in class and id names of adverts, menus, headers, footers, sidebars, notices, forms and comments.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr notice notices banner footer header masthead menu nav navbar navigation newsletter sidebar signup login".split()
)
#: Words after which a name tells about the rest of the page ("with-sidebar").
_ABOUT = frozenset("with has no without".split())
_INLINE_CLOSED = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "thead", "tfoot"}, "td": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "th": {"td", "th", "tr", "tbody", "thead", "tfoot"}, "option": {"option"}, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
_NOT_IN_P = _BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SCOPES = frozenset("article aside body blockquote button div dl fieldset footer form header html main nav ol section table td th ul".split())
#: What holds other blocks, in contrast to paragraphs, headings, lists and tables.
_CONTAINERS = frozenset("article center div form html main section table tbody td tr".split())
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "soft", "text")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.dropped = self.soft = False
        self.text = 0


def parse(source: str) -> Node:
    """The tree of a page: nodes' children are nodes and texts (still with references); never fails."""
    root = Node("html", "", None)
    at, here = 0, root
    while True:
        found = _TOKEN.search(source, at)
        if not found:
            if at < len(source):
                here.children.append(source[at:])
            return root
        if found.start() > at:
            here.children.append(source[at : found.start()])
        at = found.end()
        closing, opening = found.group(1), found.group(2)
        if closing:
            tag, node = closing.lower(), here
            # An end tag closes what is open inside it, but an inline one reaches no further than its block.
            while node is not root and node.tag != tag and (tag in _BLOCKS or node.tag not in _SCOPES):
                node = node.parent
            if node.tag == tag and node is not root:
                here = node.parent
        elif opening:
            tag = opening.lower()
            if tag in ("html", "body"):
                if found.group(3):
                    root.attributes += found.group(3)
                continue
            if tag in _NOT_IN_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option", "tbody", "tfoot"):
                node = here
                while node is not root and not (node.tag in _INLINE_CLOSED and tag in _INLINE_CLOSED[node.tag]) and node.tag not in _SCOPES:
                    node = node.parent
                if node.tag in _INLINE_CLOSED and tag in _INLINE_CLOSED[node.tag]:
                    here = node.parent
                    while here.tag in _INLINE_CLOSED and tag in _INLINE_CLOSED[here.tag]:
                        here = here.parent
            child = Node(tag, found.group(3) or "", here)
            here.children.append(child)
            if tag in _RAW_END:
                end = _RAW_END[tag].search(source, at)
                stop = end.start() if end else len(source)
                if tag not in ("script", "style"):
                    child.children.append(source[at:stop])
                at = end.end() if end else len(source)
            elif tag not in _VOID and not (found.group(3) or "").endswith("/"):
                here = child


def _named(value: str) -> bool:
    words = [w for w in re.split(r"[^a-z]+", value) if w]
    return any(w in _NAMES and (k == 0 or words[k - 1] not in _ABOUT) for k, w in enumerate(words))


def _drops(node: Node) -> bool:
    """Whether a node is no main text; ``soft`` is set where only a form or a name says so."""
    node.soft = node.tag in ("form", "dialog")
    if node.tag in _DROPPED:
        return not (node.tag == "header" and node.parent is not None and node.parent.tag in ("article", "main"))
    if not node.attributes:
        return False
    for m in _ATTRIBUTE.finditer(node.attributes):
        name, value = m.group(1).lower(), html.unescape((m.group(2) or "").strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _DROPPED_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name in ("class", "id") and node.tag not in ("body", "html", "article", "main") and _named(value):
            node.soft = True
    return False


def _spare(order: list[Node]) -> None:
    """Soft nodes with most of the page's text are no longer soft: half of it, or nine tenths where an article has text outside; all of them where nothing stands outside."""
    rest: dict[Node, int] = {}
    inside = set()
    for node in order:
        if node.soft or node.parent in inside:
            inside.add(node)
    for node in reversed(order):
        if node.dropped:
            continue
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.text += own
        rest[node] = rest.get(node, 0) + (0 if node in inside else own)
        if node.parent is not None:
            node.parent.text += node.text
            rest[node.parent] = rest.get(node.parent, 0) + rest[node]
    rival = any(node.tag == "article" and rest.get(node) for node in order)
    for node in order:
        if node.soft and (node.text * 10 > order[0].text * (9 if rival else 5) or not rest[order[0]]):
            node.soft = False


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Composite text density; ``ratio``: the body's link characters per character."""
    t = max(tags, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(chars / plain * link_chars + ratio * chars + math.e)
    inner = chars / max(link_chars, 1) * t / max(link_tags, 1)
    return chars / t * math.log(max(inner, 1) + 1) / math.log(max(base, 1) + math.e)


def _measure(root: Node) -> float:
    """Characters, tags, link parts and densities of every subtree, children before parents; the body's link ratio."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.dropped = node.parent is not None and (node.parent.dropped or _drops(node))
        stack += [c for c in node.children if isinstance(c, Node)]
    if any(node.soft for node in order):
        _spare(order)
    for node in reversed(order):
        if node.dropped:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.dropped and not c.soft:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.chars if c.tag == "a" else c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if node.soft:
            node.link_chars, node.link_tags = node.chars, max(node.link_tags, 1)
    ratio = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        if not node.dropped and node.chars:
            node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, ratio)
            node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.soft)
    return ratio


def _nodes(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        if not node.dropped and not node.soft:
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def main_subtree(root: Node) -> tuple[Node, float]:
    """The node of the greatest density sum, the first of equals, and the least density from it to the body.

    Where one container below has half of that sum itself, as the only long
    paragraph's has, that one is meant.
    """
    best = root
    for node in _nodes(root):
        if node.total > best.total:
            best = node
    while True:
        below = [c for c in best.children if isinstance(c, Node) and not c.dropped and not c.soft and c.tag in _CONTAINERS]
        first = max(below, key=lambda c: c.total, default=None)
        if first is None or first.total * 2 < best.total or not first.total:
            break
        best = first
    threshold, node = best.density, best.parent
    while node is not None:
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _kept_beside(node: Node, threshold: float) -> bool:
    """Whether a part beside the path is main text.

    Containers must hold as dense parts as the path; other blocks must be as
    dense where they stand in the body itself, titles and those further in not.
    """
    if node.dropped or node.soft or node.link_chars * 2 > node.chars:
        return False
    if node.tag in _CONTAINERS:
        return node.total >= threshold
    return node.density >= threshold or node.tag in ("h1", "h2") or node.parent.parent is not None


def _is_menu(node: Node) -> bool:
    return node.tag in _BLOCKS and node.link_tags > 2 and node.link_chars * 10 > node.chars * 9


def blocks(root: Node, best: Node, threshold: float, ratio: float) -> list[str]:
    """The texts of the main subtree's blocks and of what is kept beside its path, in page order, with references decoded."""
    path, node = set(), best.parent
    while node is not None:
        path.add(node)
        node = node.parent
    out: list[str] = []
    waiting: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(waiting))).strip()
        waiting.clear()
        if text:
            out.append(text)

    stack: list = [(root, False, best is root)]
    while stack:
        item, over, inside = stack.pop()
        if isinstance(item, str):
            if inside or _density(len(item.strip()), 1, 0, 0, ratio) >= threshold > 0:
                waiting.append(item)
            continue
        inside = inside or item is best
        if over:
            flush()
        elif item.tag == "br":
            waiting.append(" ")
        elif item in path:
            flush()
            stack.append((item, True, False))
            stack += [(c, False, isinstance(c, Node) and c not in path and c is not best and _kept_beside(c, threshold)) for c in reversed(item.children)]
        elif item.dropped or not inside or item.density < threshold and (item.soft or best is root and _is_menu(item)):
            if item.tag in _BLOCKS:
                flush()
        else:
            if item.tag in _BLOCKS:
                flush()
                stack.append((item, True, inside))
            stack += [(c, False, True) for c in reversed(item.children)]
    flush()
    return out


def extract(source: str | None) -> str:
    """The main text of a page; the empty text for null, for pages without text and for those that are all boilerplate."""
    if not source:
        return ""
    root = parse(source)
    ratio = _measure(root)
    if not root.chars:
        return ""
    return "\n".join(blocks(root, *main_subtree(root), ratio))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its blocks, one a line.

    A null or empty page and one without text give the empty text and 0. Rows
    that repeat a page_id, or have none, each get their row. Pages of any length
    and depth are read whole; of subtrees with equal sums the first is taken. An
    empty table gives no row. Other columns are ignored, whatever their names.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kept = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op7(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
