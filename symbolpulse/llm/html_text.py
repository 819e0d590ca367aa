"""Main text of web pages by scoring the element tree.

Every paragraph passes points for its length and commas to its ancestors, less with each
level; an element's points are discounted by the share of its text that stands in links.
The best element, or the article around it, is kept together with its good siblings;
menus, notices, adverts, forms and comments inside are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, spare

# Element names by their role in a page, and words of class, id and role
# attributes that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset(
    "aside audio button canvas dialog embed fieldset footer form frame frameset head header iframe input label link "
    "math menu meta nav noembed noframes noscript object script select style svg template textarea title video xmp".split()
)
# Of these, the ones that some sites put around a whole page or article.
WRAPPERS = frozenset("dialog fieldset form header object".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li "
    "main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"} | {
    "aside", "dialog", "fieldset", "footer", "form", "header", "menu", "nav"
}
ALWAYS, PARTS = DROPPED - WRAPPERS, BLOCKS | WRAPPERS
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(["article", "main"])
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices "
    "outbrain pager pagination popup promo promoted promotion related reply replies search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*>|([^<]++|<)""", re.S
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
NAME = re.compile(r"[a-z0-9]+")


class Node:
    """An element, with text and elements as its children."""

    __slots__ = ("tag", "parent", "children", "furniture", "points", "chars", "linked", "main", "whole")

    def __init__(self, tag: str, parent: Node | None, furniture: bool = False):
        self.tag, self.parent, self.furniture = tag, parent, furniture
        self.children: list[Node | str] = []
        self.points, self.chars, self.linked, self.main = 0.0, 0, 0, tag in MAIN
        self.whole = 0


def is_furniture(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id") and not FURNITURE.isdisjoint(NAME.findall(value)):
            return True
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(page: str) -> Node:
    """The element tree of a page; forgiving about tags that are never closed."""
    root = here = Node("#page", None)
    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        if m[4]:
            here.children.append(m[4])
        elif m[2]:
            tag = m[2].lower()
            if m[1]:
                here = _closed(here, tag)
                continue
            if tag in CLOSES_P:
                here = _closed(here, "p", stop=("td", "th", "button", "div", "article", "section"))
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
                for other in same:
                    here = _closed(here, other, stop=("ul", "ol", "dl", "table", "select"))
            node = Node(tag, here, tag in ALWAYS or bool(m[3]) and is_furniture(m[3]))
            here.children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not m[3].endswith("/"):
                here = node
    return root


def _closed(here: Node, tag: str, stop: tuple[str, ...] = ()) -> Node:
    """Where the reader stands after ``tag`` ends; as before if none is open."""
    node = here
    while node.parent is not None and node.tag != tag:
        if node.tag in stop:
            return here
        node = node.parent
    return node.parent if node.parent is not None else here


def _in_order(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def score(root: Node) -> list[Node]:
    """Count text and links upwards and pass the paragraphs' points on; the kept elements."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        node.whole += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.parent is not None:
            node.parent.main |= node.main
            node.parent.whole += 0 if _is_left_out(node) else node.whole
    dropped: set[int] = set()
    kept = []
    for node in nodes:
        inside = node.parent is not None and id(node.parent) in dropped
        # A wrapper stays where it holds the main element or most of the page's text.
        small = node.tag in WRAPPERS and not node.main and 2 * node.whole <= root.whole
        if inside or small or _is_left_out(node):
            dropped.add(id(node))
        else:
            kept.append(node)
    for node in reversed(kept):
        own = "".join(c for c in node.children if isinstance(c, str)).strip()
        node.chars += len(own)
        if node.tag == "a":
            node.linked = node.chars
        if own or node.tag in SCORED:
            _pass_points(node, own)
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return kept


def _is_left_out(node: Node) -> bool:
    """Furniture of the page by name or attributes; wrappers are judged by their share of the text."""
    if node.tag in ALWAYS:
        return True
    return node.furniture and not node.main and node.tag not in ("html", "body")


def _pass_points(node: Node, own: str) -> None:
    """Points of a paragraph, or of text that stands in a container itself."""
    if node.tag in SCORED:
        chars, to = node.chars, node.parent
    elif node.tag in PARTS:
        chars, to = len(own), node
    else:
        return
    if not chars:
        return
    points = (1 + own.count(",") + chars / 100) * (1 - node.linked / max(chars, node.linked))
    level = 0
    while to is not None:
        to.points += points / (1, 2, 6, 9)[level] if level < 4 else 0
        to, level = to.parent, level + 1


def _rated(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def best_parts(root: Node, kept: list[Node]) -> list[Node]:
    """The article around the best container, or that container and its good siblings."""
    inner = [n for n in kept if n.tag not in SCORED and n.tag not in ("#page", "html")] or [root]
    best = max(inner, key=_rated)
    if _rated(best) <= 0:
        return [root]
    around = best
    while around is not None and around.tag not in MAIN:
        around = around.parent
    if around is not None:
        while around.parent is not None and any(a.tag in MAIN for a in _ancestors(around)):
            around = next(a for a in _ancestors(around) if a.tag in MAIN)
        return [around]
    if best.parent is None or best.tag == "body":
        return [best]
    alive, enough = set(map(id, kept)), _rated(best) / 5
    return [
        n
        for n in best.parent.children
        if not isinstance(n, str)
        and id(n) in alive
        and (n is best or n.tag in SCORED and n.linked * 4 < n.chars or n.tag not in SCORED and _rated(n) >= enough)
    ]


def _ancestors(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def blocks_of(parts: list[Node], kept: list[Node]) -> list[str]:
    """Text blocks in page order: references decoded, blanks made one space."""
    alive, out, line = set(map(id, kept)), [], []

    def end() -> None:
        text = BLANKS.sub(" ", unescape("".join(line))).strip(" ")
        line.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = list(reversed(parts))
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif id(item) in alive:
            if item.tag == "br":
                line.append(" ")
            elif item.tag in PARTS:
                end()
                todo.append(None)
                todo += reversed(item.children)
            else:
                todo += reversed(item.children)
    end()
    return out


def main_text(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    kept = score(root)
    return "\n".join(blocks_of(best_parts(root, kept), kept))


def extract_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the column ``text``: the main text of each whole page.

    Null and empty pages give an empty text.  Rows are independent, repeated rows repeat
    the result; other columns stay, one named like ``text`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names)

    kept = pages.drop(text)
    names = [*kept.columns, text]
    shape = kept.withColumn(text, F.lit("")).schema
    return map_texts(pages.select(*kept.columns, F.col(html).alias(spare(pages, "_html"))), run, shape)
