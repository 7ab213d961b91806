"""HTML as a tree per page, and as a node table.

The standard library gives tokens only; ``parse`` builds a tree from them with void
elements, raw text, implied end tags, table sections, and misnested formatting: what is
still open when its block ends is opened anew behind it, and a block within a formatting
element that ends first is taken out of it. The node table numbers nodes in document order
and gives each the number of its last descendant, so that "within" is a range of numbers
and "child" an equality of the parent's number.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread

# Elements without content, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
# Blocks before which an open paragraph ends.
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
HEAD_ONLY = frozenset("base link meta title script style noscript template".split())
# An opening tag ends these open ones, up to the scope they live in.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("td", "th", "tr", "caption"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)),
}
BLOCKS = ENDS_P | frozenset("body html li dt dd tr td th thead tbody tfoot caption figcaption summary legend option br".split())
# Formatting elements, which are opened anew where a block cut them.
FORMATS = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CELLS = ("td", "th", "caption")
_SPACE = re.compile(r"[\t\n\f\r \xa0]+")
DEEPEST = 512


class Node:
    """An element; text children are plain strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def elements(self) -> Iterator[Node]:
        """Elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for c in stack[-1]:
                if isinstance(c, Node):
                    yield c
                    stack.append(iter(c.children))
                    break
            else:
                stack.pop()

    def find(self, *tags: str) -> Iterator[Node]:
        return (n for n in self.elements() if n.tag in tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.find(*tags), None)

    def kids(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def up(self) -> Iterator[Node]:
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def tokens(self, name: str) -> list[str]:
        return self.attrs.get(name, "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def unwrap(self) -> None:
        at = next(i for i, c in enumerate(self.parent.children) if c is self)
        for c in self.children:
            if isinstance(c, Node):
                c.parent = self.parent
        self.parent.children[at : at + 1] = self.children

    def own_text(self) -> str:
        """Text that stands in the element itself; none of scripts and styles."""
        return _SPACE.sub(" ", "".join(c for c in self.children if isinstance(c, str))).strip() if self.tag not in RAW else ""

    def text(self) -> str:
        """Text as read: blocks apart, white space collapsed, scripts and styles left out."""
        parts: list[str] = []
        _text(self, parts)
        return _SPACE.sub(" ", "".join(parts)).strip()


def _text(node: Node, parts: list[str]) -> None:
    stack: list[Node | str] = [node]
    while stack:
        c = stack.pop()
        if isinstance(c, str):
            parts.append(c)
            continue
        if c.tag in ("script", "style", "template", "noscript"):
            continue
        if c.tag in BLOCKS:
            parts.append(" ")
            stack.append(" ")
        stack.extend(reversed(c.children))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document", {}, None)
        self.html = Node("html", {}, self.root)
        self.head = Node("head", {}, self.html)
        self.body = Node("body", {}, self.html)
        self.root.children = [self.html]
        self.html.children = [self.head, self.body]
        self.open: list[Node] = [self.body]
        self.active: list[Node | None] = []  # formatting not ended yet; None where a cell began
        self.in_head = True

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        k = len(self.open) - 1
        while k > 0 and self.open[k].tag not in scope:
            if self.open[k].tag in tags:
                self._cut(k)
            k -= 1

    def _cut(self, k: int) -> None:
        """Ends all open elements from the ``k``-th on; formatting stays active, but none of a
        cell's beyond the cell."""
        for n in self.open[k:]:
            if n.tag in CELLS and None in self.active:
                del self.active[len(self.active) - 1 - self.active[::-1].index(None) :]
        del self.open[k:]

    def _reopen(self) -> None:
        """Opens active formatting that a block's end cut off."""
        k = len(self.active)
        while k and self.active[k - 1] is not None and not any(n is self.active[k - 1] for n in self.open):
            k -= 1
        for i in range(k, len(self.active)):
            old = self.active[i]
            if len(self.open) < DEEPEST:
                self.active[i] = self._push(old.tag, dict(old.attrs), self.open[-1])

    def _end_format(self, tag: str) -> None:
        """Ends the last active formatting element of a tag. A block open within it moves behind
        it, and what the block holds so far is formatted by a copy."""
        at = next((i for i in range(len(self.active) - 1, -1, -1) if self.active[i] is None or self.active[i].tag == tag), None)
        if at is None or self.active[at] is None:
            return self._end_plain(tag)
        node = self.active.pop(at)
        k = next((i for i, n in enumerate(self.open) if n is node), None)
        if k is None:
            return None
        blocks = [n for n in self.open[k + 1 :] if n.tag in BLOCKS]
        if not blocks:
            return self._cut(k)
        above = self.open[k - 1]
        self.open = self.open[:k] + blocks
        for block in blocks:  # each one taken out of the formatting around it, in turn
            block.remove()
            copy = Node(tag, dict(node.attrs), block)
            copy.children = block.children
            for c in copy.children:
                if isinstance(c, Node):
                    c.parent = copy
            block.children, block.parent = [copy] if copy.children else [], above
            above.children.append(block)
            above = block

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known: dict[str, str] = {}
        for k, v in attrs:
            known.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            node = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in known.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self.in_head = False
            return
        if self.in_head and tag in HEAD_ONLY and len(self.open) == 1:
            parent = self.head
        else:
            self.in_head = False
            if tag in ENDS_P:
                self._close(("p",), ("table", "td", "th", "button", "body"))
            if tag in CLOSES:
                self._close(*CLOSES[tag])
            elif tag == "a" and any(n is not None and n.tag == "a" for n in self.active[len(self.active) - self.active[::-1].index(None) if None in self.active else 0 :]):
                self._end_format("a")
            if self.active and tag not in BLOCKS and tag not in RAW and tag not in CLOSES:
                self._reopen()
            parent = self.open[-1]
            if tag in ("td", "th") and parent.tag in ("table", "thead", "tbody", "tfoot"):
                parent = self._push("tr", {}, parent)
        node = Node(tag, known, parent)
        parent.children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
            if tag in FORMATS:
                alike = [i for i, n in enumerate(self.active) if n is not None and n.tag == tag and n.attrs == known]
                if len(alike) > 2:  # no more than three alike are kept
                    del self.active[alike[0]]
                self.active.append(node)
            elif tag in CELLS:
                self.active.append(None)

    def _push(self, tag: str, attrs: dict[str, str], parent: Node) -> Node:
        node = Node(tag, attrs, parent)
        parent.children.append(node)
        self.open.append(node)
        return node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and "/" in (self.get_starttag_text() or "")[-2:] and tag in ("svg", "path", "use"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        if tag in FORMATS:
            self._end_format(tag)
        else:
            self._end_plain(tag)

    def _end_plain(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self._cut(k)
                return
            if self.open[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot"):
                return

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if len(self.open) == 1 and self.in_head:
            if not data.strip():
                return
            self.in_head = False
        if self.open[-1].tag in ("table", "thead", "tbody", "tfoot", "tr") and not data.strip():
            return
        if self.active and top.tag not in RAW and top.tag not in ("title", "textarea", "table", "thead", "tbody", "tfoot", "tr"):
            self._reopen()
            top = self.open[-1]
        top.children.append(data)


def parse(html: str | None) -> Node:
    """The document tree of a page; an empty tree for null."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def body_of(root: Node) -> Node:
    return root.children[0].children[1]


# --- node table -------------------------------------------------------------------

NODES = "page_id long, node_id int, parent_id int, last_desc int, depth int, tag string, attrs map<string,string>, own_text string, text string, hidden boolean"


def is_hidden(n: Node) -> bool:
    style = n.attrs.get("style", "").replace(" ", "").lower()
    return "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def nodes_of(root: Node) -> Iterator[tuple]:
    """Rows of the node table in document order (after the page id)."""
    order = list(root.elements())
    number = {id(n): i for i, n in enumerate(order)}
    last = {i: i for i in range(len(order))}
    depth, hidden = {}, {}
    for i in range(len(order) - 1, -1, -1):
        p = number.get(id(order[i].parent))
        if p is not None:
            last[p] = max(last[p], last[i])
    for i, n in enumerate(order):
        p = number.get(id(n.parent))
        depth[i] = 0 if p is None else depth[p] + 1
        hidden[i] = is_hidden(n) or (p is not None and hidden[p])
        yield i, -1 if p is None else p, last[i], depth[i], n.tag, list(n.attrs.items()), n.own_text(), n.text(), hidden[i]


def node_table(pages: DataFrame, page_id: str = "page_id", html: str = "html", texts: bool = True) -> DataFrame:
    """One row per element. ``texts=False`` leaves the text of whole subtrees out, which is
    quadratic in depth. Null pages give no rows; broken markup is read as far as it goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in NODES.split(", ")]
        for batch in batches:
            rows = []
            for i, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h is None:
                    continue
                for r in nodes_of(parse(h)):
                    rows.append((i, *r[:7], r[7] if texts else None, r[8]))
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return spread(pages.select(F.col(page_id).cast("long"), html)).mapInArrow(run, NODES)


def per_page(pages: DataFrame, f: Callable[..., list[tuple]], schema: str, page_id: str = "page_id", html: str = "html", extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows that a page function makes of each page's tree: ``f(root, *extra)`` gives the
    rows' values after ``page_id``. One Arrow pass; only the named columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        target = to_arrow_schema(StructType.fromJson(schema_json))
        for batch in batches:
            rows = []
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for i, h, *more in zip(*columns):
                if h is not None:
                    rows.extend((i, *r) for r in f(parse(h), *more))
            cells = list(zip(*rows)) if rows else [[] for _ in target]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cells, target)], schema=target)

    from pyspark.sql.types import StructType

    full = StructType.fromDDL(f"page_id long, {schema}")
    schema_json = full.jsonValue()
    return spread(pages.select(F.col(page_id).cast("long"), html, *extra)).mapInArrow(run, full)
