"""HTML to node and link tables. Parsing tag soup is the one thing here that needs Python; it runs on Arrow batches."""

from __future__ import annotations

import html
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkloom.functions.paths import format_attr_text
from linkloom.sources.scratch import bounded_batches

# Elements of the HTML language by their role in repair.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link base style script".split())
DROPPED = frozenset(("script", "style"))
CLOSES_P = frozenset(
    "address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An opening tag closes an open one of these, unless one of the barriers stands between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "pos", "cls")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.pos, self.cls = 0, None

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return "".join(out)


class _Builder(HTMLParser):
    """Builds html/head/body trees; deterministic for any input."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head: Node | None = None
        self.body: Node | None = None
        self.open = [self.root]
        self.dropped = dropped
        self.skip = 0

    def _child(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        return node

    def _enter(self, tag: str) -> None:
        """Makes sure that head or body is open before content."""
        if len(self.open) > 1 and (self.open[1] is self.body or tag in HEAD):
            return
        if self.body is None and tag in HEAD:
            if self.head is None:
                self.head = self._child("head", {})
            self.open = [self.root, self.head]
            return
        if self.body is None:
            self.open = [self.root]
            self.body = self._child("body", {})
        self.open = [self.root, self.body]

    def _close(self, tags: tuple[str, ...], barriers: tuple[str, ...]) -> None:
        at = len(self.open)
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag in barriers:
                break
            if self.open[i].tag in tags:
                at = i
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip or tag in self.dropped:
            self.skip += tag in self.dropped and tag not in VOID
            return
        own = {}
        for k, v in attrs:
            own.setdefault(k, v or "")
        if tag == "html":
            for k, v in own.items():
                self.root.attrs.setdefault(k, v)
            return
        if tag in ("head", "body"):
            made = self.head if tag == "head" else self.body
            if made is None and not (tag == "head" and self.body):
                self.open = [self.root]
                made = self._child(tag, own)
                if tag == "head":
                    self.head = made
                else:
                    self.body = made
                self.open = [self.root, made]
            elif made is not None:
                for k, v in own.items():
                    made.attrs.setdefault(k, v)
            return
        self._enter(tag)
        if tag in CLOSES_P:
            self._close(("p",), ("table", "button", "td", "th", "li", "div"))
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "tr" and self.open[-1].tag == "table":
            self.open.append(self._child("tbody", {}))
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            if self.open[-1].tag == "table":
                self.open.append(self._child("tbody", {}))
            self.open.append(self._child("tr", {}))
        node = self._child(tag, own)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.dropped:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip or tag in ("html", "body", "head") or tag in VOID:
            if tag == "head" and self.open[1:2] == [self.head]:
                self.open = [self.root]
            return
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag == "table" and tag != "table":
                return

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if len(self.open) == 1 or self.open[-1] is self.head:
            if not data.strip():
                return
            self._enter("#text")
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def parse(source: str, dropped: frozenset[str] = DROPPED) -> Node:
    """Tree of a page; comments and `dropped` elements are left out. Positions count siblings of equal tag and class."""
    b = _Builder(dropped)
    b.feed(source)
    b.close()
    stack = [b.root]
    while stack:
        n = stack.pop()
        n.cls = format_attr_text(n.attrs.get("class"))
        seen: dict[tuple[str, str | None], int] = {}
        for c in n.children:
            if isinstance(c, Node):
                k = (c.tag, c.attrs.get("class"))
                c.pos = seen.get(k, 0)
                seen[k] = c.pos + 1
                stack.append(c)
    return b.root


def path_of(node: Node) -> list[dict]:
    out = []
    while node is not None:
        out.append({"tag": node.tag, "cls": node.cls, "pos": node.pos})
        node = node.parent
    return out[::-1]


def in_order(root: Node) -> Iterator[Node | str]:
    stack: list[Node | str] = [root]
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, Node):
            stack.extend(reversed(n.children))


STEP = T.StructType([T.StructField("tag", T.StringType()), T.StructField("cls", T.StringType()), T.StructField("pos", T.IntegerType())])
LINK = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("path", T.ArrayType(STEP)),
        T.StructField("raw", T.StringType()),
        T.StructField("rel", T.StringType()),
        T.StructField("full", T.StringType()),
        T.StructField("href", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)
NODE = T.StructType(
    [
        T.StructField("node_id", T.IntegerType()),
        T.StructField("parent_id", T.IntegerType()),
        T.StructField("ord", T.IntegerType()),
        T.StructField("pre", T.IntegerType()),
        T.StructField("post", T.IntegerType()),
        T.StructField("tag", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("cls", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("path", T.ArrayType(STEP)),
        T.StructField("up", T.ArrayType(T.IntegerType())),
    ]
)


def resolve(base: str | None, href: str) -> str | None:
    try:
        return urljoin(base or "", href.strip())
    except ValueError:
        return None


def links_of(source: str | None, url: str | None) -> list[dict]:
    """All anchors of a page in document order. raw: href as parsed; full: resolved; href: resolved once more
    unescaped, without its fragment."""
    if source is None:
        return []
    out = []
    for n in in_order(parse(source)):
        if not isinstance(n, Node) or n.tag != "a":
            continue
        raw = n.attrs.get("href")
        href = resolve(url, html.unescape(raw)) if raw is not None else None
        out.append(
            {
                "ord": len(out),
                "path": path_of(n),
                "raw": raw,
                "rel": n.attrs.get("rel"),
                "full": resolve(url, raw) if raw is not None else None,
                "href": urldefrag(href)[0] if href is not None else None,
                "text": n.text(),
            }
        )
    return out


def nodes_of(source: str | None) -> list[dict]:
    """Elements in document order, each with its own text; pre and post number the element intervals, up the elements
    above, from the root down."""
    if source is None:
        return []
    root = parse(source)
    rows: list[dict] = []

    def visit(node: Node, parent: int | None, at: int) -> None:
        stack = [(node, parent, at, False)]
        ids: dict[int, int] = {}
        while stack:
            n, p, o, done = stack.pop()
            if done:
                rows[ids[id(n)]]["post"] = len(rows) - 1
                continue
            me = ids[id(n)] = len(rows)
            own = "".join(c for c in n.children if isinstance(c, str))
            rows.append(
                {"node_id": me, "parent_id": p, "ord": o, "pre": me, "post": me, "tag": n.tag, "class": n.attrs.get("class"), "cls": n.cls, "pos": n.pos, "attrs": list(n.attrs.items()), "text": own, "path": path_of(n), "up": [] if p is None else [*rows[p]["up"], p]}
            )
            stack.append((n, p, o, True))
            kids = [c for c in n.children if isinstance(c, Node)]
            stack.extend((c, me, i, False) for i, c in reversed(list(enumerate(kids))))

    visit(root, None, 0)
    return rows


def to_xml(source: str | None) -> str | None:
    """The cleaned page as well-formed XML, for the xpath functions."""
    if source is None:
        return None
    out: list[str] = []
    stack: list = [parse(source)]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append(n[0])
        elif isinstance(n, str):
            out.append(html.escape("".join(c for c in n if c >= " " or c in "\t\n\r"), quote=False))
        else:
            name = "".join(c if c.isascii() and (c.isalnum() or c in "-_") else "_" for c in n.tag)
            name = name if name[:1].isalpha() else f"_{name}"
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in n.attrs.items() if k.isascii() and k.replace("-", "").replace("_", "").isalnum() and k[0].isalpha())
            out.append(f"<{name}{attrs}>")
            stack.append((f"</{name}>",))
            stack.extend(reversed(n.children))
    return "".join(out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Bytes of pages that are parsed at once (one page at least); what is made of them takes many times as much.
AT_ONCE = 256 << 10


def parts(batch: pa.RecordBatch, at: list[int]) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch that hold about AT_ONCE bytes of the columns `at` each (one row at least)."""
    n = np.zeros(batch.num_rows, np.int64)
    for i in at:
        n += pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False)
    place = np.cumsum(n) // AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def _mapped(pages: DataFrame, make, out: str, kind: T.DataType, columns: tuple[str, ...]) -> DataFrame:
    """pages with `out` added, from make(*columns) of each row, all texts; works on a few pages at once, in place."""
    pages = pages.drop(out)
    arrow = _arrow(kind)
    at = [pages.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch, at):
                rows = [make(*x) for x in zip(*(b.column(i).to_pylist() for i in at))]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, arrow)], names=[*b.schema.names, out])

    return bounded_batches(pages).mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField(out, kind)]))


def with_links(pages: DataFrame, html_col: str = "html", url_col: str = "url", out: str = "links") -> DataFrame:
    """pages with an array of all their anchors. The page's text is not needed further: select it away before."""
    return _mapped(pages, links_of, out, T.ArrayType(LINK), (html_col, url_col))


def dom_nodes(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row an element: page_url and the columns of NODE. `keep`: page columns to carry, such as a key of its own
    where pages share an address."""
    parsed = _mapped(pages.select(*keep, F.col(url_col).alias("page_url"), F.col(html_col).alias("_html")), nodes_of, "_nodes", T.ArrayType(NODE), ("_html",))
    return parsed.select(*keep, "page_url", F.inline("_nodes"))


def with_xml(pages: DataFrame, html_col: str = "html", out: str = "xml") -> DataFrame:
    return _mapped(pages, to_xml, out, T.StringType(), (html_col,))


def same_host(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and urlsplit(a).hostname == urlsplit(b).hostname
