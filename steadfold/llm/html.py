"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text renderer.

The standard library's tokenizer feeds a tree builder that closes and opens what HTML leaves out
(paragraphs before blocks, list items, table rows and cells).  Elements that a browser does not show
are left out.  The rest is laid out as text: blocks on lines of their own with blank lines around
paragraphs and headings, list markers with indents, preformatted text as it is, and table cells in
aligned columns.  All visible text comes out; nothing is judged to be boilerplate.

Of a ``select`` every option comes out on a line of its own, under the label of its group, for a reader
can open the list; a ``textarea`` gives the text it starts with, as it is; ``math`` and ``svg`` give the text
of their elements (also of ``defs``, which a ``use`` may show), but not annotations, titles, descriptions,
metadata, styles and scripts.  ``noscript`` is hidden:
pages are taken as a browser with scripts shows them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe object audio video canvas".split())
# Elements of svg and math have names with the vocabulary before them, as they mean other things there.
HIDDEN |= frozenset("svg:title svg:desc svg:metadata svg:style svg:script math:annotation math:annotation-xml".split())
FOREIGN = ("svg", "math")
HTML_IN = frozenset("svg:foreignobject svg:desc svg:title math:mi math:mo math:mn math:ms math:mtext math:annotation-xml".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre "
                   "ruby s small span strong strike sub sup table tt u ul var".split())  # these end svg and math
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul svg:text svg:foreignobject math:mtr".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr".split())
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "legend", "optgroup", "option"}
# An opening tag closes these open elements, looking no further up than the listed borders.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
}
SPACE = re.compile(r"[ \t\n\r\f]+")
CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
RAW = "textarea" not in getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ())  # later tokenizers know it
DEEPEST = 400  # deeper elements are siblings in the deepest one, as in browsers; their text stays


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Elements and strings under ``root``; never fails on broken markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def _close(self, tags: set, borders: set) -> None:
        """Close the outermost open element of ``tags`` that is not above a border."""
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in borders:
                break
            if self.open[i].tag in tags:
                found = i
        if found is not None:
            del self.open[found:]

    def _foreign(self) -> str | None:
        """svg or math, if the place in work is in one of them."""
        here = self.open[-1].tag
        return here.split(":")[0] if here not in HTML_IN and here.split(":")[0] in FOREIGN else None

    def handle_starttag(self, tag: str, attrs: list, ended: bool = False) -> None:
        if self._foreign():
            if tag not in LEAVES:
                self._push(Node(f"{self._foreign()}:{tag}", {k: v or "" for k, v in attrs}), not ended)
                return
            while self._foreign():
                self.open.pop()
        if tag in ("html", "body"):
            self.root.attrs.update({k: v or "" for k, v in attrs})
            self._close({"head"}, set())
            return
        if tag in ENDS_P:
            self._close({"p"}, {"td", "th", "table", "button", "caption"})
        if tag in BLOCKS and self.open[-1].tag == "head":
            self.open.pop()
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr", {}))
        self._push(Node(tag, {k: v or "" for k, v in attrs}), tag not in VOID and not (ended and tag in FOREIGN))
        if tag == "textarea" and RAW:
            self.set_cdata_mode(tag)  # tags in it are text

    def _push(self, node: Node, stays: bool = True) -> None:
        self.open[-1].children.append(node)
        if stays and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, True)  # the slash means nothing in HTML, but ends elements of svg and math

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            here = self.open[i].tag
            if here in (tag, f"svg:{tag}", f"math:{tag}"):
                del self.open[i:]
                return
            if here in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                return  # an end tag does not reach out of a cell
        if tag == "p":
            self._push(Node("p", {}), False)
        elif tag == "br":
            self._push(Node("br", {}), False)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(unescape(data) if RAW and self.open[-1].tag == "textarea" else data)

    def close(self) -> None:
        if RAW and self.cdata_elem == "textarea":  # it never ends
            rest, self.rawdata = self.rawdata, ""
            self.clear_cdata_mode()
            self.handle_data(rest)
        super().close()


def concealed(node: Node) -> bool:
    a = node.attrs
    return (node.tag in HIDDEN or "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
            or (node.tag == "dialog" and "open" not in a) or bool(CONCEALED.search(a.get("style", ""))))


class Page:
    """Lines of text as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False  # is a blank line due before the next text?
        self.prefix = ""  # marker of a list item, for its first line

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *others = data.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in others:
                self.end(True)
                self.now.append(line)
            return
        data = SPACE.sub(" ", data)
        if data.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            data = data[1:]
        if data:
            self.now.append(data)

    def end(self, kept: bool = False, forced: bool = False) -> None:
        """End the line in work, if there is anything on it."""
        line = "".join(self.now)
        line = line.rstrip("\n") if kept else line.strip(" ")
        self.now = []
        if line or forced or kept:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.prefix + line)
            self.prefix = " " * len(self.prefix)

    def whole(self) -> list[str]:
        self.end()
        return self.lines


def wide(text: str) -> int:
    """Columns that a text takes in a fixed-width font."""
    return len(text) if text.isascii() else sum(
        0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def rows_of(table: Node) -> tuple[list[Node], list[list[Node]], list[Node]]:
    """Captions, rows of cells, and anything else that stands in a table by mistake."""
    captions, rows, loose = [], [], []
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                loose.append(child)
        elif concealed(child):
            continue
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr":
            cells = [c for c in child.children if not isinstance(c, str) and c.tag in ("td", "th") and not concealed(c)]
            rows.append(cells)
            loose += [c for c in child.children if (isinstance(c, str) and c.strip()) or (not isinstance(c, str) and c.tag not in ("td", "th"))]
        elif child.tag in ("tbody", "thead", "tfoot"):
            inner = rows_of(child)
            captions, rows, loose = captions + inner[0], rows + inner[1], loose + inner[2]
        else:
            loose.append(child)
    return captions, rows, loose


def span(cell: Node) -> int:
    digits = re.match(r"\s*(\d{1,3})", cell.attrs.get("colspan", ""))
    return min(max(int(digits.group(1)), 1), 100) if digits else 1


def laid_out(children: list) -> list[str]:
    page = Page()
    for child in children:
        render(child, page, False)
    lines = page.whole()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def table_lines(rows: list[list[Node]]) -> Iterator[str]:
    """Cells side by side; every column is as wide as its widest cell that spans no other."""
    grid = [[(laid_out(c.children), span(c)) for c in row] for row in rows if row]
    width: dict[int, int] = {}
    for row in grid:
        at = 0
        for lines, columns in row:
            if columns == 1:
                width[at] = max([width.get(at, 0), *map(wide, lines)])
            at += columns
    for row in grid:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, columns in row:
                room = sum(width.get(at + j, 0) for j in range(columns)) + 2 * (columns - 1)
                cell = lines[i] if i < len(lines) else ""
                parts.append(cell + " " * max(0, room - wide(cell)))
                at += columns
            yield "  ".join(parts).rstrip()


def emit(page: Page, lines: list[str]) -> None:
    for line in lines:
        page.now = [line] if line else []
        page.end(kept=True)


def render(node: Node | str, page: Page, kept: bool, number: int | None = None) -> None:
    if isinstance(node, str):
        page.text(node, kept)
        return
    if concealed(node):
        return
    tag = node.tag
    if tag == "br":
        page.end(forced=True)
        return
    if tag == "img":
        if node.attrs.get("alt"):
            page.text(node.attrs["alt"], False)
        return
    if tag == "input":
        if node.attrs.get("type", "text").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
            page.text(node.attrs["value"], False)
        return
    if tag == "textarea":
        page.end()
        emit(page, "".join(c for c in node.children if isinstance(c, str)).replace("\r\n", "\n").removeprefix("\n").rstrip("\n").split("\n"))
        return
    if tag in BLOCKS:
        page.end()
    if tag in SPACED:
        page.gap = True
    if tag in ("option", "optgroup") and node.attrs.get("label"):
        page.text(node.attrs["label"], False)
        page.end()
        if tag == "option":
            return
    if tag == "table":
        captions, rows, loose = rows_of(node)
        for child in [*loose, *captions]:
            render(child, page, kept)
            page.end()
        emit(page, list(table_lines(rows)))
    elif tag == "li":
        lines = laid_out(node.children)
        mark = "- " if number is None else f"{number}. "
        if lines:
            emit(page, [mark + lines[0], *[(" " * len(mark) + x) if x else "" for x in lines[1:]]])
    elif tag == "blockquote" or tag == "dd":
        emit(page, ["  " + x if x else "" for x in laid_out(node.children)])
    else:
        if tag == "ol":
            begin = re.match(r"\s*(-?\d{1,9})", node.attrs.get("start", ""))
            count = int(begin.group(1)) if begin else 1
        for child in node.children:
            item = not isinstance(child, str) and child.tag == "li" and not concealed(child)
            if item and tag == "ol":
                render(child, page, kept, count)
                count += 1
            elif isinstance(child, str) and tag in ("ul", "ol", "dl", "menu", "dir") and not child.strip():
                continue
            else:
                render(child, page, kept or tag in ("pre", "listing"))
    if tag == "math:mtd":
        page.text(" ", False)
    if tag in BLOCKS:
        page.end(kept=tag in ("pre", "listing") and bool("".join(page.now)))
    if tag in SPACED:
        page.gap = True


def extract(html: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if html is None:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    if concealed(tree.root):
        return ""
    return "\n".join(laid_out(tree.root.children)).strip("\n")


def extract_pages(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_col`` as ``text_col`` (a column of that name is replaced).

    Null pages have a null text; empty and unreadable ones an empty text; rows are independent, so
    repeated rows have equal texts; an empty table gives an empty result; other columns are passed on.
    """
    keep = [c for c in pages.columns if c.lower() != text_col.lower()]
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    out = rows.select(*keep, F.lit(None).cast("string").alias(text_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([extract(h.as_py()) for h in batch.column(batch.num_columns - 1)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*keep, text_col])

    return rows.mapInArrow(run, out)
