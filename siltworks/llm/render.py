"""Visible text of web pages, laid out as a reader sees it.

A tolerant tree builder supplies the tags that HTML implies (a paragraph ends where a block starts, list items, table rows and cells and options
end where the next starts) and ignores end tags without a start. Rendering leaves out what is not shown (scripts, styles, the head, hidden
elements), collapses white space outside preformatted text, sets blocks apart, marks and indents list items and aligns
the cells of tables. Of drawings and formulas it gives the text in reading order, without its places; what <use> repeats is given
only where it stands itself.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import ship_package

# Fixed values of the HTML standard: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER_SHOWN = frozenset("script style head title template noscript noembed noframes iframe object datalist meta link audio video canvas".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split()
)
#: Blocks with an empty line before and after them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
LISTS = frozenset("ul ol menu dir".split())
PARAGRAPH_ENDS = BLOCKS - {"body", "html", "li", "dd", "dt", "legend", "summary", "figcaption"} | {"hr", "xmp"}
#: Start tag: open elements that it ends, and those beyond which it does not look.
IMPLIED_ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "colgroup": ({"caption"}, {"table"}),
    "col": ({"caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPES = frozenset("table td th button object html".split())
SECTIONS = frozenset("tbody thead tfoot".split())
ROW_PARENTS = SECTIONS | {"table"}
#: Start tags that end an open drawing or formula, and elements inside one whose content is HTML again.
BREAKOUTS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small "
    "span strong strike sub sup table tt u ul var".split()
)
HTML_AGAIN = frozenset("foreignobject desc mi mo mn ms mtext".split())
#: What drawings and formulas do not show, and the parts of formulas that stand above, below or beside each other.
NOT_DRAWN = frozenset(
    "defs symbol desc metadata clippath mask marker pattern filter lineargradient radialgradient annotation annotation-xml mphantom".split()
)
MATH_SPLIT = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtable mtr mlabeledtr".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</([A-Za-z][^\s/>]*)[^>]*>"
    r"|<([A-Za-z][^\s/>]*)(?=[\s/>])",
    re.DOTALL,
)
#: White space and slashes before an attribute; its name, with what leads to a value; a value without quotes.
_GAP = re.compile(r"[\s/]*+")
_NAME = re.compile(r"([^\s/>][^\s/>=]*+)(\s*+=\s*+)?+")
_BARE = re.compile(r"[^\s>]*+")
#: Levels of list items and definitions that are indented; deeper ones keep their marks and all text.
MOST_INDENT = 40
_HIDING_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: bool = False):
        self.tag, self.attributes, self.foreign = tag, attributes, foreign
        self.children: list[Node | str] = []

    def holds_foreign(self) -> bool:
        """Children belong to the drawing or formula, not to HTML."""
        if not self.foreign or self.tag in HTML_AGAIN:
            return False
        return self.tag != "annotation-xml" or self.attributes.get("encoding", "").lower() not in ("text/html", "application/xhtml+xml")

    def shown(self) -> bool:
        if self.tag in NEVER_SHOWN or "hidden" in self.attributes:
            return False
        if self.tag == "input" and self.attributes.get("type", "").lower() == "hidden":
            return False
        if self.foreign and (self.tag in NOT_DRAWN or self.attributes.get("display") == "none" or self.attributes.get("visibility") in ("hidden", "collapse")):
            return False
        return not _HIDING_STYLE.search(self.attributes.get("style", ""))


def _tag_end(html: str, at: int, doomed: set[int]) -> tuple[int, dict[str, str], bool]:
    """Where a start tag ends whose name ends at at, its attributes, and whether a slash closes it. Only quotes around values hide a '>', over any
    length. A tag whose quotes do not end ends at its first '>'; doomed keeps the places from which no end was found, so that none is read twice."""
    out: dict[str, str] = {}
    ends: dict[str, int] = {}
    seen: list[int] = []
    start, n, closed = at, len(html), False
    while at < n and at not in doomed:
        seen.append(at)
        gap = _GAP.match(html, at).end()
        closed = gap > at and html[gap - 1] == "/"
        at = gap
        if at >= n:
            break
        if html[at] == ">":
            return at + 1, out, closed
        name = _NAME.match(html, at)
        at, value = name.end(), ""
        if name[2] and at < n:
            quote = html[at]
            if quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    break
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        key = name[1].lower()
        if key not in out:
            out[key], ends[key] = unescape(value) if value else "", at
    doomed.update(seen)
    end = html.find(">", start)
    return (end + 1 if end >= 0 else n), {k: v for k, v in out.items() if ends[k] <= end}, end > start and html[end - 1] == "/"


class _Open:
    """The open elements, and where those of each tag are, so that no tag needs a look through all of them."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.places: dict[str, list[int]] = {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close the element at place and all in it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().tag].pop()

    def pop(self) -> None:
        self.cut(len(self.nodes) - 1)

    def last(self, *tags: str) -> int:
        """Place of the innermost of these, 0 if none is open."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=0)

    def first_after(self, floor: int, tags: set[str]) -> int:
        """Place of the outermost of these inside the element at floor, 0 if there is none."""
        found = [at[k] for t in tags if (at := self.places.get(t)) and (k := bisect_right(at, floor)) < len(at)]
        return min(found, default=0)


def _text(stack: _Open, text: str) -> None:
    if stack.top().tag == "colgroup" and _SPACE.sub("", text):
        stack.pop()
    stack.top().children.append(text)


def parse(html: str) -> Node:
    """The tree of a page; every page gives one, whatever is wrong with it."""
    root = Node("html", {})
    stack = _Open(root)
    at, n, last = 0, len(html), html.rfind(">")
    doomed: set[int] = set()
    while at < n:
        token = _TOKEN.search(html, at) if at <= last else None
        if token is not None and token[2] and token.start() > last:
            token = None
        if token is None:
            _text(stack, unescape(html[at:]))
            break
        if token.start() > at:
            _text(stack, unescape(html[at : token.start()]))
        at = token.end()
        if stack.top().foreign and html.startswith("<![CDATA[", token.start()) and stack.top().holds_foreign():
            end = html.find("]]>", token.start())
            _text(stack, html[token.start() + 9 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
            continue
        if token[2]:
            tag = token[2].lower()
            at, attributes, closed = _tag_end(html, at, doomed)
            if tag == "html" or (tag == "body" and stack.last("body")):
                root.attributes |= attributes if tag == "html" else {}
                continue
            if stack.top().foreign and tag in BREAKOUTS:
                while stack.top().holds_foreign():
                    stack.pop()
            _imply(stack, tag)
            foreign = tag in ("svg", "math") or stack.top().holds_foreign()
            node = Node(tag, attributes, foreign)
            stack.top().children.append(node)
            if foreign and closed:
                continue
            if tag == "form" and stack.top().tag in (*ROW_PARENTS, "tr"):
                continue  # as in browsers, such a form holds nothing and what follows stays in the table
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*/?>", re.IGNORECASE).search(html, at)
                end = close.start() if close else n
                body = html[at:end]
                node.children.append(unescape(body) if tag in ("textarea", "title") else body)
                at = close.end() if close else n
            elif tag not in VOID:
                stack.push(node)
        elif token[1]:
            _end(stack, token[1].lower())
    return root


def _imply(stack: _Open, tag: str) -> None:
    if tag in PARAGRAPH_ENDS:
        place = stack.last("p")
        if place > stack.last(*SCOPES):
            stack.cut(place)
    if tag in IMPLIED_ENDS:
        ends, bounds = IMPLIED_ENDS[tag]
        place = stack.first_after(stack.last(*bounds), ends)
        if place:
            stack.cut(place)
    if stack.top().tag == "colgroup" and tag not in ("col", "template"):
        stack.pop()
    if tag in ("td", "th") and stack.top().tag in ROW_PARENTS:
        row = Node("tr", {})
        stack.top().children.append(row)
        stack.push(row)
    if stack.top().tag == "head" and tag not in NEVER_SHOWN and tag not in ("base", "basefont", "bgsound"):
        stack.pop()


def _end(stack: _Open, tag: str) -> None:
    place = stack.last(tag)
    if place:
        if tag in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or place >= stack.last("table", "td", "th"):
            stack.cut(place)
    elif tag in ("br", "p"):
        stack.top().children.append(Node(tag, {}))


class _Lines:
    """Lines of text with pending white space and blank lines."""

    def __init__(self, level: int = 0) -> None:
        #: How many list items and definitions hold these lines.
        self.level = level
        self.lines: list[str] = []
        self.line = ""
        self.space = False
        self.blank = False

    def inline(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        if not text:
            return
        if self.space and self.line and not self.line.endswith("\t"):
            self.line += " "
        self.space = text.endswith(" ")
        self.line += text[:-1] if self.space else text

    def breaks(self) -> None:
        """End the line even if it is empty, as <br> does."""
        self._blank_first()
        self.lines.append(self.line)
        self.line, self.space = "", False

    def block(self, spaced: bool) -> None:
        """End the line if it holds text; spaced asks for an empty line before what follows."""
        if self.line:
            self.breaks()
        self.space = False
        self.blank = self.blank or spaced

    def _blank_first(self) -> None:
        if self.blank and self.lines and self.lines[-1] != "":
            self.lines.append("")
        self.blank = False

    def verbatim(self, lines: list[str]) -> None:
        self.block(False)
        self._blank_first()
        self.lines += lines

    def done(self) -> list[str]:
        self.block(False)
        lines = [x.rstrip() for x in self.lines]
        while lines and not lines[-1]:
            lines.pop()
        while lines and not lines[0]:
            lines.pop(0)
        return lines


def _display_width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


def _opened(nodes: list, opens) -> Iterator[Node | str]:
    """Nodes in order, with the children of those that opens in their place; what is not shown is left out."""
    todo = [iter(nodes)]
    while todo:
        for node in todo[-1]:
            if isinstance(node, str) or (node.shown() and not opens(node)):
                yield node
            elif node.shown():
                todo.append(iter(node.children))
                break
        else:
            todo.pop()


def _cells(table: Node) -> Iterator[Node]:
    """Rows of a table in order, whichever section holds them."""
    return (x for x in _opened(table.children, lambda n: n.tag in SECTIONS) if isinstance(x, Node) and x.tag == "tr")


def _strays(table: Node) -> Iterator[Node | str]:
    """What lies in a table or its sections without being a row."""
    return (x for x in _opened(table.children, lambda n: n.tag in SECTIONS) if isinstance(x, str) or x.tag not in ("tr", "colgroup", "col"))


def _drawn(node: Node) -> Iterator[Node]:
    """The elements of a drawing that show text; text elsewhere in it is not painted."""
    return (x for x in _opened(node.children, lambda n: n.tag not in ("text", "foreignobject")) if isinstance(x, Node))


def _span(cell: Node) -> int:
    raw = cell.attributes.get("colspan", "1")
    return min(max(int(raw), 1), 1000) if raw.isascii() and raw.isdigit() else 1


def _table(table: Node, depth: int, level: int) -> Iterator:
    """Cells side by side in columns of equal width, lines of a cell under each other; captions and stray content come first."""
    before = _Lines()
    for child in _strays(table):
        yield _walk([child], before, depth, False)
    out = before.done()
    rows: list[list[tuple[list[str], int]]] = []
    for row in _cells(table):
        rows.append([])
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and cell.shown():
                rows[-1].append(((yield _lines_of(cell.children, depth, level)), _span(cell)))
        loose = _Lines()
        yield _walk([c for c in row.children if isinstance(c, str) or c.tag not in ("td", "th")], loose, depth, False)
        out += loose.done()
    if all(len(row) <= 1 for row in rows):  # one column needs no aligning
        return out + [line for row in rows for lines, _ in row for line in lines]
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(_display_width, lines), default=0))
            at += span
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            line, at, end = "", 0, 0
            for lines, span in row:
                part = lines[k] if k < len(lines) else ""
                if part:
                    line += " " * max(end - _display_width(line), 2 if line else 0) + part
                end += sum(widths.get(c, 0) + 2 for c in range(at, at + span))
                at += span
            out.append(line)
    return out


def _lines_of(nodes: list, depth: int, level: int) -> Iterator:
    lines = _Lines(level)
    yield _walk(nodes, lines, depth, False)
    return lines.done()


def render_lines(nodes: list) -> list[str]:
    """Lines of some nodes. Walkers hand over the walk of what lies deeper instead of calling it, so no depth is too much."""
    todo, got = [_lines_of(nodes, 0, 0)], None
    while todo:
        try:
            todo.append(todo[-1].send(got))
            got = None
        except StopIteration as end:
            todo.pop()
            got = end.value
    return got


def _hung(mark: str, lines: list[str], level: int) -> list[str]:
    """lines behind a mark, the later ones indented as far; beyond MOST_INDENT levels they stand at the left."""
    pad = " " * len(mark) if level < MOST_INDENT else ""
    return [mark + lines[0], *(pad + x if pad and x else x for x in lines[1:])] if lines else []


def _walk(nodes: list, out: _Lines, depth: int, pre: bool) -> Iterator:
    for node in nodes:
        if isinstance(node, str):
            if pre:
                first, *more = node.replace("\r\n", "\n").split("\n")
                out.line += first
                for line in more:
                    out.breaks()
                    out.line = line
            else:
                out.inline(node)
            continue
        if not node.shown():
            continue
        tag = node.tag
        if tag == "br":
            out.breaks()
        elif tag == "hr":
            out.block(True)
        elif tag == "img":
            out.inline(node.attributes.get("alt", ""))
        elif tag == "input":
            out.inline(node.attributes.get("value", "") if node.attributes.get("type", "").lower() in ("submit", "button", "reset") else "")
        elif tag in LISTS:
            out.block(depth == 0 or tag not in LISTS)
            yield _list(node, out, depth)
            out.block(depth == 0)
        elif tag == "table":
            out.block(True)
            out.verbatim((yield _table(node, depth + 1, out.level)))
            out.block(True)
        elif tag == "pre":
            out.block(True)
            yield _walk(node.children, out, depth + 1, True)
            out.block(True)
        elif tag == "dd":
            out.block(False)
            out.verbatim(_hung("    ", (yield _lines_of(node.children, depth + 1, out.level + 1)), out.level))
        elif tag in BLOCKS:
            out.block(tag in SPACED)
            yield _walk(node.children, out, depth + 1, pre)
            out.block(tag in SPACED)
        elif tag == "svg" and node.foreign:
            for part in _drawn(node):
                out.inline(" ")
                yield _walk(part.children, out, depth + 1, False)
                out.inline(" ")
        elif tag in MATH_SPLIT and node.foreign:
            for part in node.children:
                out.inline(" ")
                yield _walk([part], out, depth + 1, False)
                out.inline(" ")
        elif tag in ("td", "th", "option", "button", "mtd") or (tag == "tspan" and not {"x", "y", "dy"}.isdisjoint(node.attributes)):
            out.inline(" ")
            yield _walk(node.children, out, depth + 1, pre)
            out.inline(" ")
        else:
            yield _walk(node.children, out, depth + 1, pre)


def _list(node: Node, out: _Lines, depth: int) -> Iterator:
    raw = node.attributes.get("start", "1")
    number = int(raw) if re.fullmatch(r"-?\d{1,9}", raw) else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and child.shown():
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = yield _lines_of(child.children, depth + 1, out.level + 1)
            if lines:
                out.verbatim(_hung(mark, lines, out.level))
        else:
            yield _walk([child], out, depth + 1, False)


def visible_text(html: str | None) -> str:
    """The page as plain text. Null and empty pages give the empty text."""
    return "\n".join(render_lines([parse(html)])) if html else ""


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines) per row of pages, where it is scanned. Repeated rows are rendered each by itself; other columns
    are ignored, whatever their names; no page is cut, however long or deep. Null and empty pages give the empty text, an empty table no rows."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(h) for h in batch.column("html").to_pylist()]
            arrays = [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars", "n_lines"])

    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(make, "page_id long, url string, text string, n_chars long, n_lines long")
