"""Layout-aware text of HTML pages.

A tree builder reads tags, supplies end tags that HTML lets authors leave out and rows around cells, moves what stands in a table outside its
cells before the table, as browsers do, and keeps raw text elements whole. Visibility rules leave out elements that
browsers do not show: head matter, scripts, styles, templates, form data lists, embedded media, annotations and phantoms in MathML, titles, descriptions, metadata and
definitions in SVG (what ``use`` draws of these is not followed), ``hidden`` and ``display:none`` or ``visibility:hidden`` styles. Everything
else is text. Paragraphs and their like stand between blank lines, divisions and rows on lines of their own, list items after markers and
indented by depth (to INDENT characters), and table cells are padded to columns, also over colspan and rowspan; a cell of more than WIDE characters does not widen its column.
White space outside ``pre`` is collapsed.

A null page gives null text, an empty page or one without visible text an empty text. Rows that share a page_id are pages of their own. Tags that are never closed, closed twice or cut off by the
end of the page do no harm: a ``<`` that starts no tag is text. Recursion is not used, so depth has no limit, and time grows in proportion to a page's length: open elements are found by
name, tables in more than NESTED others are written row by row, and row spans that would be walked over more than SPAN_STEPS times for each cell are left out of the layout (not their text). An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import core

# ---- fixed values of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
DECODED = frozenset("textarea title".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe datalist object audio video canvas param source track".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr".split())
BLOCK = SPACED | frozenset("html body div section article aside nav header footer main address form fieldset legend figcaption details summary li dt dd tr caption thead tbody tfoot center dialog menu option optgroup".split())
#: An open element that ends when one of these begins, unless a border lies between.
ENDS = {
    "p": BLOCK - {"html", "body"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "thead", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "thead", "tfoot"}),
    "thead": frozenset({"tbody", "tfoot"}), "tbody": frozenset({"tbody", "tfoot"}), "tfoot": frozenset({"tbody"}), "caption": frozenset({"tr", "tbody", "thead", "tfoot", "colgroup"}),
    "option": frozenset({"option", "optgroup"}), "optgroup": frozenset({"optgroup"}), "head": frozenset({"body"}), "colgroup": frozenset({"tr", "tbody", "thead", "tfoot"}),
}
BORDER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "caption": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "p": {"td", "th", "table", "button", "caption"}, "head": set(), "colgroup": {"table"}}

#: What is not shown in SVG and MathML.
FOREIGN_HIDDEN = frozenset("annotation annotation-xml mphantom defs metadata title desc symbol clippath mask marker pattern".split())
#: Elements of SVG and MathML that hold HTML again, and HTML elements that end SVG and MathML.
POINTS = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Parts of tables, and the open elements that each may stand in; cells get a row.
PARTS = {"td": ("tr", "thead", "tbody", "tfoot"), "th": ("tr", "thead", "tbody", "tfoot"), "tr": ("thead", "tbody", "tfoot"), "thead": (), "tbody": (), "tfoot": (), "caption": (), "colgroup": (), "col": ("colgroup",)}
LOOSE = frozenset("table thead tbody tfoot tr".split())
#: Start tags that stay where they are in a table.
KEPT = frozenset(PARTS) | frozenset("script style template form".split())

#: Start tags that leave a head open; any other, and text, ends it.
HEAD_MATTER = frozenset("base basefont bgsound link meta title noscript noframes style script template html head".split())

_TAG = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.DOTALL)
#: What is inside a tag after its name, without going back, and its parts.
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_INSIDE = re.compile(r"[^>\"']++|\"[^\"]*+\"|'[^']*+'")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")
INDENT, WIDE, SPAN_STEPS, NESTED = 80, 120, 50, 12
_CLOSED_BY: dict[str, tuple[str, ...]] = {}
for _own, _names in ENDS.items():
    for _name in _names:
        _CLOSED_BY[_name] = (*_CLOSED_BY.get(_name, ()), _own)
#: Elements beyond which no end tag is implied.
_STOPS = ("table", "ul", "ol", "dl", "select")


class Node:
    __slots__ = ("attrs", "children", "foreign", "name")

    def __init__(self, name: str, attrs: dict[str, str], foreign: bool = False):
        self.name, self.attrs, self.children, self.foreign = name, attrs, [], foreign


class _Ends:
    """Where tags end. A tag without an end is text; a place from which no end was found is told at once for later tags, as there are only three ways (none, in either quote) to go over a text."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.lost: list[tuple[list[int], list[int]]] = []

    def rest(self, at: int) -> re.Match | None:
        if at > self.last:
            return None
        for starts, ends in self.lost:
            k = bisect_right(starts, at) - 1
            if k >= 0 and at <= ends[k]:
                return None
        found = _REST.match(self.html, at)
        if found is None:
            free = []
            while m := _INSIDE.match(self.html, at):
                if m[0][0] not in "\"'":
                    free.append(m.span())
                at = m.end()
            self.lost.append(([a for a, _ in free], [b for _, b in free]))
        return found


def tree(html: str) -> Node:
    """The element tree; children are nodes and strings."""
    root = Node("#root", {})
    stack, at = [root], 0
    # for each open element: the places of the nearest table around it, and of that table if no cell or caption lies between,
    # and of the outermost element of the SVG or MathML it is in; 0 is none
    scopes = [(0, 0, 0)]
    places: dict[str, list[int]] = {}  # of open elements, by name

    def push(node: Node) -> None:
        table, loose, foreign = scopes[-1]
        if node.name == "table":
            table = loose = len(stack)
        elif node.name == "template":
            table = loose = 0
        elif node.name in ("td", "th", "caption"):
            loose = 0
        if node.name in ("svg", "math"):
            foreign = foreign or len(stack)
        elif node.name in POINTS:
            foreign = 0
        places.setdefault(node.name, []).append(len(stack))
        stack.append(node)
        scopes.append((table, loose, foreign))

    def cut(k: int) -> None:
        for node in stack[k:]:
            places[node.name].pop()
        del stack[k:], scopes[k:]

    def place(name: str) -> int:
        """Of the innermost open element of that name; 0 if there is none."""
        found = places.get(name)
        return found[-1] if found else 0

    def append(child: Node | str) -> None:
        loose = scopes[-1][1]
        if loose and stack[-1].name in LOOSE:
            # before the table, which is the last child as long as it is open
            stack[loose - 1].children.insert(-1, child)
        else:
            stack[-1].children.append(child)

    def add_text(raw: str) -> None:
        if raw:
            text = unescape(raw)
            if not text.strip():
                stack[-1].children.append(text)
                return
            if stack[-1].name in ("head", "colgroup"):
                cut(len(stack) - 1)
            append(text)

    size, ends = len(html), _Ends(html)
    look = 0
    while at < size:
        m = _TAG.search(html, look)
        if not m:
            add_text(html[at:])
            break
        rest = None
        if m[2] is not None and (rest := ends.rest(m.end())) is None:
            # no tag, and no other one begins within its name
            inner = [k for k in (html.find("<!", m.start() + 1, m.end()), html.find("<?", m.start() + 1, m.end())) if k >= 0]
            look = min(inner, default=m.end())
            continue
        add_text(html[at : m.start()])
        at = look = rest.end() if rest else m.end()
        if m[2] is None:
            if scopes[-1][2] and m[0].startswith("<![CDATA["):
                end = html.find("]]>", m.start())
                at = look = end + 3 if end >= 0 else size
                append(html[m.start() + 9 : end if end >= 0 else size])
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not place("p"):
                append(Node("p", {}))
            elif name == "br":
                append(Node("br", {}))
            else:
                k = place(name)
                if k and (k >= place("table") or name in ("body", "html")):
                    cut(k)
            continue
        if stack[-1].name == "head":
            if name in ("html", "head"):
                continue
            if name not in HEAD_MATTER:
                cut(len(stack) - 1)
        if scopes[-1][2] and name in BREAKOUT:
            cut(scopes[-1][2])
        table, loose, _ = scopes[-1]
        if loose and name == "table":
            cut(loose)
        elif table and name in PARTS:
            k = len(stack) - 1
            while k > table and stack[k].name not in PARTS[name]:
                k -= 1
            cut(k + 1)
            if name in ("td", "th") and stack[-1].name != "tr":
                row = Node("tr", {})
                stack[-1].children.append(row)
                push(row)
        elif stack[-1].name == "colgroup" and name != "template":
            cut(len(stack) - 1)
        # implied end tags: from the innermost open element outwards, up to a list, a table or a border
        if name in _CLOSED_BY:
            stop = max(map(place, _STOPS))
            while True:
                k = max((k for own in _CLOSED_BY[name] if (k := place(own)) > stop and all(place(x) <= k for x in BORDER.get(own, ()))), default=0)
                if not k:
                    break
                cut(k)
        inside = rest[1]
        attrs = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(inside)}
        foreign = scopes[-1][2] > 0
        node = Node(name, attrs, foreign)
        kept = name in KEPT or (name == "input" and attrs.get("type", "").lower() == "hidden")
        if kept:
            stack[-1].children.append(node)
        else:
            append(node)
        if name == "form" and scopes[-1][1] and stack[-1].name in LOOSE:
            continue  # a form in a table is empty
        if foreign and inside.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}[\s/>]", re.IGNORECASE).search(html, at) if name != "plaintext" else None
            raw = html[at : end.start()] if end else html[at:]
            if raw:
                node.children.append(unescape(raw) if name in DECODED else raw)
            close_at = html.find(">", end.end() - 1) if end else -1
            at = look = close_at + 1 if close_at >= 0 else size
        elif name not in VOID and not inside.endswith("/"):
            push(node)
        elif name not in VOID and (name in BLOCK or name in PARTS):
            push(node)  # a slash closes nothing in HTML
    return root


def visible(node: Node) -> bool:
    if node.foreign and (node.name in FOREIGN_HIDDEN or node.attrs.get("display") == "none" or node.attrs.get("visibility") == "hidden"):
        return False
    return not (node.name in HIDDEN or "hidden" in node.attrs or (node.name == "input" and node.attrs.get("type", "").lower() == "hidden") or ("style" in node.attrs and _UNSEEN.search(node.attrs["style"])))


class _Out:
    """Lines with pending breaks: text is added to the last line, and a break of n lines is made before the next text."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def _start(self) -> None:
        if self.breaks or not self.parts:
            if self.parts:
                self.parts.append("\n" * self.breaks)
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space = 0, False

    def text(self, s: str) -> None:
        words = _SPACE.sub(" ", s)
        if not words or words == " ":
            self.space |= bool(words)
            return
        self.space |= words[0] == " "
        self._start()
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def lines(self, s: str) -> None:
        """Preformatted text."""
        for k, line in enumerate(s.split("\n")):
            if k:
                self.breaks += 1
            if line:
                self._start()
                self.parts.append(line)

    def need(self, n: int) -> None:
        self.breaks, self.space = max(self.breaks, n), False

    def value(self) -> str:
        return "".join(self.parts).strip("\n")


def _cells(table: Node) -> list[list[Node]]:
    """Rows of the table's own cells."""
    rows, todo = [], [table]
    while todo:
        node = todo.pop()
        for child in reversed([c for c in node.children if isinstance(c, Node) and visible(c)]):
            if child.name in ("thead", "tbody", "tfoot", "tr"):
                todo.append(child)
        if node.name == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.name in ("td", "th") and visible(c)])
    return [r for r in rows if r]


def _span(node: Node, name: str, most: int) -> int:
    value = node.attrs.get(name, "1").strip()
    return min(max(int(value), 1), most) if re.fullmatch(r"[0-9]{1,9}", value) else 1


def _laid_out(rows: list[list[Node]]) -> list[list[tuple[int, int]]]:
    """First column, and the column after the last, of each cell: cells stand beside those of rows above that reach down."""
    budget = SPAN_STEPS * sum(map(len, rows))
    out, reaching = [], []  # cells that reach down: first column, end, rows left; in order of columns
    for row in rows:
        placed, at, k = [], 0, 0
        for cell in row:
            width = _span(cell, "colspan", 1000)
            while k < len(reaching) and reaching[k][0] < at + width:
                at = max(at, reaching[k][1])
                k += 1
                budget -= 1
            placed.append((at, at + width, _span(cell, "rowspan", 65534)))
            at += width
        out.append([p[:2] for p in placed])
        budget -= len(reaching)
        if budget < 0:
            reaching = []
            continue
        reaching = sorted([(a, b, n - 1) for a, b, n in (*reaching, *placed) if n > 1])
    return out


def _grid(rows: list[list[str]], places: list[list[tuple[int, int]]] | None = None) -> list[str]:
    """Cells padded to the widths of their columns; a cell of several lines takes several lines, one over several columns their room."""
    places = places or [[(k, k + 1) for k in range(len(row))] for row in rows]
    columns = {a: k for k, a in enumerate(sorted({a for row in places for a, _ in row}))}
    edges = sorted(columns)
    width = [0] * len(columns)
    split = [[cell.split("\n") for cell in row] for row in rows]
    for row, where in zip(split, places, strict=True):
        for cell, (a, b) in zip(row, where, strict=True):
            if bisect_left(edges, b) - columns[a] == 1:
                width[columns[a]] = max(width[columns[a]], *(n for line in cell if (n := len(line)) <= WIDE), 0)
    if len(columns) <= WIDE:  # a cell over several columns widens the last of them
        for row, where in zip(split, places, strict=True):
            for cell, (a, b) in zip(row, where, strict=True):
                first, last = columns[a], bisect_left(edges, b) - 1
                if last > first:
                    need = max((n for line in cell if (n := len(line)) <= WIDE), default=0) - sum(width[first : last + 1]) - 3 * (last - first)
                    width[last] += max(need, 0)
    begin = [0, *accumulate(w + 3 for w in width)]
    out = []
    for row, where in zip(split, places, strict=True):
        for line in range(max(map(len, row))):
            text, parts = 0, []
            for k, (cell, (a, _)) in enumerate(zip(row, where, strict=True)):
                if k or columns[a]:
                    # up to the mark before this column; longer text pushes on
                    gap = " " * max(begin[columns[a]] - 3 - text, 0) + " | "
                    parts.append(gap)
                    text += len(gap)
                own = cell[line] if line < len(cell) else ""
                parts.append(own)
                text += len(own)
            out.append("".join(parts).rstrip())
    return out


def text_of(root: Node) -> str:
    """Visible text of a tree. Work items are done from a stack, tables after their cells."""
    out = _Out()
    todo: list[tuple] = [("node", root, False)]
    outs = [out]
    lists: list[list] = []
    while todo:
        item = todo.pop()
        out = outs[-1]
        if item[0] == "text":
            (out.lines if item[2] else out.text)(item[1])
        elif item[0] == "need":
            out.need(item[1])
        elif item[0] == "indent":
            out.indent = item[1]
            out.marker = ""
        elif item[0] == "unlist":
            lists.pop()
        elif item[0] == "cell":
            item[1].append(outs.pop().value())
        elif item[0] == "open":
            outs.append(_Out())
        elif item[0] == "grid":
            out.need(2)
            for line in _grid(item[1], item[2]):
                out.need(1)
                out._start()
                out.parts.append(line)
            out.need(2)
        else:
            node, pre = item[1], item[2]
            if isinstance(node, str):
                todo.append(("text", node, pre))
                continue
            if not visible(node):
                continue
            name = node.name
            if name == "br":
                out.breaks += 1
                out.space = False
                continue
            if name == "hr":
                out.need(2)
                continue
            if name == "img":
                out.text(node.attrs.get("alt", ""))
                continue
            if name == "input":
                out.text(node.attrs.get("value", "") if node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search") else "")
                continue
            if name == "table" and len(outs) <= NESTED and (rows := _cells(node)):
                grid: list[list[str]] = [[] for _ in rows]
                todo.append(("grid", grid, _laid_out(rows)))
                for row, cells in zip(reversed(rows), reversed(grid), strict=True):
                    for cell in reversed(row):
                        todo += [("cell", cells), ("inner", cell, pre), ("open",)]
                # captions come before the rows
                own = [c for c in node.children if (isinstance(c, str) and c.strip()) or (isinstance(c, Node) and c.name not in ("thead", "tbody", "tfoot", "tr"))]
                todo += [("node", c, pre) for c in reversed(own)]
                out.need(2)
                continue
            gap = 0 if item[0] == "inner" else 2 if name in SPACED and not (name in ("ul", "ol") and lists) else 1 if name in BLOCK or (node.foreign and name in ("text", "mtr")) else 0
            if name in ("td", "th") or (node.foreign and name == "mtd"):
                out.space = True
            if gap:
                out.need(gap)
                todo.append(("need", gap))
            if name in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
                todo.append(("unlist",))
            elif name in ("li", "dd", "blockquote"):
                todo.append(("indent", out.indent))
                mark = ""
                if name == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                out.indent = (out.indent + " " * (len(mark) or 2))[: INDENT + len(mark)]
                out.marker = mark
            elif name == "q":
                todo.append(("text", '"', True))
                out.text('"')
            todo += [("node", c, pre or name in ("pre", "textarea")) for c in reversed(node.children)]
    return outs[0].value()


def render(html: str | None) -> str | None:
    return None if html is None else text_of(tree(html))


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, text, n_chars, n_lines."""
    core.bounded_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [render(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64()), pa.array([None if t is None else t.count("\n") + bool(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")
