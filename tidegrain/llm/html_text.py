"""Visible text of HTML pages, laid out.

A small tree builder closes tags that HTML implies closed, then a renderer
walks the tree: hidden parts are skipped, blocks stand on lines of their own,
paragraph-like blocks are parted by an empty line, list items get bullets or
numbers and indentation, preformatted text keeps its space, and table cells
are padded so that columns line up.  Form controls show their values, closed
selects the chosen option, drawings their text elements, and objects, which
are never loaded, their fallback.  Style sheets decide what is hidden (see css),
not how the rest is laid out.  Neither recurses.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrain.llm import css
from tidegrain.llm.common import need, small_batches

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style template noscript head title meta link base iframe canvas audio video datalist annotation annotation-xml mphantom".split())
#: Inputs that show no text, and those that show their value but never a placeholder.
TEXTLESS_INPUTS = frozenset("hidden password checkbox radio file color range image".split())
PLAIN_INPUTS = frozenset("submit reset button date month week time datetime-local".split())
#: What may stand in the head.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Parts of a drawing that are not drawn where they stand.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Where HTML stands again inside a drawing or a formula, and tags that end both elsewhere.
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
FOREIGN = frozenset({"svg", "math"})
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd".split())
SCOPE = frozenset("table td th caption button html template".split())
#: Rows of a cell with a rowspan of 0, which goes to the end of its table part.
ALL_ROWS = 1 << 20
#: Elements nested deeper become siblings, as browsers have it.
DEEPEST = 512
#: Deeper lists are indented no further.
DEEPEST_INDENT = 40

_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; own is what its style attribute says, said what counts once style sheets are read (see css)."""

    __slots__ = ("attrs", "children", "own", "said", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.own = self.said = css.inline(attrs["style"]) if "style" in attrs else {}


class TreeBuilder(HTMLParser):
    """Nodes and strings below ``root``."""

    CDATA_CONTENT_ELEMENTS = (*HTMLParser.CDATA_CONTENT_ELEMENTS, "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.in_head = self.any_foreign = False

    def _close(self, tags: frozenset, limits: frozenset) -> None:
        """Close the nearest open element of tags, unless one of limits is nearer."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in limits:
                return

    def _push(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        self._last = node
        # What is hidden is opened at any depth, so that its text does not fall to a shown parent.
        if tag not in VOID and (len(self.open) < DEEPEST or len(self.open) == DEEPEST and _hidden(node)):
            self.open.append(node)

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "html":
            self.root.attrs |= {k: v for k, v in attrs.items() if k not in self.root.attrs}
            self.root.own = self.root.said = css.inline(self.root.attrs.get("style", ""))
            return
        if tag not in HEAD and self.in_head:
            # What cannot stand in the head ends it.
            self._close(frozenset({"head"}), frozenset({"body", "table", "template", "noscript", "title"}) if tag != "body" else frozenset({"table", "template"}))
            self.in_head = any(n.tag == "head" for n in self.open)
        if tag in BREAKOUT and self._foreign():
            while self._foreign():
                self.open.pop()
        if tag in CLOSES_P:
            self._close(frozenset({"p"}), SCOPE)
        if tag == "li":
            self._close(frozenset({"li"}), SCOPE | {"ul", "ol", "menu", "dir"})
        elif tag in ("dt", "dd"):
            self._close(frozenset({"dt", "dd"}), SCOPE | {"dl"})
        elif tag in ("td", "th"):
            self._close(frozenset({"td", "th"}), frozenset({"tr", "table"}))
            if self._nearest("tr", "table") == "table":
                self.handle_starttag("tr", [])
        elif tag == "tr":
            self._close(frozenset({"tr"}), frozenset({"table"}))
            if self._nearest("tbody", "thead", "tfoot", "table") == "table":
                self._push("tbody", {})
        elif tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
            self._close(frozenset({"tbody", "thead", "tfoot", "caption", "colgroup"}), frozenset({"table"}))
        elif tag in ("option", "optgroup"):
            self._close(frozenset({"option"}), frozenset({"select"}))
            if tag == "optgroup":
                self._close(frozenset({"optgroup"}), frozenset({"select"}))
        self.in_head = self.in_head or tag == "head"
        self.any_foreign = self.any_foreign or tag in FOREIGN
        self._push(tag, attrs)

    def _nearest(self, *tags: str) -> str | None:
        return next((n.tag for n in reversed(self.open) if n.tag in tags), None)

    def _foreign(self) -> bool:
        """Whether markup stands in a drawing or a formula."""
        if not self.any_foreign:
            return False
        return next((n.tag in FOREIGN for n in reversed(self.open) if n.tag in FOREIGN or n.tag in INTEGRATION), False)

    def handle_startendtag(self, tag, attrs):
        # The slash closes only what is foreign to HTML.
        closes = tag in FOREIGN or self._foreign() and tag not in BREAKOUT
        self.handle_starttag(tag, attrs)
        if closes and self.open[-1] is self._last:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self._push("br", {})
            return
        limits = SCOPE - {tag} if tag not in ("table", "tbody", "thead", "tfoot", "tr") else frozenset({"table"}) - {tag}
        self._close(frozenset({tag}), limits)

    def handle_data(self, data):
        if self.cdata_elem == "textarea":
            data = unescape(data)
        elif self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)

    def close(self):
        super().close()
        if self.cdata_elem == "textarea":
            self.handle_data(self.rawdata)  # never closed


class Flow:
    """Lines of one block formatting context: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.indent = 0
        self.mark = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._add(first)
            for x in rest:
                self.end(True)
                self._add(x)
            return
        parts = _SPACE.split(data)
        for i, x in enumerate(parts):
            if i and self.line:
                self.space = True
            if x:
                self._add(x)

    def _add(self, x: str) -> None:
        if not x:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(x)

    def end(self, always: bool = False) -> None:
        """End the line; an empty one counts only if always."""
        self.space = False
        if self.line or always:
            self.put(["".join(self.line)])
            self.line = []

    def put(self, lines: list[str]) -> None:
        if self.gap and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = False
        for x in lines:
            pad = " " * min(self.indent, DEEPEST_INDENT)
            if self.mark and x:
                pad, self.mark = pad[: max(0, len(pad) - len(self.mark))] + self.mark, ""
            self.lines.append((pad + x).rstrip())

    def result(self) -> list[str]:
        self.end()
        a, b = 0, len(self.lines)
        while a < b and not self.lines[a]:
            a += 1
        while b > a and not self.lines[b - 1]:
            b -= 1
        return self.lines[a:b]


def _cells_wide(text: str) -> int:
    """Columns of a fixed-width display: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """Column, lines and columns spanned of each cell; a cell that spans rows leaves its columns empty below."""
    out, taken = [], {}
    for row in rows:
        at, cells, below = 0, [], {}
        for lines, span, down in row:
            while taken.get(at, 0):
                at += 1
            cells.append((at, lines, span))
            for c in range(at, at + span):
                below[c] = down - 1
            at += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n for c, n in below.items() if n > 0}
        out.append(cells)
    return out


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned), padded so that columns line up."""
    placed = _placed(rows)
    width: dict[int, int] = {}
    for row in placed:
        for at, lines, span in row:
            for c in range(at, at + span):
                width.setdefault(c, 0)
            if span == 1:
                width[at] = max(width[at], *(_cells_wide(x) for x in lines or [""]))
    for row in placed:
        for at, lines, span in row:
            # The last column takes what a spanning cell needs beyond its columns.
            lacking = max(_cells_wide(x) for x in lines or [""]) - sum(width[c] for c in range(at, at + span)) - 3 * (span - 1)
            if span > 1 and lacking > 0:
                width[at + span - 1] += lacking
    out = []
    for row in placed:
        tall = max([len(lines) for _, lines, _ in row] or [0])
        for i in range(tall):
            cells, column = [], 0
            for at, lines, span in row:
                cells += [" " * width.get(c, 0) for c in range(column, at)]
                own = sum(width[c] for c in range(at, at + span)) + 3 * (span - 1)
                text = lines[i] if i < len(lines) else ""
                cells.append(text + " " * (own - _cells_wide(text)))
                column = at + span
            out.append(" | ".join(cells).rstrip())
    return out


def _hidden(node: Node) -> bool:
    """Whether a node and all below it are not laid out; what a style says goes before what the element is, but for parts that never show."""
    if node.tag in UNSEEN:
        return True
    if "display" in node.said:
        return node.said["display"][1] == "none"
    return "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs


def _strings(node: Node) -> str:
    """All text below a node that is not hidden."""
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x is node or not _hidden(x):
            stack.extend(reversed(x.children))
    return "".join(out)


def _input_text(node: Node) -> str:
    """What an input shows: its value, else the placeholder."""
    kind = node.attrs.get("type", "").strip().lower()
    if kind in TEXTLESS_INPUTS:
        return ""
    return node.attrs.get("value", "") or ("" if kind in PLAIN_INPUTS else node.attrs.get("placeholder", ""))


def _textarea_text(node: Node) -> str:
    """What a text area shows: its text without a first line break, else the placeholder."""
    value = _strings(node).replace("\r\n", "\n").removeprefix("\n")
    return value or node.attrs.get("placeholder", "")


def _select_lines(node: Node) -> list[str]:
    """What a select shows: the chosen option, or every option and group label of a list box."""
    several = "multiple" in node.attrs
    box = several or _number(node.attrs.get("size", ""), 1, 10**8) > 1
    lines, first, chosen = [], None, None
    stack = [(node, False, True)]
    while stack:
        x, off, drawn = stack.pop()
        if isinstance(x, str):
            continue
        drawn = drawn and (x is node or not _hidden(x))
        if x.tag == "option":
            label = x.attrs.get("label") or " ".join(_SPACE.split(_strings(x))).strip()
            if drawn:
                lines.append(label)
            if first is None and not off and "disabled" not in x.attrs:
                first = label
            if "selected" in x.attrs:
                chosen = label
            continue
        if x.tag == "optgroup" and drawn:
            lines.append(x.attrs.get("label", ""))
        stack.extend((c, off or x.tag == "optgroup" and "disabled" in x.attrs, drawn) for c in reversed(x.children))
    shown = lines if box else [first if chosen is None else chosen]
    return [x for x in shown if x]


def _number(value: str, default: int, most: int) -> int:
    return min(int(value), most) if value.isdecimal() and len(value) < 9 else default


def _numeral(n: int, kind: str) -> str:
    """A list number as its list's type has it; numbers that letters or Roman numerals cannot write stay as they are."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, rest = divmod(n - 1, 26)
            out = chr(97 + rest) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            while n >= value:
                out, n = out + letters, n - value
    else:
        return str(n)
    return out.upper() if kind.isupper() else out


def render(root: Node) -> str:
    """Visible text of a tree."""
    page = Flow()
    css.styled(root, lambda x: isinstance(x, str))
    flows, tables, lists = [page], [], []
    # Of a drawing, only text elements and foreign objects show their strings.
    stack = [(root, False, True, False, False)]
    while stack:
        node, leaving, shown, pre, drawing = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if drawing:
                continue
            if shown:
                flow.text(node, pre)
            elif pre:
                flow.text("", False)
            continue
        tag = node.tag
        if leaving:
            if tag in ("td", "th") and tables and tables[-1][1] is not None:
                flows.pop()
                tables[-1][1].append((flow.result(), max(1, _number(node.attrs.get("colspan", ""), 1, 100)), _number(node.attrs.get("rowspan", ""), 1, 1000) or ALL_ROWS))
            elif tag == "tr" and tables:
                if tables[-1][1]:
                    tables[-1][0].append(tables[-1][1])
                tables[-1][1] = None
            elif tag == "table":
                rows, _ = tables.pop()
                flow.end()
                flow.gap = True
                flow.put(table_lines(rows)) if rows else None
                flow.gap = True
            elif tag in ("ul", "ol", "menu", "dir"):
                flow.end()
                lists.pop()
                flow.gap = flow.gap or not lists
            elif tag in ("li", "dd", "blockquote"):
                flow.end()
                flow.indent -= 2 if tag != "li" else len(lists[-1][1]) if lists and lists[-1][1] else 2
                flow.mark = ""
                flow.gap = flow.gap or tag == "blockquote"
            elif tag in BLOCK:
                flow.end()
                flow.gap = flow.gap or tag in SPACED
            continue
        if _hidden(node) or drawing and (tag in UNDRAWN or node.attrs.get("display", "").strip() == "none" and "display" not in node.said):
            continue
        # An attribute of a drawing is weaker than any style.
        seen = node.said.get("visibility", (False, node.attrs.get("visibility", "").strip().lower() if drawing else ""))[1]
        shown = seen == "visible" if seen in css.VISIBILITIES else shown
        pre = pre or tag in ("pre", "listing", "xmp")
        if tag == "br":
            flow.end(True)
            continue
        if tag == "hr":
            flow.end()
            flow.put(["---"])
            continue
        if tag in ("input", "textarea", "select"):
            if shown and tag == "select":
                lines = _select_lines(node)
                if len(lines) > 1:
                    flow.end()
                for x in lines:
                    flow.text(f" {x} ", False)
                    if len(lines) > 1:
                        flow.end()
            elif shown and (x := _input_text(node) if tag == "input" else _textarea_text(node)):
                flow.text(" ", False)
                flow.text(x, tag == "textarea")
                flow.text(" ", False)
            continue
        if tag in ("td", "th") and tables and tables[-1][1] is not None:
            flows.append(Flow())
        elif tag == "tr" and tables:
            tables[-1][1] = []
        elif tag == "table":
            flow.end()
            tables.append([[], None])
        elif tag in ("ul", "ol", "menu", "dir"):
            flow.end()
            flow.gap = flow.gap or not lists
            items = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if "reversed" in node.attrs else 1
            lists.append([_number(node.attrs.get("start", ""), items, 10**8) if tag == "ol" else None, "", node.attrs.get("type", "1").strip(), -1 if "reversed" in node.attrs else 1])
        elif tag in ("li", "dd", "blockquote"):
            flow.end()
            flow.gap = flow.gap or tag == "blockquote"
            if tag == "li":
                mark = "- "
                if lists and lists[-1][0] is not None:
                    lists[-1][0] = _number(node.attrs.get("value", ""), lists[-1][0], 10**8)
                    mark = f"{_numeral(lists[-1][0], lists[-1][2])}. "
                    lists[-1][0] += lists[-1][3]
                if lists:
                    lists[-1][1] = mark
                flow.indent += len(mark)
                flow.mark = mark
            else:
                flow.indent += 2
        elif tag in BLOCK:
            flow.end()
            flow.gap = flow.gap or tag in SPACED
        stack.append((node, True, shown, pre, drawing))
        children = node.children
        if tag == "svg":
            drawing = True
        elif drawing and tag in ("text", "foreignobject"):
            drawing = False
            children = [" ", *children, " "]
        elif tag in ("mfrac", "mtr", "mtable"):
            children = [x for c in children for x in (" ", c, " ")]
        if tag == "details" and "open" not in node.attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        stack.extend((c, False, shown, pre, drawing) for c in reversed(children))
    return "\n".join(page.result())


def visible_text(html: str | None) -> str:
    """Laid-out visible text; null and empty pages have none."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text and n_chars of every page, one row for each row of pages.

    Null and empty pages give an empty text; repeated rows each get a row; an
    empty table gives an empty one; other columns are not read.
    """
    need(pages, "page_id", "html")
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [visible_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col("page_id").cast("long"), "html").mapInPandas(run, "page_id long, text string, n_chars long")
