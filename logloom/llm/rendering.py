"""Visible text of web pages, laid out: blocks, lists and aligned tables.

A page becomes a tree first: void and raw-text elements, implied end tags (p, li, dt, dd, option, cells and
rows), implied rows, misnested formatting, text between the rows of a table moved before it. Hidden
parts (head, scripts, styles, templates, the hidden attribute, display:none, closed details, descriptions and
definitions of drawings, annotations of formulas) are left out, and text of visibility:hidden, save what is visible again inside.
Texts of drawings and formulas are inline text; fields show their value, other than ticks, files, passwords, colours and ranges. The rest is rendered in one walk: white space collapses except in
preformatted text, blocks start lines, paragraphs and headings are set off by an empty line, list items
carry bullets or numbers and are indented, and the cells of a table stand in columns.

A column is as wide as its widest cell of up to ``WIDE_CELL`` columns; wider cells stick out, so that a
long cell neither is cut nor widens every row. Pages are independent of each other: the work is one
map over the table. Elements nested deeper than ``MAX_DEPTH`` are
laid out as if their content stood at that level; none of it is lost.

Defined results: a null page renders as null, the empty page as the empty text; what stands behind
an unfinished tag, comment or script belongs to it; repeated rows render alike.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.texts import map_batches

#: Widest cell that makes its column wider; elements nested deeper than that take their content to the last level.
WIDE_CELL, MAX_DEPTH = 60, 512


def _names(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Fixed values of the HTML standard: groups of elements.
VOID = _names("area base br col embed hr img input link meta source track wbr")
RAW = _names("script style xmp iframe noembed noframes noscript")
ESCAPABLE = _names("title textarea")
FORMATTING = _names("a b big code em font i nobr s small strike strong tt u")
HIDDEN = _names("head script style template noscript noembed noframes iframe datalist audio video canvas object title desc defs symbol metadata annotation annotation-xml")
#: Types of input whose value is not shown as text.
NO_TEXT = _names("hidden checkbox radio file password image color range")
SPACED = _names("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr")
BLOCK = SPACED | _names("address article aside body center details dialog dir div dd dt figcaption footer form header hgroup "
                        "html legend li listing main menu nav option optgroup search section summary caption tr")
IN_HEAD = _names("base link meta title script style template noscript basefont bgsound")
HEADINGS = _names("h1 h2 h3 h4 h5 h6")
LISTS = _names("ul ol menu dir")
ROWS = _names("thead tbody tfoot")
CELLS = _names("td th")
#: Start tags that end an open element, and the elements beyond which they do not look.
ENDS = {
    "li": (_names("li"), LISTS), "dt": (_names("dt dd"), _names("dl")), "dd": (_names("dt dd"), _names("dl")),
    "option": (_names("option"), _names("select datalist")), "optgroup": (_names("option optgroup"), _names("select")),
    "td": (CELLS, _names("tr table")), "th": (CELLS, _names("tr table")),
    "tr": (_names("td th tr caption"), _names("table")),
    "thead": (_names("td th tr caption thead tbody tfoot"), _names("table")),
    "tbody": (_names("td th tr caption thead tbody tfoot"), _names("table")),
    "tfoot": (_names("td th tr caption thead tbody tfoot"), _names("table")),
    "rt": (_names("rt rp"), _names("ruby")), "rp": (_names("rt rp"), _names("ruby")),
}
PARAGRAPH_LIMIT = _names("td th caption table button object html")
ENDS_PARAGRAPH = BLOCK - _names("html body caption tr option optgroup legend")

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+""")
_TAG_END = re.compile(r"[\s/]*+>")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "name", "visible")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children, self.visible = name, attributes, [], True


class Builder:
    """Builds the tree of a page."""

    def __init__(self):
        self.root = Node("html", {})
        self.open = [self.root]

    def _end_open(self, names: frozenset[str], limit: frozenset[str]) -> None:
        """End the outermost open element of ``names`` this side of ``limit``."""
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name in limit:
                break
            if self.open[at].name in names:
                end = at
                # rows and groups end with all that is open in them
                while end > 1 and self.open[end - 1].name in names:
                    end -= 1
                del self.open[end:]
                break

    def _before_table(self) -> Node | None:
        """Where text that stands between the rows of a table goes."""
        if self.open[-1].name not in ROWS and self.open[-1].name not in ("table", "tr", "colgroup"):
            return None
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].name == "table":
                return self.open[at - 1]
        return None

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open[-1].name == "head" and text.strip(" \t\n\r\f"):
            self.open.pop()
        parent = self._before_table()
        if parent is None:
            self.open[-1].children.append(text)
        elif text.strip(" \t\n\r\f"):
            parent.children.insert(len(parent.children) - 1, text)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in ("html", "body"):
            for key, value in attributes.items():
                self.root.attributes.setdefault(key, value)
            if name == "body":
                self._end_open(frozenset(("head",)), frozenset())
            return
        if name in ENDS:
            self._end_open(*ENDS[name])
        if name in ENDS_PARAGRAPH:
            self._end_open(frozenset("p"), PARAGRAPH_LIMIT)
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        if self.open[-1].name == "head" and name not in IN_HEAD:
            self.open.pop()
        if name in CELLS and (self.open[-1].name == "table" or self.open[-1].name in ROWS):
            self._push("tr", {})
        parent = self._before_table() if name not in CELLS and name not in ROWS and name not in (
            "tr", "caption", "col", "colgroup", "script", "style", "template") else None
        node = Node(name, attributes)
        if parent is None:
            self.open[-1].children.append(node)
        else:
            parent.children.insert(len(parent.children) - 1, node)
        if name not in VOID and len(self.open) < MAX_DEPTH:
            self.open.append(node)

    def _push(self, name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes)
        self.open[-1].children.append(node)
        self.open.append(node)

    def end(self, name: str) -> None:
        if name == "br":
            self.open[-1].children.append(Node("br", {}))
            return
        # The end tag of an element in a cell does not reach beyond the cell, one of a cell or row not beyond the table.
        if name in CELLS or name in ROWS or name == "tr":
            limit = frozenset(("table",))
        else:
            limit = frozenset() if name in ("table", "head") else CELLS | {"table", "caption"}
        for at in range(len(self.open) - 1, 0, -1):
            node = self.open[at]
            if node.name == name or name in HEADINGS and node.name in HEADINGS:
                inner = self.open[at + 1:]
                if name in FORMATTING and any(x.name in BLOCK for x in inner):
                    del self.open[at]  # blocks inside stay open
                else:
                    del self.open[at:]
                return
            if node.name in limit:
                break
        if name == "p":
            self.open[-1].children.append(Node("p", {}))


def tree(page: str) -> Node:
    """The tree of a page."""
    builder, at, size = Builder(), 0, len(page)
    while at < size:
        mark = page.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            text = page[at:mark]
            builder.text(html.unescape(text) if "&" in text else text)
            at = mark
            continue
        found = _TAG.match(page, at)
        if not found:
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 2)
                at = size if stop < 0 else stop + 3
            elif page.startswith(("<!", "<?", "</"), at):
                stop = page.find(">", at)
                at = size if stop < 0 else stop + 1
            else:
                builder.text("<")
                at += 1
            continue
        name, closing, at, attributes = found[1].lower(), page[at + 1] == "/", found.end(), {}
        while at < size and page[at] != ">":
            end = _TAG_END.match(page, at)
            if end:
                at = end.end() - 1
                break
            part = _ATTRIBUTE.match(page, at)
            if not part:
                # an unfinished quote runs to the end of the page; other stray signs are passed over
                at = size if page[at] in "\"'" and page.find(page[at], at + 1) < 0 else at + 1
                continue
            value = part[2] or ""
            value = value[1:-1] if value[:1] in ("'", '"') else value
            attributes.setdefault(part[1].lower(), html.unescape(value) if "&" in value else value)
            at = part.end()
        if at >= size:
            break
        at += 1
        if closing:
            builder.end(name)
            continue
        builder.start(name, attributes)
        if name in RAW or name in ESCAPABLE:
            stop = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
            text = page[at:stop.start() if stop else size]
            builder.text(html.unescape(text) if name in ESCAPABLE else text)
            if name == "textarea" or name in RAW or name == "title":
                builder.end(name)
            at = size if not stop else page.find(">", stop.end()) + 1 or size
        elif name == "plaintext":
            builder.text(page[at:])
            at = size
    return builder.root


def hidden(node: Node, parent: Node | None) -> bool:
    """Whether a browser would not show the element."""
    if node.name in HIDDEN or "hidden" in node.attributes:
        return True
    if node.name == "dialog" and "open" not in node.attributes:
        return True
    if parent is not None and parent.name == "details" and "open" not in parent.attributes and node.name != "summary":
        return True
    style = node.attributes.get("style")
    return bool(style and _HIDING.search(style))


def _visible(node: Node, parent: Node | None) -> bool:
    """Whether an element's own text is seen: as its style says last, else as its parent's."""
    said = _VISIBILITY.findall(node.attributes.get("style") or "")
    return said[-1].lower() == "visible" if said else parent is None or parent.visible


def width(text: str) -> int:
    """Columns that a text takes: two for wide signs, none for marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Text laid out line by line."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def _lead(self) -> str:
        """Room before a new line; the first line of a list item has its marker there."""
        lead = "".join(self.indent)
        if self.marker:
            lead = lead[:len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        return lead

    def _begin(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.now.append(self._lead())

    def flow(self, text: str) -> None:
        words = _SPACES.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words and self.now)
            return
        if not self.now:
            self._begin()
            words = words.lstrip(" ")
        elif self.space and words[0] != " ":
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words.rstrip(" ") if self.space else words)

    def exact(self, text: str) -> None:
        for number, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if number:
                self.break_line(keep=True)
            if line:
                if not self.now:
                    self._begin()
                self.now.append(line)

    def break_line(self, keep: bool = False) -> None:
        """End the line; ``keep`` makes a line even of nothing, as a br does."""
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        elif keep and self.lines:
            self.lines.append("")
        self.space = False

    def block(self, gap: int) -> None:
        self.break_line()
        self.gap = max(self.gap, gap)

    def whole(self, lines: list[str], gap: int) -> None:
        """Lines that are laid out already."""
        self.block(gap)
        if not lines:
            return
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        for line in lines:
            self.lines.append((self._lead() + line).rstrip())
        self.gap = gap

    def done(self) -> list[str]:
        self.break_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(text: str | None, least: int, most: int, default: int) -> int:
    found = re.match(r"\s*([-+]?\d{1,9})", text or "", re.A)
    return min(max(int(found[1]), least), most) if found else default


class Table:
    """The cells of a table, row by row."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # place, span, lines
        self.taken: dict[int, int] = {}  # rows that a cell above still takes, by column
        self.waiting: dict[int, int] = {}
        self.caption: list[str] = []

    def start_row(self) -> None:
        self.taken = {place: left - 1 for place, left in self.taken.items() if left > 1}
        self.rows.append([])

    def add(self, node: Node, lines: list[str]) -> None:
        row = self.rows[-1]
        place = row[-1][0] + row[-1][1] if row else 0
        while self.taken.get(place, 0) > 0:
            place += 1
        span = _number(node.attributes.get("colspan"), 1, 1000, 1)
        row.append((place, span, lines))
        down = _number(node.attributes.get("rowspan"), 1, 65_534, 1)
        if down > 1:
            self.waiting |= dict.fromkeys(range(place, place + span), down)

    def end_row(self) -> None:
        self.taken |= self.waiting
        self.waiting = {}

    def lines(self) -> list[str]:
        sizes: dict[int, int] = {}
        for row in self.rows:
            for place, span, lines in row:
                wide = max(map(width, lines), default=0)
                if span == 1 and wide <= WIDE_CELL:
                    sizes[place] = max(sizes.get(place, 0), wide)
        out = list(self.caption)
        for row in self.rows:
            for number in range(max((len(lines) for _, _, lines in row), default=0)):
                line, reached, left = "", 0, 0
                for place, _, lines in row:
                    for skipped in range(reached, place):
                        left += sizes.get(skipped, 0) + 2
                    reached = max(reached, place)
                    text = lines[number] if number < len(lines) else ""
                    if text:
                        line += " " * max(left - width(line), 2 if line else 0) + text
                out.append(line)
        return out


def render(page: str | None) -> str | None:
    """The visible text of a page."""
    if page is None:
        return None
    out, buffers, tables, lists, pre = Lines(), [], [], [], 0
    walk: list[tuple] = [(tree(page), None, False)]
    while walk:
        node, parent, leaving = walk.pop()
        if isinstance(node, str):
            if not parent.visible or parent.name == "details" and "open" not in parent.attributes:
                continue
            (out.exact if pre else out.flow)(node)
            continue
        name = node.name
        if not leaving:
            if hidden(node, parent):
                continue
            node.visible = _visible(node, parent)
            if name == "br":
                out.break_line(keep=True)
                continue
            if name == "hr":
                if node.visible:
                    out.whole(["---"], 1)
                continue
            if name == "input":
                if node.visible and node.attributes.get("type", "").strip().lower() not in NO_TEXT:
                    out.flow(f" {node.attributes.get('value', '')} ")
                continue
            if name in VOID:
                continue
            walk.append((node, parent, True))
            walk.extend((child, node, False) for child in reversed(node.children))
            if name == "table":
                buffers.append(out)
                tables.append(Table())
                out = Lines()
            elif name in CELLS and tables:
                if not tables[-1].rows:
                    tables[-1].start_row()
                buffers.append(out)
                out = Lines()
            elif name == "caption" and tables:
                buffers.append(out)
                out = Lines()
            elif name == "tr" and tables:
                tables[-1].start_row()
            elif name in LISTS:
                out.block(0 if lists else 1)
                first = _number(node.attributes.get("start"), -10**9, 10**9, 1)
                lists.append([name == "ol", first, -1 if "reversed" in node.attributes else 1])
            elif name == "li":
                out.block(0)
                ordered = bool(lists and lists[-1][0])
                if ordered and "value" in node.attributes:
                    lists[-1][1] = _number(node.attributes["value"], -10**9, 10**9, lists[-1][1])
                mark = f"{lists[-1][1]}. " if ordered else "- "
                if lists:
                    lists[-1][1] += lists[-1][2]
                out.indent.append(" " * len(mark))
                out.marker = mark if node.visible else ""
            elif name in ("dd", "blockquote"):
                out.block(int(name == "blockquote"))
                out.indent.append("    " if name == "dd" else "> ")
            elif name in BLOCK:
                out.block(int(name in SPACED and not (lists and name == "p")))
            if name in ("pre", "textarea", "listing", "xmp", "plaintext"):
                pre += 1
                if name in ("pre", "listing", "textarea") and node.children and isinstance(node.children[0], str) \
                        and node.children[0].startswith("\n"):
                    walk[-1] = (node.children[0][1:], node, False)
            continue
        if name in ("pre", "textarea", "listing", "xmp", "plaintext"):
            pre -= 1
        if name == "table":
            table, loose = tables.pop(), out.done()
            out = buffers.pop()
            out.whole(table.lines() + loose, 1)
        elif name in CELLS and tables:
            tables[-1].add(node, out.done())
            out = buffers.pop()
        elif name == "caption" and tables:
            tables[-1].caption += out.done()
            out = buffers.pop()
        elif name == "tr" and tables:
            tables[-1].end_row()
        elif name in LISTS:
            lists.pop()
            out.block(0 if lists else 1)
        elif name == "li":
            out.block(0)
            out.indent.pop()
            out.marker = ""
        elif name in ("dd", "blockquote"):
            out.block(int(name == "blockquote"))
            out.indent.pop()
        elif name in BLOCK:
            out.block(int(name in SPACED and not (lists and name == "p")))
    return "\n".join(out.done())


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: id, text, n_chars and n_lines."""
    narrow = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [render(page.as_py()) for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()),
                 pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                 pa.array([None if t is None else len(t.split("\n")) if t else 0 for t in texts], pa.int64())],
                names=[id_col, "text", "n_chars", "n_lines"])

    kind = narrow.schema["id"].dataType.simpleString()
    return map_batches(narrow, run, f"`{id_col}` {kind}, text string, n_chars long, n_lines long")
