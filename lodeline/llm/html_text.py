"""HTML to text the way a browser lays it out: all visible text, block by block.

Tags build a tree: void elements never open, elements whose end tag may be left
out are closed by what follows, and stray end tags close only what is open.
Elements that don't show (by kind, ``hidden``, an inline style, a simple rule of
the page's own style sheets, or as the inside of closed details) give nothing;
what is invisible keeps its place, and what is visible within it shows. Of a
drop-down list the chosen option shows. The tree is then rendered: runs of white space become one
space except in preformatted text, blocks stand on lines of their own,
paragraphs and headings keep a blank line between them, list items get their
bullets or numbers and their depth, and table cells are padded to columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Generator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lodeline.llm.arrow import by_text

#: Fixed values, as HTML has them: elements without content, with raw text, that aren't shown, and blocks with and without margins.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas math datalist title desc metadata".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCK = MARGIN | frozenset("html body div section article aside header footer main nav address form li dt dd tr caption thead tbody tfoot details summary figcaption legend center hgroup search menu dir".split())
#: An opening tag first closes these open elements, up to the given boundaries.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "colgroup": ({"caption"}, {"table"}), "col": ({"caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
#: What a table is made of, and the rows and cells that an opening tag implies between a table and itself.
ROWS = frozenset("tr thead tbody tfoot".split())
IMPLIES = {"tr": {"table": ["tbody"]}, "td": {"table": ["tbody", "tr"], "thead": ["tr"], "tbody": ["tr"], "tfoot": ["tr"]}}
IMPLIES["th"] = IMPLIES["td"]
#: What ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "tr", "td", "th", "caption", "thead", "tbody", "tfoot"}
#: An end tag doesn't reach beyond these.
SCOPE = frozenset("table td th caption html template button object".split())
#: End tags that do.
UNBOUND = frozenset("table tr tbody thead tfoot html body".split())
#: Levels by which a list's items are moved in, at most; deeper ones stand as far in as this.
INDENTED = 50

#: An attribute: any name, and a value up to its quote or, without one, to white space or the tag's end, whatever quotes are in it.
_VALUE = r"\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))"
_ATTRIBUTE = re.compile(rf"([^\s/>][^\s/>=]*)(?:{_VALUE})?")
_ATTRIBUTES = rf"(?:[\s/]+|[^\s/>][^\s/>=]*(?:{re.sub(r'[(](?![?])', '(?:', _VALUE)})?)*+"
_TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.DOTALL)
_GONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
#: A rule of a style sheet; rules within others, as of media, are left alone.
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"([A-Za-z][\w-]*)?((?:[.#][\w-]+)*)\Z")
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    """An element, with text and elements as children."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    seen: bool = True
    shown: bool = True


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _hiding(sheets: list[str]) -> list[tuple[str, frozenset[str], str]]:
    """(tag, classes, id) of the simple selectors by which style sheets leave elements out."""
    out = []
    for sheet in sheets:
        flat = re.sub(r"/\*.*?(?:\*/|\Z)", "", sheet, flags=re.DOTALL)
        # what stands inside a rule in braces of its own is no rule of the page's
        flat = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", flat)
        for selectors, body in _RULE.findall(flat):
            if _GONE.search(body):
                for selector in selectors.split(","):
                    if (m := _SIMPLE.match(selector.strip())) and m[0]:
                        ids = re.findall(r"#([\w-]+)", m[2])
                        if len(ids) < 2:
                            out.append(((m[1] or "").lower(), frozenset(re.findall(r"\.([\w-]+)", m[2])), ids[0] if ids else ""))
    return out


def _leave_out(root: Node, rules: list[tuple[str, frozenset[str], str]]) -> None:
    stack = [root]
    while stack:
        now = stack.pop()
        held = frozenset(now.attributes.get("class", "").split())
        if any((not tag or tag == now.tag) and classes <= held and (not own or own == now.attributes.get("id")) for tag, classes, own in rules):
            now.seen = False
        stack.extend(c for c in now.children if isinstance(c, Node))


def parse(source: str) -> Node:
    """The tree of a page; anything parses, and nothing but comments and tags is lost."""
    source = source.replace("\r\n", "\n").replace("\r", "\n")
    sheets: list[str] = []
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack each kind of element is open, so that no tag walks the stack
    scopes = [0]
    at = 0

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        while len(stack) > i:
            gone = stack.pop().tag
            places[gone].pop()
            if gone in SCOPE:
                scopes.pop()

    def innermost(tag: str) -> int:
        held = places.get(tag)
        return held[-1] if held else 0

    def add(text: str) -> None:
        if text:
            if stack[-1].tag == "colgroup" and not text.isspace():
                cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    while m := _TAG.search(source, at):
        add(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            i = innermost(tag)
            if i and (i >= scopes[-1] or tag in UNBOUND):
                cut(i)
            continue
        if tag in ("html", "body") and places.get(tag):
            continue
        if stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            cut(len(stack) - 1)
        if tag in CLOSES:
            closed, until = CLOSES[tag]
            edge = max(map(innermost, until), default=0)
            held = [p[j] for c in closed if (p := places.get(c)) and (j := bisect_right(p, edge)) < len(p)]
            if held:
                cut(min(held))
        if tag in ENDS_P and innermost("p") > scopes[-1]:
            cut(innermost("p"))
        if stack[-1].tag == "head" and tag not in ("meta", "title", "link", "style", "script", "base", "template", "noscript"):
            cut(len(stack) - 1)
        for implied in IMPLIES.get(tag, {}).get(stack[-1].tag, ()):
            stack[-1].children.append(Node(implied, shown=stack[-1].shown))
            push(stack[-1].children[-1])
        attributes = _attributes(m[3]) if m[3] and not m[3].isspace() else {}
        node = Node(tag, attributes)
        style = attributes.get("style", "")
        node.seen = tag not in UNSEEN and not ("hidden" in attributes or _GONE.search(style) or tag == "input")
        visible = _VISIBILITY.search(style)
        node.shown = visible[1].lower() == "visible" if visible else stack[-1].shown
        stack[-1].children.append(node)
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(f"</{tag}(?=[\\s/>])|\\Z", re.IGNORECASE).search(source, at)
            if tag == "style":
                sheets.append(source[at : end.start()])
            node.children.append(source[at : end.start()] if tag not in ("title", "textarea") else html.unescape(source[at : end.start()]))
            close = source.find(">", end.end())
            at = len(source) if close < 0 else close + 1
        elif tag not in VOID:
            push(node)
    add(source[at:])
    if rules := _hiding(sheets):
        _leave_out(root, rules)
    return root


class Writer:
    """Lines of text with pending spaces and margins."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.margin = 0
        self.lead = ""

    def text(self, value: str, pre: bool) -> None:
        if pre:
            parts = value.split("\n")
            for i, part in enumerate(parts):
                if i:
                    # a line that is empty is a line
                    if self.line:
                        self._end()
                    elif self.lines:
                        self.margin += 1
                if part:
                    self._put(part)
            return
        flat = _SPACES.sub(" ", value)
        if not flat or flat == " ":
            self.space = self.space or bool(flat and self.line)
            return
        if flat[0] == " " and self.line:
            self.space = True
        self._put(flat.strip(" "))
        self.space = flat[-1] == " "

    def _put(self, value: str) -> None:
        if not self.line:
            if self.lines:
                self.lines.extend([""] * self.margin)
            if self.lead:
                self.line.append(self.lead)
            self.lead, self.margin = "", 0
        elif self.space:
            self.line.append(" ")
        self.space = False
        if value:
            self.line.append(value)

    def _end(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, margin: int) -> None:
        """Begin a new line, with so many blank lines before it if there is text above."""
        self._end()
        self.margin = max(self.margin, margin)

    def broken(self) -> None:
        """A line break; a second one in a row leaves a blank line."""
        if self.line:
            self._end()
        elif self.lines:
            self.margin += 1
        self.space = False

    def done(self) -> list[str]:
        self._end()
        return self.lines


def _cells(node: Node) -> list[list[Node]]:
    rows: list[list[Node]] = []
    stack = [node]
    while stack:
        now = stack.pop()
        if now.tag == "tr":
            rows.append([c for c in now.children if isinstance(c, Node) and c.tag in ("td", "th") and c.seen])
        else:
            stack.extend(c for c in reversed(now.children) if isinstance(c, Node) and c.seen and c.tag in ROWS)
    return rows


def _loose(table: Node) -> list[list]:
    """What a table, its sections and its rows hold beside cells, captions and columns, by its parent; a browser shows it before the table."""
    out: list[list] = []
    stack = [table]
    while stack:
        now = stack.pop()
        own = ("td", "th") if now.tag == "tr" else ("caption", "colgroup") if now is table else ()
        part = [c for c in now.children if (c.strip() if isinstance(c, str) else c.seen and c.tag not in own and c.tag not in ROWS)]
        if part:
            out.append(part)
        stack.extend(c for c in reversed(now.children) if isinstance(c, Node) and c.seen and c.tag in ROWS)
    return out


def _number(value: str, least: int, most: int) -> int:
    return min(max(int(value), least), most) if value.isascii() and value.isdigit() else least


def _signed(value: str | None, other: int) -> int:
    """A whole number of an attribute, of at most nine digits."""
    return int(value) if value and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value, re.ASCII) else other


def _options(node: Node) -> list[Node]:
    """The options of a list that show: all if it is open, else the last that is selected or the first."""
    found, stack = [], [node]
    while stack:
        now = stack.pop()
        if now.tag == "option":
            found.append(now)
        stack.extend(c for c in reversed(now.children) if isinstance(c, Node) and c.seen)
    if "multiple" in node.attributes or _number(node.attributes.get("size", ""), 1, 1000) > 1:
        return found
    return ([o for o in found if "selected" in o.attributes] or found[:1])[-1:]


def _drawn(node: Node) -> list[Node]:
    """The texts of a drawing."""
    found, stack = [], [node]
    while stack:
        now = stack.pop()
        if now.tag in ("text", "foreignobject"):
            found.append(now)
        else:
            stack.extend(c for c in reversed(now.children) if isinstance(c, Node) and c.seen)
    return found


def _table(node: Node) -> Generator:
    """The rows of a table, every cell padded to the width of its column; cells that span columns take their room."""
    grid: list[list[tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for row in _cells(node):
        out: list[tuple[list[str], int]] = []
        column = 0
        for cell in row:
            while held.get(column, 0):
                held[column] -= 1
                out.append(([], 1))
                column += 1
            span = _number(cell.attributes.get("colspan", ""), 1, 100)
            down = _number(cell.attributes.get("rowspan", ""), 1, 1000)
            out.append(((yield _rendered(cell)), span))
            for c in range(column, column + span):
                held[c] = down - 1
            column += span
        for c, left in held.items():
            if c >= column and left:
                held[c] = left - 1
        grid.append(out)
    widths: dict[int, int] = {}
    for out in grid:
        column = 0
        for lines, span in out:
            if span == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines), 0) if lines else widths.get(column, 0)
            column += span
    result = []
    for out in grid:
        room, column = [], 0
        for _, span in out:
            room.append(sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1))
            column += span
        for i in range(max((len(lines) for lines, _ in out), default=0)):
            parts = [(lines[i] if i < len(lines) else "").ljust(width) for (lines, _), width in zip(out, room, strict=True)]
            result.append("  ".join(parts).rstrip())
    return result


def render(node: Node) -> list[str]:
    """The lines of a tree or of a part of it, however deep it is: what would call itself yields what it needs instead."""
    stack, value = [_rendered(node)], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _rendered(node: Node) -> Generator:
    writer = Writer()
    yield _render(node, writer, False, 0)
    return writer.done()


def _render(node: Node, out: Writer, pre: bool, lists: int) -> Generator:
    down = node.tag == "ol" and "reversed" in node.attributes
    number = _signed(node.attributes.get("start"), sum(1 for c in node.children if isinstance(c, Node) and c.tag == "li" and c.seen) if down else 1)
    children = node.children
    if node.tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
        children = [children[0][1:], *children[1:]]
    if node.tag == "details" and "open" not in node.attributes:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    for child in children:
        if isinstance(child, str):
            if node.shown:
                out.text(child, pre)
            continue
        if not child.seen:
            continue
        tag = child.tag
        if tag == "br":
            out.broken()
            continue
        if tag == "img":
            if child.shown and child.attributes.get("alt", "").strip():
                out.text(child.attributes["alt"], False)
            continue
        margin = 1 if tag in MARGIN and not (lists and tag in ("ul", "ol")) else 0
        if tag in BLOCK:
            out.block(margin)
        if tag == "table":
            captions = [[c] for c in child.children if isinstance(c, Node) and c.tag == "caption" and c.seen]
            for part in _loose(child) + captions:
                for line in (yield _rendered(Node("#part", {}, part))):
                    out.block(0)
                    out._put(line)
            for line in (yield _table(child)):
                out.block(0)
                out._put(line)
        elif tag == "li":
            number = _signed(child.attributes.get("value"), number) if node.tag == "ol" else number
            bullet = f"{number}. " if node.tag == "ol" else "* "
            number += -1 if down else 1
            out.lead = "  " * min(max(lists - 1, 0), INDENTED) + bullet
            yield _render(child, out, pre, lists)
            out.lead = ""
        elif tag in ("ul", "ol", "menu", "dir"):
            yield _render(child, out, pre, lists + 1)
        elif tag in ("td", "th"):
            out.space = True
            yield _render(child, out, pre, lists)
            out.space = True
        elif tag in ("select", "svg"):
            for part in _options(child) if tag == "select" else _drawn(child):
                out.space = out.space or bool(out.line)
                yield _render(part, out, False, lists)
                out.space = bool(out.line)
        else:
            if tag == "dd":
                out.lead = "  "
            yield _render(child, out, pre or tag in ("pre", "textarea"), lists)
        if tag in BLOCK:
            out.block(margin)


def extract(source: str) -> str:
    """The visible text of a page."""
    return "\n".join(render(parse(source)))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text, n_lines) for every whole page.

    Null pages give null with 0 lines, empty ones and pages without visible text
    the empty text. Pages are rendered one by one; repeats, null ids and further
    columns make no difference.
    """

    def run(columns: list[pa.Array], pages: list[bytes | None]) -> list[pa.Array]:
        texts = [None if p is None else extract(p.decode("utf-8", "replace")) for p in pages]
        return [columns[0], pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]

    kind = pages.schema[id_col].dataType.simpleString()
    return by_text(pages, [id_col], html_col, f"{id_col} {kind}, text string, n_lines bigint", run)
