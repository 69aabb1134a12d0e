"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a renderer of lines.

The tree builder closes what HTML closes by itself (paragraphs before blocks, list items, cells, rows, options), adds rows
and table bodies that are implied, and ignores end tags that match nothing. Hidden are head, scripts, styles, templates and
the like, elements with ``hidden``, ``display:none`` (the last declaration counts) or ``visibility:hidden`` (which a
descendant may lift), hidden inputs, and what is closed in ``details`` and ``dialog``. All other text is emitted, that of
``svg``, ``math`` and buttons too: runs of white space collapse outside ``pre``, blocks begin lines, blocks with margins are
set off by one blank line, list items get ``- `` or their number and hang under it, and the cells of a table stand in
aligned columns, two spaces apart (spans respected).

Bounds of the layout; no text is ever dropped. A column reserves at most ``COLUMN`` places: a wider cell runs on and the
next stands two spaces after it. At most ``PAD`` spaces go before a cell, so the output is in proportion to the page. A
rowspan counts to the table's end, a span to ``SPAN``. Spans are kept as intervals, never as cells. Tables inside tables
beyond ``TABLES`` levels are laid out as plain blocks; all else is iterative.

Null or empty html gives an empty text; repeated rows are rendered each; an empty table gives no rows; other columns, whatever
their names, are not read. Each page is handled alone, so memory follows the largest page.
"""

from __future__ import annotations

import re
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas datalist noembed noframes rp area param source track desc defs metadata annotation annotation-xml".split())
#: Blocks that stand on lines of their own, and those with a blank line around them.
BLOCKS = frozenset("address article aside body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main nav optgroup option search section summary caption tr tbody thead tfoot".split())
SPACED = frozenset("blockquote h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp listing".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
_CLOSE_P = (BLOCKS | SPACED) - frozenset("body html option optgroup caption tr tbody thead tfoot".split())
_SECTIONS = frozenset(("tbody", "thead", "tfoot"))
_CELLS = frozenset(("td", "th"))
#: A start tag closes the nearest of these, unless one of those stands between.
_CLOSES = {
    "li": ({"li"}, LISTS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "table"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": (_SECTIONS, {"table"}),
    "thead": (_SECTIONS, {"table"}),
    "tfoot": (_SECTIONS, {"table"}),
    "caption": ({"caption"}, {"table"}),
}
TABLES = 20
COLUMN, PAD, SPAN = 80, 400, 1000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|"
    r"<([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack = [root]
    count: dict[str, int] = {}  # of open elements by tag, so that deep stacks are searched only for what they hold

    def close_until(tags, walls) -> None:
        if not any(count.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                for node in stack[k:]:
                    count[node.tag] -= 1
                del stack[k:]
                return
            if stack[k].tag in walls:
                return

    def nearest(tags) -> str:
        return next((n.tag for n in reversed(stack) if n.tag in tags), "")

    def open_(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            count[tag] = count.get(tag, 0) + 1

    at = 0
    while True:
        match = _TAG.search(html, at)
        text = html[at : match.start()] if match else html[at:]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if match is None:
            return root
        at = match.end()
        if match[1]:
            tag = match[1].lower()
            if tag == "br":
                open_("br", {})
            elif tag == "p" and not count.get("p"):
                stack[-1].children.append(Node("p", {}))  # an end tag alone is an empty paragraph
            elif tag not in ("html", "body"):  # what follows them belongs to the body
                walls = () if tag in ("table", "head") else ("table",) if tag in _CELLS | _SECTIONS | {"tr", "caption"} else ("td", "th", "table")
                close_until((tag,), walls)
        elif match[2]:
            tag = match[2].lower()
            raw = match[3]
            if tag == "body" or tag not in HIDDEN and tag != "html" and stack[-1].tag == "head":
                close_until(("head",), ())
            if tag in ("html", "body") and count.get(tag):
                continue
            if tag in _CLOSE_P:
                close_until(("p",), ("td", "th", "table", "button"))
            if tag in _CLOSES:
                close_until(*_CLOSES[tag])
            if tag in _CELLS and nearest(("table", "tr")) == "table":
                if nearest(("table", *_SECTIONS)) == "table":
                    open_("tbody", {})
                open_("tr", {})
            elif tag == "tr" and nearest(("table", *_SECTIONS)) == "table":
                open_("tbody", {})
            open_(tag, _attributes(raw) if raw and "=" in raw or raw.strip(" /\t\n\r\f") else {})
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                inner = html[at : end.start()] if end else html[at:]
                stack[-1].children.append(unescape(inner) if tag in ("title", "textarea") else inner)
                count[stack.pop().tag] -= 1
                at = html.find(">", end.end()) + 1 or len(html) if end else len(html)


class Lines:
    """Collects text into lines, with margins and hanging indents."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.blank = self.space = False
        self.indents: list[str] = []
        self.marker = ""

    def _begin(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.indents)
        if self.marker:
            indent = indent[: len(indent) - len(self.marker)] + self.marker
            self.marker = ""
        self.current.append(indent)

    def text(self, text: str, kept: bool) -> None:
        if kept:
            for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                if k:
                    self.end(True)
                if line:
                    if not self.current:
                        self._begin()
                    self.current.append(line)
            return
        words = _SPACE.sub(" ", text)
        if words == " ":
            self.space = bool(self.current)
            return
        if not words:
            return
        if not self.current:
            self._begin()
            words = words.lstrip(" ")
        elif self.space and words[0] != " ":
            self.current.append(" ")
        elif self.space:
            words = " " + words.lstrip(" ")
        self.space = words.endswith(" ")
        self.current.append(words.rstrip(" "))

    def end(self, forced: bool = False) -> None:
        """End the line; ``forced`` ends an empty one too."""
        if self.current:
            self.lines.append("".join(self.current).rstrip(" "))
        elif forced:
            self.lines.append("")
        self.current, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank = self.blank or spaced


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether a node is laid out at all, and whether its own text is visible."""
    if node.tag in HIDDEN:
        return False, visible
    a = node.attributes
    if not a:
        return node.tag != "dialog", visible
    if "hidden" in a or node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False, visible
    if "style" in a:
        last: dict[str, tuple[bool, str]] = {}
        for name, value, important in _STYLE.findall(a["style"].lower()):
            if important or name not in last or not last[name][0]:
                last[name] = (bool(important), value)
        if last.get("display", (False, ""))[1] == "none":
            return False, visible
        if "visibility" in last:
            value = last["visibility"][1]
            visible = value == "visible" or (visible and value not in ("hidden", "collapse"))
    return True, visible


def _number(value: str | None, default: int, most: int = SPAN) -> int:
    match = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(int(match[1]), most) if match else default


def _width(text: str) -> int:
    """Places that a line takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in text)


def _rows(table: Node, visible: bool):
    """(captions, rows of (cell, visible)) of a table, in order; what stands between counts as captions."""
    captions, rows = [], []
    work = [(n, visible) for n in reversed(table.children)]
    while work:
        node, seen = work.pop()
        if isinstance(node, str):
            if node.strip(" \t\n\r\f"):
                captions.append((node, seen))
            continue
        shown, seen = _shown(node, seen)
        if not shown:
            continue
        if node.tag in _SECTIONS:
            work += [(n, seen) for n in reversed(node.children)]
        elif node.tag == "tr":
            cells = []
            for child in node.children:
                if not isinstance(child, str) and child.tag in _CELLS:
                    laid, own = _shown(child, seen)
                    if laid:
                        cells.append((child, own))
                elif not isinstance(child, str) or child.strip(" \t\n\r\f"):
                    captions.append((child, seen))
            rows.append(cells)
        elif node.tag not in ("col", "colgroup"):
            captions.append((node, seen))
    return captions, rows


def _placed(rows):
    """(row, first column, column beyond, cell, visible) of all cells.

    ``held`` are the columns that cells of earlier rows still reach down to: (first, beyond, row beyond), by column.
    """
    out, held = [], []
    for r, cells in enumerate(rows):
        held = [h for h in held if h[2] > r]
        c, k, new = 0, 0, []
        for cell, visible in cells:
            while k < len(held) and held[k][0] <= c:
                c = max(c, held[k][1])
                k += 1
            wide = max(1, _number(cell.attributes.get("colspan"), 1))
            down = _number(cell.attributes.get("rowspan"), 1, len(rows))
            high = len(rows) - r if down == 0 else max(1, down)  # 0: to the end
            out.append((r, c, c + wide, cell, visible))
            if high > 1:
                new.append((c, c + wide, r + high))
            c += wide
        if new:
            held = sorted(held + new)
    return out


def _table(rows, depth: int) -> list[str]:
    """The lines of a grid of cells, in aligned columns."""
    placed = [(r, a, b, render(cell, visible, depth + 1)) for r, a, b, cell, visible in _placed(rows)]
    # only columns at which a cell begins or ends matter; from left to right, each starts where all that end there allow
    edges = sorted({e for _, a, b, _ in placed for e in (a, b)})
    ending: dict[int, list[tuple[int, int]]] = {}
    for _, a, b, lines in placed:
        width = min(max(map(_width, lines), default=0), COLUMN)
        if width:
            ending.setdefault(b, []).append((a, width + 2))
    starts: dict[int, int] = {}
    at = 0
    for e in edges:
        at = max([at, *(starts[a] + n for a, n in ending.get(e, ()))])
        starts[e] = at
    out: list[str] = []
    own: list[list] = [[] for _ in rows]
    for r, a, _, lines in placed:
        own[r].append((starts[a], lines))
    for cells in own:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            parts, at = [], 0
            for start, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = min(max(start - at, 2 if at else 0), PAD)
                    parts.append(" " * gap + lines[k])
                    at += gap + _width(lines[k])
            out.append("".join(parts).rstrip(" "))
    return out


def render(root: Node, visible: bool = True, depth: int = 0) -> list[str]:
    """The lines of what is visible under ``root``."""
    out = Lines()
    counters: list[list] = []  # of open lists: [ordered, next number]
    work: list = [("enter", n, visible, False) for n in reversed(root.children)]
    while work:
        what, node, seen, kept = work.pop()
        if what == "leave":
            if node.tag in LISTS:
                counters.pop()
            out.block(node.tag in SPACED and not (node.tag in LISTS and counters))
            if node.tag in ("li", "dd", "blockquote"):
                out.indents.pop()
                out.marker = ""
            continue
        if isinstance(node, str):
            if seen:
                out.text(node, kept)
            continue
        shown, seen = _shown(node, seen)
        if not shown:
            continue
        tag = node.tag
        children = node.children
        if tag == "br":
            out.end(True)
            continue
        if tag == "input" and node.attributes.get("type", "").lower() in ("submit", "button", "reset"):
            if seen:
                out.text(node.attributes.get("value", ""), False)
            continue
        if tag == "wbr":
            continue
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
        if tag == "table" and depth < TABLES:
            out.block(True)
            captions, rows = _rows(node, seen)
            for caption, own in captions:
                wrapper = Node("#part", {})
                wrapper.children = [caption]
                for line in render(wrapper, own, depth + 1):
                    out.text(line, True)
                    out.end(True)
            for line in _table(rows, depth):
                out.text(line, True)
                out.end(True)
            out.block(True)
            continue
        if tag in SPACED or tag in BLOCKS or tag in _CELLS:
            nested = tag in LISTS and bool(counters)
            out.block(tag in SPACED and not nested)
            if tag in LISTS:
                counters.append([tag == "ol", _number(node.attributes.get("start"), 1, 10**9)])
            if tag == "li":
                if counters and counters[-1][0]:
                    counters[-1][1] = _number(node.attributes.get("value"), counters[-1][1], 10**9)
                    out.marker = f"{counters[-1][1]}. "
                    counters[-1][1] += 1
                else:
                    out.marker = "- "
                out.indents.append(" " * len(out.marker))
            elif tag in ("dd", "blockquote"):
                out.indents.append("  ")
            work.append(("leave", node, seen, kept))
        kept = kept or tag in ("pre", "textarea", "xmp", "listing")
        work += [("enter", n, seen, kept) for n in reversed(children)]
    out.end()
    return out.lines


def text_of(html: str) -> str:
    """The visible text of a page; blank lines at either end are dropped."""
    lines = render(parse(html))
    return "\n".join(lines).strip("\n").replace(" ", " ")


def _extracted(batches):
    for batch in batches:
        texts = [text_of(h) if h else "" for h in batch.column("html").to_pylist()]
        n_lines = [t.count("\n") + 1 if t else 0 for t in texts]
        columns = [batch.column("page_id"), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(n_lines, type=pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "n_chars", "n_lines"])


def page_texts(pages: DataFrame) -> DataFrame:
    """Every row of ``pages``: page_id, text, n_chars, n_lines. Other columns are not read."""
    return pages.selectExpr("cast(page_id as long) page_id", "html").mapInArrow(_extracted, "page_id long, text string, n_chars long, n_lines long")
