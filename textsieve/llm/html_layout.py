"""Visible text of HTML by layout-aware rendering.

A page is cut into tags and text, a tree is built with the implied tags of HTML (a block closes an open
paragraph, an item closes the item before it, cells and rows open and close each other, stray end tags are
dropped), and the tree is rendered top to bottom: hidden subtrees are skipped, inline text flows with collapsed
white space, blocks start new lines, paragraphs and headings keep an empty line around them, list items get
their bullet or number and depth, and tables are laid out as columns padded to one width.

Hidden: what a browser with scripts never paints (scripts, styles, head, templates, ``noscript``, closed
``details`` but for the summary, ``hidden``, ``display:none`` or ``visibility:hidden`` in a ``style`` attribute or
in a rule of the page whose selector is one tag, class or id, outside at-rules other than ``@media screen`` or ``all``;
titles, descriptions and definitions of drawings and formulas). Everything else is emitted, boilerplate and the
text of drawings and formulas too, each text of a drawing on a line of its own.

Defined cases: a null page gives null, an empty one or one without visible text an empty string; broken markup
never fails, an unfinished tag at the end is dropped; nesting may be of any depth. Pages of any length are read whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame

_TAG = re.compile(
    r"<(?:!--(?:.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)(?P<close>>|\Z))",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_WHITE = re.compile(r"[ \t\n\f\r]+")
_CSS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[{};]", re.S)
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!\s*important\s*)?(?:;|$)", re.I)

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head script style title template noscript iframe object audio video canvas datalist noembed noframes base link meta".split())
#: Never painted within svg and math.
FOREIGN = frozenset(["svg", "math"])
NEVER_FOREIGN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp".split())
LISTS = frozenset("ul ol menu dir".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt legend li optgroup option".split()) | frozenset(["li", "dd", "dt"])
#: What an opening tag closes first, and the elements that stop the search for it.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: Parts of a table: where each may stand. What is open within that place is closed first.
SECTIONS = frozenset("tbody thead tfoot".split())
PLACES = {
    "td": SECTIONS | {"tr", "table"},
    "th": SECTIONS | {"tr", "table"},
    "tr": SECTIONS | {"table"},
    **{tag: frozenset(["table"]) for tag in ("tbody", "thead", "tfoot", "caption", "colgroup", "col")},
}
TABLE_CONTEXT = SECTIONS | {"table", "tr", "colgroup"}
ALLOWED_IN_TABLE = frozenset(PLACES) | {"script", "style", "template"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SCOPE = frozenset("table td th caption html".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript head html".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(raw: str) -> dict[str, str]:
    if not raw.strip(" /\t\n"):
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _close(stack: list[Node], tags: frozenset, stops: frozenset) -> None:
    """Close the nearest open element of ``tags`` that is not beyond one of ``stops``, and all within it."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in stops:
            return
        if stack[k].tag in tags:
            del stack[k:]
            if not (stack[-1].tag in tags and len(tags) > 1):
                return
            return _close(stack, tags, stops)


def _place(children: list, node: Node) -> int:
    """Index of a child, which is among the last."""
    for k in range(len(children) - 1, -1, -1):
        if children[k] is node:
            return k
    return len(children)


def build(page: str) -> tuple[Node, list[str]]:
    """Tree of a page under a root node, and the text of its style sheets."""
    root = Node("#root")
    stack, sheets, at = [root], [], 0
    opened: dict[str, int] = {}  # how often a tag was opened: end tags of others need no search

    def put(child) -> None:
        """Add a child; what may not stand in a table goes before the table."""
        if stack[-1].tag in TABLE_CONTEXT and (child.tag not in ALLOWED_IN_TABLE if isinstance(child, Node) else not child.isspace()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "table":
                    stack[k - 1].children.insert(_place(stack[k - 1].children, stack[k]), child)
                    return
        stack[-1].children.append(child)

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        put(node)
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1

    while True:
        found = _TAG.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                _close(stack, frozenset(["head"]), frozenset())
            put(html.unescape(text) if "&" in text else text)
        if not found:
            return root, sheets
        at = found.end()
        name = found["name"]
        if name is None or found["close"] == "":
            continue
        tag = name.lower()
        if found["end"]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                put(Node("p"))
            elif tag == "br":
                put(Node("br"))
            elif tag in FORMATTING:  # it ends alone, a block opened within it stays open
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k]
                        break
                    if stack[k].tag in SCOPE:
                        break
            elif opened.get(tag) and tag not in ("html", "body"):
                _close(stack, frozenset([tag]), SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") else frozenset(["table"]) - {tag})
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            stack.pop()
        if tag in CLOSES_P and opened.get("p"):
            _close(stack, frozenset(["p"]), SCOPE)
        if tag in IMPLIED:
            _close(stack, *IMPLIED[tag])
        if tag in PLACES:
            tables = [k for k in range(len(stack)) if stack[k].tag == "table"] if opened.get("table") else []
            if not tables:
                continue
            while stack[-1].tag not in PLACES[tag]:
                stack.pop()
            if tag in ("td", "th") and stack[-1].tag != "tr":
                push("tr", {})
        elif tag == "table" and stack[-1].tag in TABLE_CONTEXT:
            while stack.pop().tag != "table":
                pass
        attrs = _attributes(found["attrs"])
        if found["attrs"].endswith("/") and (tag in FOREIGN or ((opened.get("svg") or opened.get("math")) and any(n.tag in FOREIGN for n in stack))):
            put(Node(tag, attrs))
            continue
        if tag in ("html", "body") and opened.get(tag):
            continue
        if tag in VOID:
            put(Node(tag, attrs))
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inner = page[at : end.start()] if end else page[at:]
            at = end.end() if end else len(page)
            if tag == "style" and _on_screen(attrs.get("media", "")):
                sheets.append(inner)
            put(Node(tag, attrs, [html.unescape(inner) if tag in ("textarea", "title") else inner]))
        else:
            push(tag, attrs)


def _on_screen(queries: str) -> bool:
    """Whether a list of media queries holds for every screen."""
    return any(re.fullmatch(r"(?:only\s+)?(?:all|screen)|", q.strip().lower()) for q in queries.split(","))


def _rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of rules that hold on every screen; open blocks end with the sheet."""
    sheet = re.sub(r"/\*.*?(?:\*/|\Z)", " ", sheet, flags=re.S)
    open_blocks: list[tuple[str, bool, list[str]]] = []  # what stands before the brace, whether it counts, declarations
    at = 0
    for token in [*_CSS.finditer(sheet), *[None] * (sheet.count("{") + 1)]:
        if token is None and not open_blocks:
            return
        kind, end = (token[0], token.start()) if token else ("}", len(sheet))
        if kind == "{":
            head = sheet[at:end].strip()
            counts = all(ok and h.startswith("@") for h, ok, _ in open_blocks)
            if head.startswith("@"):
                name, _, rest = head[1:].partition(" ")
                counts = counts and name.lower() == "media" and _on_screen(rest)
            open_blocks.append((head, counts, []))
        elif kind == ";":
            if open_blocks:
                open_blocks[-1][2].append(sheet[at:end])
        elif kind == "}":
            if open_blocks:
                head, counts, body = open_blocks.pop()
                if counts and not head.startswith("@"):
                    yield head, ";".join([*body, sheet[at:end]])
        else:
            continue
        at = token.end() if token else len(sheet)


def hiding_selectors(sheets: list[str]) -> frozenset[str]:
    """Selectors of a single tag, ``.class`` or ``#id`` whose rule hides on every screen."""
    out = set()
    for sheet in sheets:
        for selectors, body in _rules(sheet):
            if _HIDES.search(body.strip()):
                out.update(s for s in (x.strip() for x in selectors.split(",")) if re.fullmatch(r"[.#]?[\w-]+", s))
    return frozenset(out)


def _hidden(node: Node, selectors: frozenset[str]) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in NEVER:
        return True
    if tag in selectors:
        return True
    if not attrs:
        return tag == "dialog"
    if "hidden" in attrs or (tag == "dialog" and "open" not in attrs) or (tag == "input" and attrs.get("type", "").lower() == "hidden"):
        return True
    if "style" in attrs and _HIDES.search(attrs["style"]):
        return True
    return bool(selectors) and (f"#{attrs.get('id')}" in selectors or any(f".{c}" in selectors for c in attrs.get("class", "").split()))


class _Flow:
    """Lines of one column of text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # white space seen since the last text
        self.gap = 0  # empty lines wanted before the next line
        self.indents: list[str] = []
        self.marker = ""

    def _start(self) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            self.now.append(indent[: len(indent) - len(self.marker)] + self.marker)
            self.marker = ""
        elif indent:
            self.now.append(indent)

    def text(self, raw: str) -> None:
        flat = _WHITE.sub(" ", raw)
        if flat == " ":
            self.space = True
            return
        if not self.now:
            self._start()
            flat = flat.lstrip(" ")
        elif self.space and not flat.startswith(" "):
            self.now.append(" ")
        self.space = flat.endswith(" ")
        self.now.append(flat[:-1] if self.space else flat)

    def kept_text(self, raw: str) -> None:
        for k, line in enumerate(raw.replace("\r\n", "\n").split("\n")):
            if k:
                self.line_break()
            if line:
                if not self.now:
                    self._start()
                self.now.append(line)

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now))
            self.now = []
        self.space = False

    def line_break(self) -> None:
        if not self.now:
            self._start()
        self.lines.append("".join(self.now))
        self.now = []
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def add_lines(self, lines: list[str]) -> None:
        for line in lines:
            self._start()
            self.now.append(line)
            self.end_line()

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def lay_out(rows: list[list[tuple[list[str], int, int, bool]]]) -> list[str]:
    """Lines of a table: cells are (lines, columns, rows, right-aligned); columns get one width, two spaces apart."""
    grid: list[dict[int, tuple[list[str], int, bool]]] = []
    taken: dict[int, int] = {}  # column: rows still covered by a cell above
    for row in rows:
        placed, column, next_taken = {}, 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for lines, columns, deep, right in row:
            while taken.get(column):
                column += 1
            placed[column] = (lines, columns, right)
            for c in range(column, column + columns):
                if deep > 1:
                    next_taken[c] = deep - 1
            column += columns
        grid.append(placed)
        taken = next_taken
    width: dict[int, int] = {}
    for placed in grid:
        for column, (lines, columns, _) in placed.items():
            if columns == 1:
                width[column] = max([width.get(column, 0), *map(len, lines)])
    for placed in grid:
        for column, (lines, columns, _) in placed.items():
            if columns > 1:
                have = sum(width.get(c, 0) for c in range(column, column + columns)) + 2 * (columns - 1)
                width[column + columns - 1] = width.get(column + columns - 1, 0) + max(0, max(map(len, lines), default=0) - have)
    out = []
    for placed in grid:
        for k in range(max((len(lines) for lines, _, _ in placed.values()), default=0)):
            pieces, at = [], 0
            for column in sorted(placed):
                lines, columns, right = placed[column]
                start = sum(width.get(c, 0) + 2 for c in range(column))
                room = sum(width.get(c, 0) for c in range(column, column + columns)) + 2 * (columns - 1)
                line = lines[k] if k < len(lines) else ""
                pieces.append(" " * (start - at) + (line.rjust(room) if right else line.ljust(room)))
                at = start + room
            out.append("".join(pieces).rstrip())
    return out


def _number(value: str | None, default: int, most: int = 1000) -> int:
    return min(most, int(value)) if value and re.fullmatch(r"\s*\+?\d{1,9}\s*", value) else default


def render(root: Node, selectors: frozenset[str] = frozenset()) -> str:
    """Visible text of a tree."""
    flows = [_Flow()]
    tables: list[list[list]] = []  # rows of the open tables
    lists: list[list] = []  # [tag, next number] of the open lists
    kept = 0  # depth of elements that keep white space
    foreign = 0  # depth of drawings and formulas
    todo: list[tuple] = [("in", root)]
    while todo:
        what, node = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if kept:
                flow.kept_text(node)
            else:
                flow.text(node)
            continue
        tag = node.tag
        if what == "in":
            if _hidden(node, selectors) or (foreign and (tag in NEVER_FOREIGN or node.attrs.get("display") == "none" or node.attrs.get("visibility") == "hidden")):
                continue
            if tag == "br":
                flow.line_break()
                continue
            if tag == "hr":
                flow.block(1)
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and node.attrs.get("value"):
                    flow.text(node.attrs["value"])
                continue
            if tag == "wbr" or tag in VOID:
                continue
            if tag in LISTS:
                flow.block(0 if lists else 1)
                lists.append([tag, _number(node.attrs.get("start"), 1)])
            elif tag == "table":
                flow.block(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                flows.append(_Flow())
            elif tag in BLOCKS or tag == "caption":
                flow.block(1 if tag in SPACED and not (tag == "p" and lists and not flow.now and flow.marker) else 0)
                if tag == "li":
                    if lists and lists[-1][0] == "ol":
                        lists[-1][1] = _number(node.attrs.get("value"), lists[-1][1], 10**9)
                        marker = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    else:
                        marker = "- "
                    flow.indents.append(" " * len(marker))
                    flow.marker = marker
                elif tag in ("dd", "blockquote"):
                    flow.indents.append("  ")
            if tag in ("pre", "textarea", "xmp"):
                kept += 1
            if tag in FOREIGN:
                foreign += 1
            elif foreign and tag == "text":
                flow.block(0)
            todo.append(("out", node))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            elif tag == "table":
                children = [c for c in children if isinstance(c, Node)]
            elif tag in ("tr", "tbody", "thead", "tfoot") and tables:
                children = [c for c in children if isinstance(c, Node) or not c.isspace()]
            todo += [("in", c) for c in reversed(children)]
            continue
        if tag in ("pre", "textarea", "xmp"):
            kept -= 1
        if tag in FOREIGN:
            foreign -= 1
        elif foreign and tag == "text":
            flow.block(0)
        if tag in LISTS:
            lists.pop()
            flow.block(0 if lists else 1)
        elif tag in ("td", "th") and tables:
            lines = flows.pop().done()
            if not tables[-1]:
                tables[-1].append([])
            right = node.attrs.get("align", "").lower() == "right"
            tables[-1][-1].append((lines, max(1, _number(node.attrs.get("colspan"), 1)), max(1, _number(node.attrs.get("rowspan"), 1)), right))
        elif tag == "table":
            flow.end_line()
            flow.add_lines(lay_out(tables.pop()))
            flow.block(1)
        elif tag in BLOCKS or tag == "caption":
            if tag in ("li", "dd", "blockquote") and flow.indents:
                flow.end_line()
                if tag == "li":
                    flow.marker = ""
                flow.indents.pop()
            flow.block(1 if tag in SPACED else 0)
    return "\n".join(line.rstrip() for line in flows[0].done()).strip("\n")


def visible_text(page: str | None) -> str | None:
    """Visible text of a page with its layout; null for null."""
    if page is None:
        return None
    root, sheets = build(page)
    return render(root, hiding_selectors(sheets) if sheets else frozenset())


def extract(pages: DataFrame, payload: str = "html", keep: tuple[str | Column, ...] = ("page_id",), into: str = "text") -> DataFrame:
    """``keep`` plus the visible text of every page."""
    rows = pages.select(*keep, pages[f"`{payload}`"].cast("string").alias("html__"))
    names = rows.columns[:-1]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + [f"`{into}` string"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame[into] = pd.Series([visible_text(x) for x in frame.pop("html__")], index=frame.index, dtype=object)
            yield frame

    return rows.mapInPandas(run, schema)
