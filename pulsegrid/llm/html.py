"""Operator 5: layout-aware rendering of HTML to text.

A tree builder with implied start and end tags makes a tree of a page's
elements; visibility rules drop what a reader doesn't see; a layout pass emits
all other text. Elements hide by kind, by ``hidden``, by style attributes and by
the page's style sheets (selectors of tags, classes, ids and attributes with
descendants and children, and the cascade of ``display`` and ``visibility``;
other selectors and rules for print alone are skipped); closed ``details`` show
their summary. Texts of formulas, drawings' labels, text areas, buttons, typed
values and chosen or listed options are visible. Blocks are set apart by line breaks, paragraphs, headings,
lists and tables by blank lines; list items get bullets or numbers and are
indented by depth; cells of a table are aligned in columns, whose widths spanning
cells share, and tables may lie in cells to any depth; preformatted text keeps
its white space.

Defined results: a null page gives a null text with 0 blocks, an empty one an
empty text; broken markup is read to its end; unclosed elements end with their
parents; pages are rendered one by one, repeated ids and copies included;
extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, read_table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist desc metadata defs symbol annotation annotation-xml rp".split())
#: Inputs whose value or placeholder is shown, and those that are buttons.
TYPED, BUTTONS = frozenset("text search tel url email number date month week time datetime-local".split()), frozenset("submit button reset".split())
#: Blocks without a blank line around them.
BLOCK = frozenset("html body div section article aside header footer nav main address figure figcaption form fieldset legend details summary li dt dd tr caption center hgroup search thead tbody tfoot textarea".split())
#: Blocks with a blank line around them.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre hr menu".split())
CELLS = frozenset({"td", "th"})
#: A start tag ends these open elements, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements whose start ends an open paragraph.
ENDS_P = (BLOCK | APART) - {"html", "body", "li", "dt", "dd", "tr", "caption", "thead", "tbody", "tfoot", "legend", "textarea"}
#: An end tag doesn't reach past these.
SCOPE = frozenset({"table", "td", "th", "caption", "html"})
NEEDS_HEAD = frozenset("title meta link base style script".split())
COMMENT_END, COMMENT_CLOSE = re.compile("-?>"), re.compile("--!?>")
SPACES = " \t\n\r\f"
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)
    #: What the page's style sheets say of it: display is none, visibility (None where they say nothing).
    gone: bool | None = None
    seen: bool | None = None
    #: A table's lines, once it is laid out.
    lines: list[str] | None = None


class TreeBuilder(HTMLParser):
    """Builds a tree and supplies the tags that authors may leave out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()

    def push(self, tag: str, attrs: dict | None = None) -> Node:
        node = Node(tag, attrs or {})
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[tag] += 1
        return node

    def cut(self, i: int) -> None:
        """End the open element at ``i`` and those in it."""
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def close_until(self, tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        """End the outermost open element of ``tags`` above the nearest one of ``barrier``."""
        if not any(self.count[t] for t in tags):
            return
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in barrier:
                break
            if self.open[i].tag in tags:
                last = i
        if last is not None:
            self.cut(last)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = dict(attrs)
        if tag == "html":
            self.root.attrs |= values
            return
        if tag in ENDS_P:
            self.close_until({"p"}, SCOPE | {"button"})
        if tag in ENDS:
            self.close_until(*ENDS[tag])
        if tag in {"h1", "h2", "h3", "h4", "h5", "h6"} and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.cut(len(self.open) - 1)
        here = self.open[-1].tag
        if tag in CELLS and here != "tr":
            if here not in {"table", "thead", "tbody", "tfoot"} and not self.count["table"]:
                self.push("table")
            self.push("tr")
        elif tag == "tr" and here not in {"table", "thead", "tbody", "tfoot"} and not self.count["table"]:
            self.push("table")
        elif tag == "li" and not (self.count["ul"] + self.count["ol"] + self.count["menu"]):
            self.push("ul")
        if here == "head" and tag not in NEEDS_HEAD | {"noscript", "template"}:
            self.close_until({"head"}, set())
        self.push(tag, values)
        if tag in VOID:
            self.cut(len(self.open) - 1)

    def parse_comment(self, i: int, report: bool = True) -> int:
        """The end of a comment; one that is not closed runs to the page's end, which is all there."""
        m = COMMENT_END.match(self.rawdata, i + 4) or COMMENT_CLOSE.search(self.rawdata, i + 4)
        return m.end() if m else len(self.rawdata)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # outside foreign content, the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        barrier = SCOPE - {tag} if tag not in {"table", "tr", "thead", "tbody", "tfoot", "body"} else frozenset({"html"} if tag == "table" else {"html", "table"} - {tag})
        for i in range(len(self.open) - 1, 0, -1) if self.count[tag] else ():
            if self.open[i].tag == tag:
                self.cut(i)
                return
            if self.open[i].tag in barrier:
                break
        if tag == "p":
            self.push("p")
            self.cut(len(self.open) - 1)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.close_until({"head"}, set())
        self.open[-1].children.append(data)


RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SIMPLE = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)", re.I)
PART = re.compile(r"[.#]([\w-]+)|\[([\w-]+)(?:=[\"']?([^\]\"']*)[\"']?)?\]")


def declared(text: str) -> list[tuple[str, bool, bool]]:
    """(property, hides, important) of the declarations of display and visibility, in order."""
    out = []
    for part in text.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        important = value.endswith("!important")
        value = value.removesuffix("!important").strip()
        if name in ("display", "visibility") and value:
            out.append((name, value == "none" if name == "display" else value in ("hidden", "collapse"), important))
    return out


class Styles:
    """The style sheets' rules on display and visibility."""

    def __init__(self, sheets: list[str]):
        self.rules: list[tuple[list, tuple[int, int, int], int, list]] = []
        for sheet in sheets:
            sheet = re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)
            # blocks for print or for features are skipped, those for all or screens are opened
            sheet = re.sub(r"@media\s+(?:only\s+)?(?:screen|all)\s*\{((?:[^{}]*\{[^{}]*\})*)\s*\}", r"\1", sheet, flags=re.I)
            sheet = re.sub(r"@[\w-]+[^{;]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})", "", sheet)
            for selectors, body in RULE.findall(sheet):
                says = declared(body)
                for s in selectors.split(",") if says else ():
                    chain = self.parse(s.strip())
                    if chain:
                        rank = tuple(sum(x[k] for _, x in chain) for k in range(3))
                        self.rules.append((chain, rank, len(self.rules), says))

    @staticmethod
    def parse(selector: str) -> list | None:
        """[(is a child, simple selector)] from right to left, or None for what isn't understood."""
        chain, child = [], False
        for word in selector.replace(">", " > ").split():
            if word == ">":
                child = True
                continue
            m = SIMPLE.fullmatch(word)
            if m is None:
                return None
            marks = [("id" if p[0][:1] == "#" else "class" if p[0][:1] == "." else "attr", *p[1:]) for p in ((x[0], *x.groups()) for x in PART.finditer(m[2]))]
            tag = None if m[1] in (None, "*") else m[1].lower()
            chain.append((child, (sum(k[0] == "id" for k in marks), sum(k[0] != "id" for k in marks), int(tag is not None), tag, marks)))
            child = False
        return chain[::-1]

    @staticmethod
    def fits(node: Node, simple: tuple) -> bool:
        _, _, _, tag, marks = simple
        if tag and node.tag != tag:
            return False
        for kind, name, attr, value in marks:
            if kind == "id" and node.attrs.get("id") != name:
                return False
            if kind == "class" and name not in (node.attrs.get("class") or "").split():
                return False
            if kind == "attr" and (attr.lower() not in node.attrs or value is not None and (node.attrs[attr.lower()] or "") != value):
                return False
        return True

    def matches(self, path: list[Node], chain: list) -> bool:
        """Whether the last node of ``path`` fits; descendants go to the nearest fitting one, tried outwards."""
        if not self.fits(path[-1], chain[0][1]):
            return False
        todo = [(len(path) - 2, 1)]
        tried = set()
        while todo:
            at, k = todo.pop()
            if k == len(chain):
                return True
            if at < 0 or (at, k) in tried:
                continue
            tried.add((at, k))
            if self.fits(path[at], chain[k][1]):
                todo.append((at - 1, k + 1))
            if not chain[k - 1][0]:
                todo.append((at - 1, k))
        return False

    def apply(self, root: Node) -> None:
        path: list[Node] = []
        stack: list = [(root, False)]
        while stack:
            node, leave = stack.pop()
            if leave:
                path.pop()
                continue
            path.append(node)
            stack.append((node, True))
            says = [((important, 0, rank, order), name, hides) for chain, rank, order, body in self.rules if self.matches(path, chain) for name, hides, important in body]
            says += [((important, 1, (), k), name, hides) for k, (name, hides, important) in enumerate(declared(node.attrs.get("style") or ""))]
            for _, name, hides in sorted(says, key=lambda x: x[0]):
                if name == "display":
                    node.gone = hides
                else:
                    node.seen = not hides
            stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def style(root: Node) -> None:
    """Marks what style sheets and style attributes hide."""
    sheets, styled, stack = [], False, [root]
    while stack:
        node = stack.pop()
        if node.tag == "style" and (node.attrs.get("media") or "all").lower() in ("all", "screen"):
            sheets.append("".join(c for c in node.children if isinstance(c, str)))
        styled |= bool(node.attrs.get("style"))
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    if sheets or styled:
        Styles(sheets).apply(root)


def rendered(node: Node) -> bool:
    """Whether an element makes boxes at all."""
    if node.gone is not None and node.tag not in HIDDEN:
        return not node.gone
    return not (node.tag in HIDDEN or "hidden" in node.attrs)


def shown(node: Node) -> list:
    """The children that an element shows, or text in their place."""
    a = node.attrs
    if node.tag == "input":
        kind = (a.get("type") or "text").lower()
        if kind in BUTTONS:
            return [a.get("value") or ""]
        return [a.get("value") or a.get("placeholder") or ""] if kind in TYPED else [a.get("alt") or ""] if kind == "image" else []
    if node.tag == "details" and "open" not in a:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    if node.tag == "select":
        options = [o for c in node.children if isinstance(c, Node) for o in ([c] if c.tag == "option" else [o for o in c.children if isinstance(o, Node) and o.tag == "option"])]
        listed = "multiple" in a or (a.get("size") or "1").strip() not in ("", "0", "1")
        if not listed:
            options = [o for o in options if "selected" in o.attrs][-1:] or options[:1]
        return [x for o in options for x in (" ", o, " ")]
    if node.tag == "svg":  # text that no text element holds is not drawn
        found, stack = [], list(reversed(node.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node) and rendered(c):
                if c.tag in ("text", "foreignobject"):
                    found += [" ", c, " "]
                else:
                    stack.extend(reversed(c.children))
        return found
    return node.children


class Layout:
    """Collects lines; keeps pending blank lines and spaces until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now = ""
        self.space = False
        self.blank = False
        self.mark = ""
        self.indent = ""
        self.blocks = 0

    def end_line(self, blank: bool = False) -> None:
        if self.now:
            self.lines.append(self.now.rstrip(" "))
            self.now = ""
            self.blocks += 1
        self.space = False
        self.blank |= blank

    def begin_line(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.now = self.indent[: -len(self.mark)] + self.mark if self.mark else self.indent
        self.mark = ""

    def text(self, data: str) -> None:
        words = " ".join(filter(None, WHITE.split(data)))
        self.space |= data[:1] in SPACES
        if words:
            if not self.now:
                self.begin_line()
            elif self.space and not self.now.endswith(" "):
                self.now += " "
            self.now += words
            self.space = data[-1] in SPACES

    def pre(self, data: str) -> None:
        for i, line in enumerate(data.split("\n")):
            if i:
                if not self.now:
                    self.begin_line()
                self.lines.append(self.now.rstrip(" "))
                self.now = ""
            if line:
                if not self.now:
                    self.begin_line()
                self.now += line


def render(root: Node) -> tuple[str, int]:
    """The visible text and its number of lines with text. Deep trees are walked without recursion."""
    style(root)
    # inner tables are laid out before those whose cells hold them
    tables, stack = [], [(root, True)]
    while stack:
        node, seen = stack.pop()
        if not rendered(node):
            continue
        seen = seen if node.seen is None else node.seen
        if node.tag == "table":
            tables.append((node, seen))
        stack.extend((c, seen) for c in shown(node) if isinstance(c, Node))
    for table, seen in reversed(tables):
        table.lines = table_lines(table, seen)
    out = Layout()
    walk(root, out)
    out.end_line()
    return "\n".join(out.lines), out.blocks


def walk(root: Node, out: Layout, seen: bool = True) -> None:
    stack: list = [(root, None)]
    pre, lit = 0, [seen]
    while stack:
        item, leave = stack.pop()
        if leave is not None:
            if leave == "lit":
                lit.pop()
                continue
            if leave[0] in {"pre", "textarea"}:
                pre -= 1
            out.end_line(leave[1])
            if leave[2] is not None:
                out.indent, out.mark = leave[2], ""
            continue
        if isinstance(item, str):
            if lit[-1]:
                (out.pre if pre else out.text)(item)
            continue
        tag = item.tag
        if not rendered(item):
            continue
        if item.seen is not None:
            lit.append(item.seen)
            stack.append((None, "lit"))
        if tag == "br":
            if out.now:
                out.end_line()
            else:
                out.blank = True
            continue
        if tag == "img":
            if lit[-1]:
                out.text(item.attrs.get("alt") or "")
            continue
        if tag == "table":
            out.end_line(True)
            for line in item.lines or ():
                out.begin_line()
                out.now += line
                out.end_line()
            out.blank = True
            continue
        indent = None
        if tag in APART or tag in BLOCK or tag in CELLS:
            out.end_line(tag in APART and not (tag in {"ul", "ol", "menu"} and out.indent))
            if tag == "li":
                indent, out.mark = out.indent, item.attrs.get("\0mark") or "- "
                out.indent += " " * len(out.mark)
            elif tag in {"blockquote", "dd"}:
                indent = out.indent
                out.indent += "  "
            elif tag in {"ul", "ol", "menu"}:
                number_items(item)
            elif tag in {"pre", "textarea"}:
                pre += 1
                if item.children and isinstance(item.children[0], str):
                    item.children[0] = item.children[0].removeprefix("\n")
            stack.append((None, (tag, tag in APART and not (tag in {"ul", "ol", "menu"} and out.indent), indent)))
        elif tag == "q":
            item.children = ['"', *item.children, '"']
        stack.extend((c, None) for c in reversed(shown(item)))


def number_items(node: Node) -> None:
    """Bullets or numbers of a list's items; ``start``, ``value`` and ``reversed`` hold."""

    def number(text: str | None, default: int) -> int:
        return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else default

    items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
    step = -1 if "reversed" in node.attrs else 1
    at = number(node.attrs.get("start"), len(items) if step < 0 else 1)
    for item in items:
        at = number(item.attrs.get("value"), at)
        item.attrs["\0mark"] = f"{at}. " if node.tag == "ol" else "- "
        at += step


def table_lines(table: Node, seen: bool) -> list[str]:
    """A caption, then rows whose cells are padded to their columns' widths.

    Only columns that a cell starts in take room; a cell over several of them widens the last where it needs more.
    """
    before: list[str] = []
    rows: list[list[tuple[list[str], int, int]]] = []
    pending = list(reversed(table.children))
    while pending:
        c = pending.pop()
        if isinstance(c, str):
            if c.strip():
                before += cell_lines(Node("div", {}, [c]), seen)
        elif not rendered(c):
            continue
        elif c.tag in {"thead", "tbody", "tfoot"}:
            pending.extend(reversed(c.children))
        elif c.tag == "tr":
            lit = seen if c.seen is None else c.seen
            rows.append([(cell_lines(x, lit), span(x, "colspan", 1000), span(x, "rowspan", 65534)) for x in c.children if isinstance(x, Node) and x.tag in CELLS and rendered(x)])
            stray = [x for x in c.children if not (isinstance(x, Node) and x.tag in CELLS)]
            before += cell_lines(Node("div", {}, stray), lit) if any(not isinstance(x, str) or x.strip() for x in stray) else []
        elif c.tag not in {"col", "colgroup"}:
            before += cell_lines(c, seen)
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}
    for row in rows:
        at, cells, later = 0, {}, {}
        for lines, columns, down in row:
            while held.get(at, 0):
                at += 1
            cells[at] = (lines, columns)
            if down > 1:
                later.update(dict.fromkeys(range(at, at + columns), down))
            at += columns
        held = {k: v - 1 for k, v in held.items() if v > 1} | {k: v - 1 for k, v in later.items()}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for k, (lines, columns) in cells.items():
            width[k] = max(width.get(k, 0), *(len(x) for x in lines), 0) if columns == 1 else width.get(k, 0)
    used = sorted(width)
    for cells in grid:
        for k, (lines, columns) in cells.items():
            if columns > 1:
                over = used[bisect_left(used, k) : bisect_left(used, k + columns)]
                lack = max(map(len, lines)) - sum(width[j] for j in over) - 3 * (len(over) - 1)
                width[over[-1]] += max(0, lack)
    starts, at = {}, 0
    for k in used:
        starts[k] = at
        at += width[k] + 3
    out = before
    for cells in grid:
        for i in range(max((len(x) for x, _ in cells.values()), default=0)):
            line = ""
            for k, (lines, _) in sorted(cells.items()):
                if i < len(lines) and lines[i]:
                    line = line.ljust(starts[k] - 3) + " | " if starts[k] else line
                    line += lines[i]
            out.append(line.rstrip(" "))
    return [x for x in out if x]


def span(cell: Node, name: str, most: int) -> int:
    """A span, up to the most that the language allows."""
    value = cell.attrs.get(name) or "1"
    return max(1, min(most, int(value[:9]))) if value.isdigit() and value.isascii() else 1


def cell_lines(cell: Node, seen: bool) -> list[str]:
    out = Layout()
    walk(Node("div", {}, cell.children), out, seen if cell.seen is None else cell.seen)
    out.end_line()
    return [x for x in out.lines if x] or [""]


def html_text(page: str) -> tuple[str, int]:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return render(builder.root)


def render_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_blocks) of every whole page."""

    def rows(ids, pages):
        for i, page in zip(ids, pages):
            yield (i, None, 0) if page is None else (i, *html_text(page))

    return arrow_map(pages.select("page_id", "html"), rows, "page_id long, text string, n_blocks long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    return render_pages(read_table(spark, sf_dir, "pages"))
