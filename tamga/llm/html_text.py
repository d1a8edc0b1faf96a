"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder with implied end tags (p, li, td, dt, option and others), void elements and raw text.
Visibility rules take out what a browser doesn't paint: elements that aren't displayed go whole; the text of invisible ones
goes, but not that of descendants that are visible again. The renderer walks what is left and emits all its text: blocks on
lines of their own with a blank line between paragraphs, list items with markers and indent, table cells padded to columns,
preformatted text as it stands. What assistive technology skips (aria-hidden) is painted, so it is text.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded_batches, free_name

# Element names by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = frozenset("head script style template noscript iframe object embed canvas audio video datalist title meta link noembed noframes rp progress meter".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("article blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre section table ul menu form header footer nav main aside address".split())
#: A start tag ends the open element named here, if it is open above any of the barriers.
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()) | {"hr"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
#: Text under these isn't shown before a body begins; anything else begins it.
HEAD_ONLY = frozenset("html head meta title link base script style template noscript".split())
#: An end tag doesn't reach past these.
SCOPE = frozenset("table td th caption html".split())
#: These end tags close whatever is open inside their table.
PARTS = frozenset("table caption colgroup tbody thead tfoot tr td th".split())
#: A start tag of these closes what is open inside its table, up to one of the elements named.
CONTEXT = {k: frozenset(v.split()) for k, v in {"td": "tr tbody thead tfoot table", "th": "tr tbody thead tfoot table", "tr": "tbody thead tfoot table", "tbody": "table", "thead": "table", "tfoot": "table"}.items()}
#: Drawings and formulas: HTML elements that end them, elements with HTML inside, and elements that paint no text.
LEAVES_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
HTML_INSIDE = frozenset("mi mo mn ms mtext".split())
UNPAINTED = {"svg": frozenset("clippath defs desc filter lineargradient marker mask metadata pattern radialgradient symbol".split()), "math": frozenset("annotation annotation-xml mphantom".split())}
UNPAINTED["svg text"] = UNPAINTED["svg"]
#: Inputs that are painted as buttons with their value.
BUTTONS = frozenset("submit reset button".split())
# The largest spans of a cell.
SPANS = {"colspan": 1000, "rowspan": 65534}

_TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>][^\s\"'>]*$")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attrs", "children", "kind")

    def __init__(self, name: str, attrs: dict[str, str], kind: str = ""):
        self.name, self.attrs, self.children, self.kind = name, attrs, [], kind


def _kind(name: str, parent: Node) -> str:
    """math, svg, svg text where a drawing paints its text, or empty for HTML."""
    if name in ("svg", "math"):
        return name
    if name == "foreignobject" or parent.kind == "math" and parent.name in HTML_INSIDE:
        return ""
    return "svg text" if parent.kind == "svg" and name == "text" else parent.kind


def attributes(said: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(said):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


class _Open:
    """The open elements, and where in them each name stands: an end tag finds its element however deep the page is nested."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {root.name: [0]}

    def push(self, node: Node):
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int):
        """Close all from place k on."""
        for node in self.stack[k:]:
            self.at[node.name].pop()
        del self.stack[k:]

    def last(self, names) -> int:
        """The innermost open element of these names, the root aside; 0 if there is none."""
        return max((x[-1] for n in names if (x := self.at.get(n))), default=0)

    def has(self, name: str) -> bool:
        return bool(self.at.get(name))


def tree(text: str) -> Node:
    """The elements of a page; text is str, elements are Node."""
    root = Node("html", {})
    open_ = _Open(root)
    stack = open_.stack
    at, size = 0, len(text)

    def add_text(said: str):
        if said:
            if stack[-1].name == "head" and said.strip():
                open_.cut(len(stack) - 1)
            stack[-1].children.append(html.unescape(said))

    def pop_to(names, barriers) -> bool:
        k = open_.last(names)
        if not k or k < open_.last(barriers - names):
            return False
        open_.cut(k)
        return True

    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            add_text(text[at:])
            break
        add_text(text[at : m.start()])
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name == "br":
                stack[-1].children.append(Node("br", {}))
            elif name == "p" and not open_.has("p"):
                stack[-1].children.append(Node("p", {}))
            elif name not in ("html", "body"):  # what follows these still belongs to the page
                pop_to({name}, {"table"} - {name} if name in PARTS else SCOPE - {name})
            continue
        if not m[2]:
            continue
        name = m[2].lower()
        attrs = attributes(m[3]) if m[3] else {}
        if name == "html" or name == "body" and open_.has("body"):
            for k in open_.at[name]:
                stack[k].attrs = attrs | stack[k].attrs
            continue
        if stack[-1].name == "head" and name not in HEAD_ONLY:
            open_.cut(len(stack) - 1)
        if name in LEAVES_FOREIGN:
            while stack[-1].kind and stack[-1].name not in HTML_INSIDE:
                open_.cut(len(stack) - 1)
        if name == "form" and stack[-1].name in ("table", "tbody", "thead", "tfoot", "tr"):
            continue  # it holds nothing there, and what follows stays in the table
        if name in ENDS_P:
            pop_to({"p"}, SCOPE | {"button"})
        if name in IMPLIED:
            names, barriers = IMPLIED[name]
            while pop_to(names, barriers):
                pass
        if name in CONTEXT and (k := open_.last(CONTEXT[name])):
            open_.cut(k + 1)
        if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            open_.push(row)
        node = Node(name, attrs, _kind(name, stack[-1]))
        stack[-1].children.append(node)
        if node.kind and m[3].endswith("/") and not _UNQUOTED.search(m[3]):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(text, at) if name != "plaintext" else None
            inner = text[at : end.start()] if end else text[at:]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = end.end() if end else size
        elif name not in VOID:
            open_.push(node)
    return root


def displayed(node: Node, style: dict[str, str]) -> bool:
    a = node.attrs
    if node.name in HIDDEN or "hidden" in a and a["hidden"] != "until-found" or node.name == "dialog" and "open" not in a:
        return False
    if node.kind and node.name in UNPAINTED[node.kind]:
        return False
    return style.get("display") != "none"


def painted(root: Node) -> Node:
    """root without what isn't painted, in place."""
    open_ = [(root, True)]
    while open_:
        node, seen = open_.pop()
        left = []
        for child in node.children:
            if isinstance(child, str):
                if seen:
                    left.append(child)
                continue
            style = {k.lower(): v.lower() for k, v in _STYLE.findall(child.attrs["style"])} if "style" in child.attrs else {}
            if not displayed(child, style):
                continue
            own = seen if style.get("visibility", "inherit") not in ("visible", "hidden", "collapse") else style["visibility"] == "visible"
            if own or child.name not in ("img", "hr", "input"):
                left.append(child)
                open_.append((child, own))
        if node.name == "details" and "open" not in node.attrs:
            left = [x for x in left if isinstance(x, Node) and x.name == "summary"][:1]
        node.children = left
    return root


def width(text: str) -> int:
    """Columns of a text in a fixed-width face: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class _Lines:
    """Lines under construction. gap: blank lines wanted before the next text."""

    def __init__(self):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space, self.gap = False, 0

    def text(self, said: str):
        parts = _SPACE.split(said)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        words = [w for w in parts if w]
        if not words:
            return
        self._begin()
        if self.space and self.current:
            self.current.append(" ")
        self.current.append(" ".join(words))
        self.space = parts[-1] == ""

    def raw(self, line: str):
        self._begin()
        self.current.append(line)

    def _begin(self):
        if not self.current and self.gap:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0

    def end(self):
        if self.current:
            self.lines.append("".join(self.current))
        self.current, self.space = [], False

    def newline(self):
        self._begin()
        self.lines.append("".join(self.current))
        self.current, self.space = [], False

    def block(self, lines: list[str], gap: int, first: str = "", rest: str = ""):
        """Finished lines as a block, the first one with a marker."""
        self.end()
        if not lines:
            return
        self.gap = max(self.gap, gap)
        self._begin()
        for k, line in enumerate(lines):
            self.lines.append(((first if k == 0 else rest) + line).rstrip() if line or k == 0 else "")


def _done(step):
    """What a step returns. Steps yield the steps that they need done first, so nesting takes no frames of Python's stack."""
    open_, got = [step], None
    while open_:
        try:
            step = open_[-1].send(got)
        except StopIteration as e:
            open_.pop()
            got = e.value
        else:
            open_.append(step)
            got = None
    return got


def render(node: Node):
    """A step: the lines of an element."""
    out = _Lines()
    yield _inside(node, out)
    out.end()
    return out.lines


def _inside(node: Node, out: _Lines):
    """A step: an element's children into out."""
    number = 1
    if node.name == "ol":
        start = node.attrs.get("start", "1").strip()
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if node.kind != "svg":
                out.text(child)
            continue
        name = child.name
        if child.kind == "svg text" and (name == "text" or not {"x", "y", "dy"}.isdisjoint(child.attrs)):  # placed on its own
            out.space = True
            yield _inside(child, out)
            out.space = True
            continue
        if name == "br":
            out.newline()
        elif name == "hr":
            out.block(["---"], 1)
            out.gap = 1
        elif name == "img":
            out.text(child.attrs.get("alt", ""))
        elif name == "input":
            out.text(_label(child))
        elif name in ("pre", "textarea", "listing", "xmp"):
            lines = (yield _plain(child)).replace("\r\n", "\n").replace("\r", "\n").removeprefix("\n").rstrip("\n").split("\n")
            out.block(lines if any(lines) else [], 1)
            out.gap = 1
        elif name == "table":
            out.block((yield _table(child)), 1)
            out.gap = 1
        elif name == "li" and node.name in ("ul", "menu", "dir"):
            out.block((yield render(child)), 0, "- ", "  ")
        elif name == "li" and node.name == "ol":
            value = child.attrs.get("value", "").strip()
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            mark = f"{number}. "
            out.block((yield render(child)), 0, mark, " " * len(mark))
            number += 1
        elif name == "dd":
            out.block((yield render(child)), 0, "    ", "    ")
        elif name == "blockquote":
            out.block((yield render(child)), 1, "> ", "> ")
            out.gap = 1
        elif name in BLOCK:
            nested = name in ("ul", "ol") and node.name == "li"
            gap = 1 if name in SPACED and not nested else 0
            out.end()
            out.gap = max(out.gap, gap)
            yield _inside(child, out)
            out.end()
            out.gap = max(out.gap, gap)
        elif name == "q":
            out.text('"')
            yield _inside(child, out)
            out.text('"')
        else:
            yield _inside(child, out)


def _label(node: Node) -> str:
    """What is painted of an input: a button's value."""
    return node.attrs.get("value", "") if node.attrs.get("type", "").strip().lower() in BUTTONS else ""


def _plain(node: Node):
    """A step: text as it stands."""
    parts = []
    for child in node.children:
        if isinstance(child, str):
            parts.append(child)
        elif child.name == "br":
            parts.append("\n")
        elif child.name == "input":
            parts.append(_label(child))
        else:
            parts.append((yield _plain(child)))
    return "".join(parts)


def _rows(node: Node) -> tuple[list[Node], list[list[Node]]]:
    """Captions and other content, and rows of cells; head rows first, foot rows last."""
    other, head, body, foot = [], [], [], []
    for child in node.children:
        if isinstance(child, str):
            if child.strip():
                other.append(child)
        elif child.name == "tr":
            body.append(child)
        elif child.name in ("thead", "tbody", "tfoot"):
            other += [x for x in child.children if (x.strip() if isinstance(x, str) else x.name != "tr")]
            {"thead": head, "tbody": body, "tfoot": foot}[child.name].extend(x for x in child.children if isinstance(x, Node) and x.name == "tr")
        else:
            other.append(child)
    return other, [*head, *body, *foot]


def _span(cell: Node, name: str) -> int:
    """Columns or rows that a cell covers; a rowspan of 0 covers all rows that are left."""
    said = re.match(r"\s*\+?(\d+)", cell.attrs.get(name, "1"), re.A)
    if not said:
        return 1
    n = min(int(said[1][:9]), SPANS[name])
    return n or (SPANS[name] if name == "rowspan" else 1)


def _table(node: Node):
    """A step: the lines of a table."""
    other, rows = _rows(node)
    out = _Lines()
    for x in other:
        holder = Node("div", {})
        holder.children = [x]
        out.block((yield render(holder)), 0)
    grid: list[dict[int, list[str]]] = []
    spans: list[dict[int, int]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    for row in rows:
        cells, wide, column = {}, {}, 0
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip():
                    continue
                box = Node("td", {})
                box.children = [cell]
                cell = box
            said = yield render(cell)
            if cell.name not in ("td", "th") and not any(said):
                continue
            while taken.get(column, 0):
                column += 1
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            cells[column], wide[column] = said, across
            for c in range(column, column + across):
                if down > 1:
                    taken[c] = down
            column += across
        taken = {c: left - 1 for c, left in taken.items() if left > 1}
        if cells:
            grid.append(cells)
            spans.append(wide)
    widths: dict[int, int] = {}
    for cells, wide in zip(grid, spans):
        for c, lines in cells.items():
            if wide[c] == 1:
                widths[c] = max(widths.get(c, 0), *(width(x) for x in lines), 0) if lines else widths.get(c, 0)
    columns = max((c + w for wide in spans for c, w in wide.items()), default=0)
    starts, at = [], 0
    for c in range(columns + 1):
        starts.append(at)
        at += widths.get(c, 0) + (2 if c in widths else 0)
    lines = []
    for cells in grid:
        for k in range(max((len(x) for x in cells.values()), default=0)):
            line, end = "", 0
            for c in sorted(cells):
                said = cells[c][k] if k < len(cells[c]) else ""
                if not said:
                    continue
                pad = max(starts[c] - end, 2 if line else 0)
                line += " " * pad + said
                end += pad + width(said)
            lines.append(line.rstrip())
    out.block(lines, 0)
    out.end()
    return out.lines


def page_text(page: str) -> str:
    """Visible text of one page."""
    lines = _done(render(painted(tree(page.replace("\x00", "")))))
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return "\n".join(x.replace("\xa0", " ").rstrip() for x in lines)


def page_title(page: str) -> str | None:
    m = re.search(r"<title\b[^>]*>(.*?)</title", page, re.I | re.S)
    return _SPACE.sub(" ", html.unescape(m[1])).strip() if m else None


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with `text` and `title`. A null page has null text; an empty one, or one where all is hidden, empty text.

    Other columns and repeated rows stay; columns named text or title are replaced. Nesting of any depth and pages of any
    length are read whole; an empty table gives an empty result.
    """

    def run(column: pa.Array) -> pa.Array:
        texts, titles = [], []
        for x in column:
            page = x.as_py()
            texts.append(None if page is None else page_text(page))
            titles.append(None if page is None else page_title(page))
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(titles, pa.string())], ["text", "title"])

    bounded_batches(pages.sparkSession)
    name = free_name(pages, "read")
    got = pages.withColumn(name, F.arrow_udf(run, "text string, title string")(F.col(html_col)))
    return got.withColumn("text", F.col(name)["text"]).withColumn("title", F.col(name)["title"]).drop(name)


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return extract(pages).select("page_id", "title", "text", F.length("text").cast("bigint").alias("n_chars"))
