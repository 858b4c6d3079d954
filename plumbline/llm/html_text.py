"""Layout-aware rendering of HTML to text [operator 9].

A tree builder with implied tags makes each page's tree; visibility rules drop
what a reader does not see; the renderer lays out the rest as lines: blank lines
around paragraphs, marks and indents for lists, aligned columns for tables.

Visible is all text but: head, script, style, template, embedded objects and
their fallback, comments; elements with the hidden attribute, an inline style or
a simple rule (tag, .class, #id) of the page's style sheets that says
display:none or visibility:hidden, for all media or screens, and that no later
rule of the same selector undoes (what is visibility:visible inside a hidden element
is shown); closed details but for their summary; closed
dialogs. noscript is shown, since no script runs.

Defined results: null and empty pages give the empty text. Malformed pages are
rendered as far as they go: unclosed tags end with their parents, end tags that
match nothing are ignored, and nesting beyond MAX_DEPTH is laid out at that
depth, as browsers do. Repeated rows are rendered each. Other columns of the
input do not matter; the result has the id and its own columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Generator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As deep as browsers nest elements; indents of deeper lists would grow with the square of a page.
MAX_DEPTH = 512

# -- fixed values: element names of HTML ------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template iframe noembed noframes object svg audio video canvas datalist annotation annotation-xml".split())
#: Blocks with a blank line around them, and those that only begin a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
LINED = frozenset("html body div article section main nav header footer aside address form li dt dd tr caption legend figcaption details summary center dialog option optgroup select search hgroup".split())
BLOCK = SPACED | LINED
TABLE_PARTS = frozenset("thead tbody tfoot tr td th caption colgroup".split())
#: A start tag closes the open elements in the first set, unless one of the second stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: An unclosed p goes no further out than these.
P_SCOPE = frozenset("table td th caption button object template html".split())
# -- end of fixed values -----------------------------------------------------------

# comments and declarations, whole; and the beginnings of tags
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|\Z)", re.S)
# in a tag: its end, or the beginning of a quoted value
_IN_TAG = re.compile(r">|=\s*+([\"'])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"[ \t\r\n\f]+")
_GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)([^;]*)", re.I)
_MEDIA = re.compile(r"\s*(?:(?:only\s+)?(?:all|screen))?\s*\Z", re.I)
_SIMPLE = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?\Z", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


class TreeBuilder:
    """Builds the tree of one page; `said` gathers what its style sheets say of selectors."""

    def __init__(self, page: str):
        self.root = Node("#root")
        self.open = [self.root]
        self.said: dict[tuple[tuple[str, str, str], str], tuple[bool, bool]] = {}
        self.count: Counter[str] = Counter()  # of the open elements
        at, n = 0, len(page)
        self.last = {c: page.rfind(c) for c in ">\"'"}
        while at < n:
            m = _TOKEN.search(page, at)
            if m is None:
                self.text(page[at:])
                break
            begin, end = m.start(), m.end()
            if m[2] is not None:
                end = self.tag_end(page, m.end())
                if end is None:  # no > is left: the rest holds no tag
                    comment = page.find("<!--", m.end())
                    begin = comment if comment >= 0 else n
                    self.text(page[at:begin])
                    break
            if begin > at:
                self.text(page[at:begin])
            at = end
            if m[2] is None:  # a comment or a declaration
                continue
            tag, attrs = m[2].lower(), page[m.end() : end - 1]
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, attrs)
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                inner = page[at : close.start() if close else n]
                at = close.end() if close else n
                if tag == "style":
                    if for_screens(Node(tag, attrs).get("media") or ""):
                        self.style(re.sub(r"/\*.*?(?:\*/|\Z)", "", inner, flags=re.S))
                elif inner and tag not in UNSEEN:
                    self.text(inner)
                self.end(tag)

    def tag_end(self, page: str, at: int) -> int | None:
        """Where the tag ends: after the first > outside quoted values. A quote that nothing closes begins no value."""
        while at <= self.last[">"]:
            m = _IN_TAG.search(page, at)
            if m is None:
                return None
            if m[1] is None:
                return m.end()
            at = page.index(m[1], m.end()) + 1 if m.end() <= self.last[m[1]] else m.end()
        return None

    def text(self, data: str) -> None:
        data = html.unescape(data) if "&" in data else data
        if self.open[-1].tag == "head" and data.strip(" \t\r\n\f"):
            self.close_to(len(self.open) - 1)
        # text between a table's parts is laid out before the table, in its parent
        if self.open[-1].tag in ("table", "thead", "tbody", "tfoot", "tr") and data.strip():
            table = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), 0)
            where = self.open[table - 1].children if table else self.open[-1].children
            where.insert(max(len(where) - 1, 0), data)
            return
        self.open[-1].children.append(data)

    def close_to(self, i: int) -> None:
        self.count.subtract(node.tag for node in self.open[i:])
        del self.open[i:]

    def implied(self, closes, stops) -> None:
        """Closes the outermost of `closes` that is open inside the nearest of `stops`."""
        if not any(self.count[c] for c in closes):
            return
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in stops:
                break
            if tag in closes:
                last = i
        if last is not None:
            self.close_to(last)

    def start(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self.implied({"p"}, P_SCOPE)
        if tag in IMPLIED:
            self.implied(*IMPLIED[tag])
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.push(Node("tr"))
        if tag == "html" and len(self.open) > 1:
            return
        if tag not in ("html", "head", "body", "title", "meta", "link", "base", "style", "script", "template", "noscript") and self.open[-1].tag == "head":
            self.close_to(len(self.open) - 1)
        node = Node(tag, attrs)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def push(self, node: Node) -> None:
        if len(self.open) > MAX_DEPTH:
            self.close_to(len(self.open) - 1)
        self.open[-1].children.append(node)
        self.open.append(node)
        self.count[node.tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
            return
        if not self.count[tag]:
            return
        stops = P_SCOPE if tag not in P_SCOPE and tag not in TABLE_PARTS else {"table"} if tag in TABLE_PARTS else set()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.close_to(i)
                return
            if self.open[i].tag in stops:
                break

    def rules(self, prop: str) -> dict[tuple[str, str, str], bool]:
        """Of the selectors that the style sheets name, whether they hide by this property."""
        return {selector: hides for (selector, own), (hides, _) in self.said.items() if own == prop}

    def style(self, sheet: str, depth: int = 0) -> None:
        """Reads the rules outside braces; of at-blocks, those of media that hold on every screen."""
        start = level = 0
        for m in re.finditer(r"[{};]|\Z", sheet):
            if m[0] == "{":
                level += 1
                if level == 1:
                    head, body = sheet[start : m.start()].strip(), m.end()
            elif level and m[0] != ";":
                level = level - 1 if m[0] else 0  # a sheet's end closes all
                if not level:
                    self.rule(head, sheet[body : m.start()], depth)
                    start = m.end()
            elif not level:
                start = m.end()

    def rule(self, head: str, body: str, depth: int) -> None:
        if head.startswith("@"):
            if head[:6].lower() == "@media" and for_screens(head[6:]) and depth < 20:
                self.style(body, depth + 1)
            return
        if "{" in body:  # nested rules are of other selectors
            body = body.partition("{")[0].rpartition(";")[0]
        for m in _SHOWS.finditer(body):
            prop, value, most = m[1].lower(), m[2].lower(), "important" in m[3].lower()
            hides = value == "none" if prop == "display" else value in ("hidden", "collapse")
            for selector in head.split(","):
                simple = _SIMPLE.match(selector.strip())
                if simple and simple[0]:
                    key = ((simple[1] or "").lower(), simple[2] or "", simple[3] or ""), prop
                    if most or not self.said.get(key, (False, False))[1]:
                        self.said[key] = hides, most


def for_screens(media: str) -> bool:
    return any(_MEDIA.match(x) for x in media.split(","))


def selectors(node: Node) -> list[tuple[str, str, str]]:
    """The simple selectors that match an element."""
    names = [("", "")]
    if node.attrs:
        names += [(".", c) for c in (node.get("class") or "").split()]
        own = node.get("id")
        names += [("#", own)] if own else []
    return [(kind, mark, name) for mark, name in names for kind in ("", node.tag) if kind or mark]


#: A generator that yields further generators to be called, gets their results, and returns its own.
type Steps[T] = Generator[Steps, object, T]


def called[T](steps: Steps[T]) -> T:
    """Runs steps and what they call, with a stack of its own instead of Python's."""
    stack, value = [steps], None
    while stack:
        try:
            inner = stack[-1].send(value)
        except StopIteration as e:
            stack.pop()
            value = e.value
        else:
            stack.append(inner)
            value = None
    return value


class Renderer:
    """Lays a tree out as lines."""

    def __init__(self, gone: dict[tuple[str, str, str], bool], hidden: dict[tuple[str, str, str], bool]):
        self.gone = {selector for selector, hides in gone.items() if hides}
        self.hidden = hidden

    def seen(self, node: Node) -> bool:
        """Whether the element has a place on the page; what it shows there is up to `visible`."""
        if node.tag in UNSEEN:
            return False
        if self.gone and any(x in self.gone for x in selectors(node)):
            return False
        if not node.attrs:
            return node.tag != "dialog"
        low = node.attrs.lower()
        if "hidden" in low and (node.get("hidden") is not None or node.tag == "input" and (node.get("type") or "").lower() == "hidden"):
            return False
        if "style" in low and _GONE.search(node.get("style") or ""):
            return False
        return node.tag != "dialog" or node.get("open") is not None

    def visible(self, node: Node) -> bool | None:
        """What the element says of its visibility: True, False, or None."""
        said = [self.hidden[x] for x in selectors(node) if x in self.hidden] if self.hidden else []
        if "visib" in node.attrs.lower():
            own = _VISIBILITY.findall(node.get("style") or "")
            if own:
                return own[-1].lower() == "visible"
        return not any(said) if said else None

    def uncover(self, nodes: list) -> None:
        """Puts in the place of each hidden element those inside it that are visible again."""
        stack = [nodes]
        while stack:
            own = stack.pop()
            out = []
            for node in own:
                if isinstance(node, Node) and self.visible(node) is False:
                    out += [" ", *self.reveal(node), " "]
                else:
                    out.append(node)
            own[:] = out
            stack += [c.children for c in out if isinstance(c, Node)]

    def reveal(self, node: Node) -> list:
        """The outermost elements inside a hidden one that say they are visible."""
        out, todo = [], list(reversed(node.children)) if self.seen(node) else []
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                continue
            if self.visible(child):
                out.append(child)
            elif self.seen(child):
                todo += reversed(child.children)
        return out

    # What follows calls itself for what is nested: these are generators that yield such
    # calls and get their results, so nesting takes room on the stack of `called` alone.

    def lines(self, nodes: list, pre: bool = False) -> Steps[list[str]]:
        """Lines of a block's content; an empty string stands for a blank line."""
        out = Lines(pre)
        yield self.fill(out, nodes)
        return out.done()

    def fill(self, out: Lines, nodes: list) -> Steps[None]:
        for node in nodes:
            if isinstance(node, str):
                out.text(node)
                continue
            tag = node.tag
            if tag == "br":
                out.new_line(force=True)
            elif not self.seen(node):
                continue
            elif tag == "hr":
                out.blank()
            elif tag in ("ul", "ol", "menu"):
                out.block((yield self.list_lines(node)), spaced=not out.in_item)
            elif tag == "table":
                out.block((yield self.table_lines(node)), spaced=True)
            elif tag == "pre":
                out.block((yield self.lines(node.children, pre=True)), spaced=True)
            elif tag in ("blockquote", "dd"):
                own = yield self.lines(node.children)
                out.block(["  " + x if x else "" for x in own], spaced=tag == "blockquote")
            elif tag == "details" and node.get("open") is None:
                out.new_line()
                yield self.fill(out, [c for c in node.children if isinstance(c, Node) and c.tag == "summary"])
                out.new_line()
            elif tag == "li":  # outside a list
                out.block(marked("- ", (yield self.item_lines(node))), spaced=False)
            elif tag == "input":
                out.text(node.get("value") or "")
            elif tag == "textarea":
                out.block([x for c in node.children if isinstance(c, str) for x in c.split("\n")], spaced=False)
            elif tag == "q":
                out.text("“")
                yield self.fill(out, node.children)
                out.text("”")
            elif tag in SPACED:
                out.blank()
                yield self.fill(out, node.children)
                out.blank()
            elif tag in LINED:
                out.new_line()
                yield self.fill(out, node.children)
                out.new_line()
            elif tag in ("td", "th"):  # outside a table
                yield self.fill(out, node.children)
                out.text(" ")
            else:
                yield self.fill(out, node.children)

    def item_lines(self, node: Node) -> Steps[list[str]]:
        out = Lines(False)
        out.in_item = True
        yield self.fill(out, node.children)
        return out.done()

    def list_lines(self, node: Node) -> Steps[list[str]]:
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and self.seen(c)]
        step = -1 if node.get("reversed") is not None else 1
        number = whole(node.get("start"), len(items) if step < 0 else 1)
        kind = node.get("type") or "1"
        out = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                if not self.seen(child):
                    continue
                number = whole(child.get("value"), number)
                out += marked(f"{numeral(number, kind)}. " if node.tag == "ol" else "- ", (yield self.item_lines(child)))
                number += step
            else:
                own = yield self.lines([child])
                out += ["  " + x for x in own if x]
        return out

    def table_lines(self, node: Node) -> Steps[list[str]]:
        """Cells padded to their columns' widths; a cell over several columns or rows keeps its place."""
        captions, rows, stack = [], [], list(reversed(node.children))
        while stack:
            child = stack.pop()
            if isinstance(child, str):  # outside cells: shown before the rows, as browsers do
                captions += yield self.lines([child])
                continue
            if not self.seen(child):
                continue
            if child.tag == "caption":
                captions += yield self.lines(child.children)
            elif child.tag == "tr":
                rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and self.seen(c)])
                for c in child.children:
                    if isinstance(c, str) or c.tag not in ("td", "th"):
                        captions += yield self.lines([c])
            elif child.tag in ("thead", "tbody", "tfoot"):
                stack += reversed(child.children)
            elif child.tag not in ("colgroup", "col"):
                captions += yield self.lines([child])
        taken: list[tuple[int, int, int]] = []  # columns from, to, that cells from above cover before this row
        grid: list[list[tuple[int, int, list[str]]]] = []
        width: dict[int, int] = {}
        for number, cells in enumerate(rows):
            taken = [t for t in taken if t[2] > number]
            column, placed, spans, met = 0, [], [], 0
            for cell in cells:
                while met < len(taken) and taken[met][0] <= column:
                    column = max(column, taken[met][1])
                    met += 1
                wide = min(max(whole(cell.get("colspan"), 1), 1), 1000)
                tall = min(max(whole(cell.get("rowspan"), 1), 1), len(rows) - number)
                text = yield self.lines(cell.children)
                placed.append((column, wide, text))
                if tall > 1:
                    spans.append((column, column + wide, number + tall))
                if wide == 1:
                    width[column] = max(width.get(column, 0), *(len(x) for x in text), 0)
                column += wide
            taken = covered(taken, spans)
            grid.append(placed)
        columns = sorted({*width, *(c for placed in grid for c, _, _ in placed)})
        at, starts = 0, {}
        for c in columns:
            starts[c] = at
            at += width.get(c, 0) + 2 if width.get(c, 0) else 0
        out = list(captions)
        for placed in grid:
            for k in range(max([len(t) for _, _, t in placed], default=0)):
                line = ""
                for c, _, text in placed:
                    if k < len(text) and text[k]:
                        line = line.ljust(starts[c])
                        line += ("  " if len(line) > starts[c] else "") + text[k]
                out.append(line.rstrip())
        return out


def covered(above: list[tuple[int, int, int]], own: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Two lists of column ranges with the row before which each ends, as one; where both cover a
    column, the later row counts, and neighbours of one row are one range."""
    if not own:
        return above
    out: list[tuple[int, int, int]] = []
    edges = sorted({x for a, b, _ in [*above, *own] for x in (a, b)})
    at = [0, 0]
    for a, b in zip(edges, edges[1:], strict=False):
        until = 0
        for k, ranges in enumerate((above, own)):
            while at[k] < len(ranges) and ranges[at[k]][1] <= a:
                at[k] += 1
            if at[k] < len(ranges) and ranges[at[k]][0] <= a:
                until = max(until, ranges[at[k]][2])
        if until and out and out[-1][1:] == (a, until):
            out[-1] = (out[-1][0], b, until)
        elif until:
            out.append((a, b, until))
    return out


class Lines:
    """Collects inline text and blocks; white space collapses unless `pre`."""

    def __init__(self, pre: bool):
        self.pre, self.in_item = pre, False
        self.out: list[str] = []
        self.now: list[str] = []
        self.gap = False  # a space is due before the next word

    def text(self, data: str) -> None:
        if self.pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for x in rest:
                self.new_line(force=True)
                self.now.append(x)
            return
        data = _SPACES.sub(" ", data)
        if data == " " or not data:
            self.gap |= data == " "
            return
        if (self.gap or data[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(data.strip(" "))
        self.gap = data[-1] == " "

    def new_line(self, force: bool = False) -> None:
        if self.now:
            line = "".join(self.now)
            self.out.append(line if self.pre else line.strip(" "))
        elif force:
            self.out.append("")
        self.now, self.gap = [], False

    def blank(self) -> None:
        self.new_line()
        if self.out and self.out[-1]:
            self.out.append("")

    def block(self, lines: list[str], spaced: bool) -> None:
        self.blank() if spaced else self.new_line()
        self.out += lines
        if spaced:
            self.blank()

    def done(self) -> list[str]:
        self.new_line()
        out = self.out
        while out and not out[-1].strip(" "):
            out.pop()
        first = next((i for i, x in enumerate(out) if x.strip(" ")), len(out))
        return out[first:]


def marked(mark: str, lines: list[str]) -> list[str]:
    pad = " " * len(mark)
    return [(mark if i == 0 else pad) + x if x or i == 0 else "" for i, x in enumerate(lines or [""])]


def whole(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m[1]) if m else default


def numeral(n: int, kind: str) -> str:
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(ord(kind) + k) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out.upper() if kind == "I" else out
    return str(n)


def rendered(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    tree = TreeBuilder(page.replace("\0", ""))
    renderer = Renderer(tree.rules("display"), tree.rules("visibility"))
    if renderer.hidden or "visib" in page.lower():
        renderer.uncover(tree.root.children)
    lines = called(renderer.lines(tree.root.children))
    out = []
    for line in lines:  # one blank line at most, outside pre this always holds
        line = line.rstrip(" ")
        if line or not out or out[-1]:
            out.append(line)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: the id, text, and n_chars and n_lines of the text."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [rendered(x) for x in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "n_chars", "n_lines"])

    got = pages.select(F.col(id_col).cast("long"), F.col(html_col).cast("string")).mapInArrow(run, "id long, text string, n_chars long, n_lines long")
    return got.withColumnRenamed("id", id_col)
