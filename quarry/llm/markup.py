"""Layout-aware HTML text: a tree builder with implied tags and visibility rules, then a renderer for what a reader sees.

Blocks stand on lines of their own, paragraphs and headings with a blank line around them; list items carry their marker and depth;
table cells are padded so that columns line up; preformatted text keeps its spaces. What is hidden (scripts, styles, templates,
hidden or display:none elements, hidden inputs) is left out, and nothing else: text that a table can't hold stands before it. Trees are
built and rendered without recursion, tables within tables too, and each tag costs the same at any depth.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from collections.abc import Iterable
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("head script style noscript template title iframe object defs desc metadata annotation annotation-xml datalist audio video canvas".split())
#: What may stand in a head, and what a table, its groups and its rows hold.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
GROUPS = frozenset("thead tbody tfoot".split())
IN_TABLE = GROUPS | frozenset("tr td th caption colgroup col script style template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dir div dt figcaption footer form header html li main menu nav section summary tr caption thead tbody tfoot legend option optgroup select".split())
#: A start tag of the key ends open elements of the values, up to a barrier.
P_ENDS = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
ENDS |= {x: {"tr", "td", "th", "caption", "thead", "tbody", "tfoot"} for x in ("thead", "tbody", "tfoot")} | {f"h{i}": {f"h{j}" for j in range(1, 7)} for i in range(1, 7)}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, **{x: {"table"} for x in ("tr", "td", "th", "thead", "tbody", "tfoot")}, "option": {"select"}, "optgroup": {"select"}}
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
SCOPE = frozenset("html body table td th caption object template".split())
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
#: Lists deeper than this are indented no further, and say how deep they are.
MOST_INDENT = 40
#: As HTML has it.
MOST_COLUMNS, MOST_ROWS = 1000, 65_534
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "hidden", "parent")

    def __init__(self, tag: str, attributes: dict, hidden: bool):
        self.tag, self.attributes, self.children, self.hidden, self.parent = tag, attributes, [], hidden, None


class TreeBuilder(HTMLParser):
    """Builds a tree from any text: tags that HTML implies are closed or opened, stray end tags are ignored.

    Where elements of a tag are open is kept by tag, so that ending one needs no search through all that is open.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, False)
        self.open, self.places = [self.root], defaultdict(list, {"html": [0]})

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of some tags, -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def pop(self) -> None:
        self.places[self.open.pop().tag].pop()

    def close_through(self, tags: Iterable[str], barrier: Iterable[str]) -> bool:
        """Ends the innermost open element among tags, and what is open inside it, unless a barrier stands before."""
        at = self.last(tags)
        if at < 1 or at < self.last(barrier):
            return False
        while len(self.open) > at:
            self.pop()
        return True

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attributes = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            if tag == "body" and not self.places.get("body"):
                self.close_through({"head"}, set())
                self.push(tag, attributes)
            return
        if tag not in IN_HEAD and self.open[-1].tag == "head":
            self.pop()
        if tag in P_ENDS:
            self.close_through({"p"}, SCOPE)
        if tag in ENDS:
            while self.close_through(ENDS[tag], BARRIERS.get(tag, SCOPE)):
                pass
        if tag in IN_TABLE and self.last({"table"}) > 0 and self.last({"table"}) > self.last({"td", "th", "caption"}):
            while self.open[-1].tag not in ("table", "tr", *GROUPS):  # what was moved out of the table ends
                self.pop()
        if tag == "form" and self.in_table():
            return
        if tag == "table" and self.in_table():  # a table between the cells of another ends it
            self.close_through({"table"}, set())
        if tag in ("td", "th") and self.open[-1].tag in ("table", *GROUPS):
            self.push("tr", {})
        self.push(tag, attributes)
        if tag in VOID:
            self.pop()

    def in_table(self) -> bool:
        """Whether the innermost open element is one that holds no text: a table, its groups and rows."""
        return self.open[-1].tag in ("table", "tr", *GROUPS) and self.last({"table"}) > 0

    def put(self, child, tag: str = "") -> None:
        """Adds a node or text; what a table can't hold goes before the table."""
        if tag not in IN_TABLE and self.in_table():
            table_ = self.open[self.last({"table"})]
            holder = table_.parent
            at = next(i for i in reversed(range(len(holder.children))) if holder.children[i] is table_)
            holder.children.insert(at, child)
        else:
            holder = self.open[-1]
            holder.children.append(child)
        if isinstance(child, Node):
            child.parent = holder

    def push(self, tag: str, attributes: dict) -> None:
        hidden = tag in UNSEEN or "hidden" in attributes or tag == "input" and attributes.get("type", "").lower() == "hidden" or bool(HIDDEN_STYLE.search(attributes.get("style", "")))
        node = Node(tag, attributes, hidden or tag == "dialog" and "open" not in attributes)
        self.put(node, tag)
        self.places[tag].append(len(self.open))
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing on elements that aren't void

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("html", "body") or tag == "form" and self.in_table():
            return
        if tag == "p" and not self.places.get("p"):
            self.push("p", {})
        barrier = {"table"} - {tag} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "li", "p") else set()
        self.close_through(HEADINGS if tag in HEADINGS else {tag}, barrier)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """HTML has no marked sections: what looks like one is a comment up to the next >."""
        return self.parse_bogus_comment(i)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.pop()
        if data.strip() or not self.in_table():
            self.put(data)


class Page:
    """Lines of text in the making: spaces collapse, blocks break, blank lines don't repeat."""

    def __init__(self):
        self.lines: deque[str] = deque()
        self.line, self.gap, self.wait = "", 0, False

    def text(self, data: str, kept: bool = False) -> None:
        if kept:
            first, *rest = data.split("\n")
            self.put(first)
            for x in rest:
                self.lines.append(self.line.rstrip())
                self.line = ""
                self.put(x)
            return
        data = SPACES.sub(" ", data)
        if data.startswith(" "):
            self.wait = self.wait or bool(self.line)
            data = data[1:]
        if data:
            tail = data.endswith(" ")
            self.put((" " if self.wait and self.line else "") + data.rstrip(" "))
            self.wait = tail

    def put(self, data: str) -> None:
        if data:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.line += data

    def end(self, blank: bool = False) -> None:
        """Ends a line; blank asks for an empty line before what follows."""
        if self.line.strip():
            self.lines.append(self.line.rstrip())
            self.gap = 1
        self.line, self.wait = "", False
        self.gap = max(self.gap, 2 if blank else 1)

    def result(self) -> deque[str]:
        """The lines, without empty ones at either end; the page is done with."""
        self.end()
        while self.lines and not self.lines[0]:
            self.lines.popleft()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines

    def block(self, lines: deque[str]) -> None:
        """Lines that are laid out already, between empty ones."""
        self.end(True)
        if lines:
            if self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.lines, self.gap = joined(self.lines, lines), 1
        self.end(True)


def joined(first: deque[str], then: deque[str]) -> deque[str]:
    """Both one after the other, made of the longer of them: tables within tables cost what they hold, whatever their depth."""
    if len(first) < len(then):
        then.extendleft(reversed(first))
        return then
    first.extend(then)
    return first


def spanned(x: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; a rowspan of zero goes on to the end."""
    text = x.attributes.get(name, "1").strip()
    n = min(int(text), most) if text.isdecimal() and len(text) < 10 else 1
    return n or (most if name == "rowspan" else 1)


def grid(rows: list[list[tuple[deque[str], int, int]]]) -> list[list[deque[str]]]:
    """Rows of cells (lines, columns, rows) as rows of columns of lines: what cells from above or from the left reach into is empty.

    Columns in which no text begins are left out, so a heading over the whole table is no wider than the table.
    """
    placed, reach = [], {}
    for row in rows:
        taken, at = {}, 0
        for lines, wide, high in row:
            while reach.get(at, 0) > 0:
                at += 1
            taken[at] = lines
            if high > 1:
                reach |= {c: high for c in range(at, at + wide)}
            at += wide
        reach = {c: n - 1 for c, n in reach.items() if n > 1}
        placed.append(taken)
    used = sorted({c for taken in placed for c, lines in taken.items() if lines})
    return [[taken.get(c, deque()) for c in used] for taken in placed]


def aligned(rows: list[list[deque[str]]]) -> deque[str]:
    """Rows as lines, columns padded to their widest line; lines of one row stand side by side. A row of one cell, its first, has no columns and widens none."""
    widths: dict[int, int] = {}
    single = [not any(row[1:]) for row in rows]
    for row in (row for row, one in zip(rows, single, strict=True) if not one):
        for i, lines in enumerate(row):
            widths[i] = max(widths.get(i, 0), max(map(len, lines), default=0))
    out: deque[str] = deque()
    for row, one in zip(rows, single, strict=True):
        if one:
            out = joined(out, row[0])
            continue
        columns = [list(lines) for lines in row]
        for k in range(max(map(len, columns))):
            cells = [lines[k] if k < len(lines) else "" for lines in columns]
            last = max((i for i, c in enumerate(cells) if c), default=-1)
            out.append(" | ".join(c.ljust(widths[i]) for i, c in enumerate(cells[: last + 1])).rstrip())
    return out


class Context:
    """Where text goes: a page of its own for the document and for each cell, with the lists and the rows of tables that are open in it."""

    def __init__(self):
        self.page, self.lists, self.kept, self.tables = Page(), [], 0, []


def indent(depth: int) -> str:
    return "  " * depth if depth <= MOST_INDENT else "  " * MOST_INDENT + f"[{depth}] "


def render(root: Node) -> str:
    """The visible text below a node. What is left to do stands on one stack: nodes to open and close, rows and cells to end."""
    contexts = [Context()]  # the document, and cells within each other
    todo: list[tuple] = [("open", root)]
    while todo:
        what, x = todo.pop()
        here = contexts[-1]
        page, lists = here.page, here.lists
        if what == "open":
            if isinstance(x, str):
                page.text(x, here.kept > 0)
                continue
            if x.hidden and x is not root:
                continue
            tag = x.tag
            if tag == "br":
                page.end() if page.line else page.lines.append("") if page.lines and page.lines[-1] else None
                continue
            if tag in BLOCKS:
                page.end(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag == "hr":
                continue
            if tag == "table":
                here.tables.append([])
                todo.append(("table_end", x))
                todo.extend(("row", c) for c in reversed(x.children))
                continue
            if tag == "li":
                depth = max(0, len(lists) - 1)
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] += 1
                    page.put(indent(depth) + f"{lists[-1][1]}. ")
                else:
                    page.put(indent(depth) + "- ")
            elif tag in ("ul", "ol", "menu"):
                start = x.attributes.get("start", "1").strip()
                lists.append([tag, int(start) - 1 if start.isdecimal() and len(start) < 10 else 0])
            elif tag in ("pre", "textarea"):
                here.kept += 1
            elif tag == "img" and x.attributes.get("alt", "").strip():
                page.text(x.attributes["alt"])
            elif tag == "input" and x.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                page.text(x.attributes.get("value", ""))
            todo.append(("close", x))
            todo.extend(("open", c) for c in reversed(x.children))
        elif what == "close":
            tag = x.tag
            if tag in ("pre", "textarea"):
                here.kept -= 1
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            if tag in BLOCKS:
                page.end(tag in SPACED and not (tag in ("ul", "ol") and lists))
        elif what == "row":  # a child of a table or of a group of rows: anything but rows and groups is a row of one cell
            if isinstance(x, str) or x.hidden:
                continue
            if x.tag in GROUPS:
                todo.extend(("row", c) for c in reversed(x.children))
            else:
                here.tables[-1].append([])
                todo.extend(("cell", c) for c in (reversed(x.children) if x.tag == "tr" else [x]))
        elif what == "cell":
            if not isinstance(x, str) and not x.hidden:
                contexts.append(Context())
                todo.append(("cell_end", x))
                todo.extend(("open", c) for c in reversed(x.children))
        elif what == "cell_end":
            lines = contexts.pop().page.result()
            contexts[-1].tables[-1][-1].append((lines, spanned(x, "colspan", MOST_COLUMNS), spanned(x, "rowspan", MOST_ROWS)))
        else:
            rows = [r for r in grid(here.tables.pop()) if any(r)]
            page.block(aligned(rows))
    return "\n".join(contexts[0].page.result())


def visible_text(html: str) -> str:
    """The visible text of a page, as a reader would see it laid out. An empty page has none."""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return render(builder.root)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, title, text, n_lines, n_chars) of whole pages. Null and empty pages have an empty text and a null title.

    Repeated rows give repeated rows, an empty table none; other columns are not read. A page of any depth is one row's work.
    """

    def make():
        def step(batch: dict) -> dict:
            out = {"page_id": batch["page_id"], "title": [], "text": []}
            for html in batch["html"]:
                builder = TreeBuilder()
                builder.feed(html)
                builder.close()
                out["title"].append(title_of(builder.root))
                out["text"].append(render(builder.root))
            return out

        return step

    rows = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    out = arrow_map(rows, make, "page_id long, title string, text string")
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("page_id", "title", "text", lines.cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"))


def title_of(root: Node) -> str | None:
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, Node):
            if x.tag == "title":
                return SPACES.sub(" ", "".join(c for c in x.children if isinstance(c, str))).strip()
            stack.extend(reversed(x.children))
    return None


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
