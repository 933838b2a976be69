"""The main text of web pages by two extractors: blocks scored by text and link density over the tree, and, where that finds too little, a plain reading.

The first gives each block of text a score, its length without what stands in links, and passes it on to the element around it and, by half, to
the one around that; the element with the most is the page's main part, and its blocks that aren't mostly links are the text. The second
reads all headings, paragraphs, items and quotes of the page's main element, or body, outside navigation and the like. The longer one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

LEAST_CHARS, MOST_LINKS = 120, 0.5
NEVER = {"script", "style", "noscript", "template", "svg", "head"}
CHROME = {"nav", "header", "footer", "aside"}
CHROME_CLASSES = ("cookie", "breadcrumb")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p": "paragraph", "li": "list_item", "blockquote": "quote", "pre": "paragraph", "tr": "table_row"} | {f"h{i}": "heading" for i in range(1, 7)}
PLAIN = {"h2", "h3", "h4", "p", "li", "blockquote"}
#: Elements that end an open one of these when they begin.
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}} | {t: {"p"} for t in ("div", "section", "article", "ul", "ol", "table", "blockquote", "pre", *(f"h{i}" for i in range(1, 7)))}
SCOPES = {"ul", "ol", "table", "div", "section", "article", "body"}
OUT = "page_id long, extractor string, title string, pos long, kind string, text string, level int, chrome_chars long"


class Tree(HTMLParser):
    """Elements by number: tag, parent, class, their own text in order, and whether they stand in a link."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.cls, self.pieces, self.linked = ["#"], [-1], [""], [], [False]
        self.open, self.never, self.title, self.in_title, self.scripts = [0], 0, [], False, False

    def handle_starttag(self, tag, attrs):
        self.in_title = tag == "title" and not self.title
        self.scripts |= tag == "script"
        if tag in NEVER and tag != "head":
            self.never += 1
            return
        if self.never or tag in VOID or tag == "head":
            if tag == "br":
                self.handle_data(" ")
            return
        ends, last = ENDS.get(tag, ()), len(self.open)
        for k in range(len(self.open) - 1, 0, -1):
            here = self.tag[self.open[k]]
            if here in SCOPES:
                break
            if here in ends:
                last = k
        del self.open[last:]
        up = self.open[-1]
        self.open.append(len(self.tag))
        self.tag.append(tag)
        self.parent.append(up)
        self.cls.append((dict(attrs).get("class") or "").lower())
        self.linked.append(self.linked[up] or tag == "a")

    def handle_endtag(self, tag):
        self.in_title &= tag != "title"
        if tag in NEVER:
            self.never -= self.never > 0 and tag != "head"
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[k]] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.never:
            self.pieces.append((self.open[-1], data))


def squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


class Page:
    """A page's blocks: each piece of text belongs to the block element nearest around it."""

    def __init__(self, html: str):
        self.tree = t = Tree()
        t.feed(html)
        t.close()
        n = len(t.tag)
        self.block, self.chrome, self.main = [-1] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = t.parent[i]
            self.block[i] = i if t.tag[i] in BLOCKS and not (up >= 0 and self.block[up] >= 0 and t.tag[self.block[up]] == "tr") else self.block[up]
            self.chrome[i] = self.chrome[up] or t.tag[i] in CHROME or any(c in t.cls[i] for c in CHROME_CLASSES)
            self.main[i] = self.main[up] or t.tag[i] == "main"
        self.text: dict[int, list[str]] = {}
        links: dict[int, int] = {}
        for i, data in t.pieces:
            b = self.block[i]
            if b >= 0:
                if t.tag[i] in ("td", "th") and self.text.get(b):
                    data = " " + data
                self.text.setdefault(b, []).append(data)
                links[b] = links.get(b, 0) + len("".join(data.split())) * t.linked[i]
        self.said = {b: s for b, parts in sorted(self.text.items()) if (s := squeezed(parts))}
        self.links = {b: links[b] / max(1, len("".join(s.split()))) for b, s in self.said.items()}
        self.title = squeezed(t.title).split("|")[0].strip()
        self.chars = len(squeezed([x + " " for _, x in t.pieces]))

    def rows(self, chosen) -> list[tuple]:
        t = self.tree
        return [(BLOCKS[t.tag[b]], s, int(t.tag[b][1]) if BLOCKS[t.tag[b]] == "heading" else 0) for b, s in self.said.items() if chosen(b)]

    def dense(self) -> list[tuple]:
        """Blocks of the element with the most text outside links."""
        t, score = self.tree, {}
        for b, s in self.said.items():
            worth = len(s) * (1 - self.links[b]) if not self.chrome[b] and BLOCKS[t.tag[b]] != "heading" else 0.0
            up = t.parent[b]
            over = t.parent[up] if up > 0 else 0
            score[up] = score.get(up, 0.0) + worth
            score[over] = score.get(over, 0.0) + worth / 2
        best = max(score, key=lambda i: (score[i], -i), default=0)
        inside = [False] * len(t.tag)
        for i in range(len(t.tag)):
            inside[i] = i == best or i > 0 and inside[t.parent[i]]
        return self.rows(lambda b: inside[b] and not self.chrome[b] and self.links[b] <= MOST_LINKS and t.tag[b] != "h1")

    def plain(self) -> list[tuple]:
        """Headings, paragraphs, items and quotes of the main element, or of the page."""
        t = self.tree
        whole = not any(self.main)
        return self.rows(lambda b: t.tag[b] in PLAIN and not self.chrome[b] and (whole or self.main[b]))


def chars(rows: list[tuple]) -> int:
    return sum(len(r[1]) for r in rows)


def main_text(html: str) -> tuple[str, str, list[tuple], int]:
    """(extractor, title, blocks of kind, text and level, characters of the page outside them); the extractor is failed where both find too little."""
    page = Page(html)
    name, rows = "density", page.dense()
    if chars(rows) < LEAST_CHARS and chars(other := page.plain()) > chars(rows):
        name, rows = "plain", other
    if chars(rows) < LEAST_CHARS:
        why = "no server-rendered content" if page.tree.scripts else "too little main content"
        return "failed", page.title, [("failure", why, 0)], page.chars
    return name, page.title, rows, max(0, page.chars - chars(rows))


def main_blocks(pages: DataFrame) -> DataFrame:
    """Rows (page_id, extractor, title, pos, kind, text, level, chrome_chars) of pages (page_id, html); a page without enough text gives one row of kind failure."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                name, title, rows, chrome = main_text(html or "")
                yield pd.DataFrame([(page_id, name, title, i, *r, chrome) for i, r in enumerate(rows)], columns=[x.split()[0] for x in OUT.split(", ")])

    return pages.select("page_id", "html").mapInPandas(run, OUT)
