"""Web pages: links, crawl frontiers over stored pages, blocks of main text, source rules."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import checkpoint

DROPPED = {"script", "style", "noscript", "nav", "header", "footer", "aside"}
KINDS = {"h2": "heading", "h3": "heading", "h4": "heading", "p": "paragraph", "li": "list_item", "blockquote": "quote"}
LEAST_CHARS = 120


def links(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, link): absolute links without fragment and query; mail, phone and script links are left out."""
    href = pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('<a[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    bare = F.split_part(F.split_part("href", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    rows = href.where(~F.col("href").rlike("^(mailto|tel|javascript):")).withColumn("bare", bare).where("bare <> ''")
    return rows.select("page_id", "url", F.when(F.col("bare").startswith("/"), F.concat(root, "bare")).otherwise(F.col("bare")).alias("link"))


def allowed(rows: DataFrame, column: str, disallowed: DataFrame) -> DataFrame:
    """Rows whose address stands below none of the disallowed (prefix) rows of its host. A host without rules allows all."""
    host = lambda c: F.regexp_extract(c, "^(https?://[^/]+)", 1)
    rules = disallowed.select(host("prefix").alias("_host"), F.col("prefix").alias("_prefix"))
    named = rows.withColumn("_own", host(column))
    return named.join(rules, (F.col("_own") == F.col("_host")) & F.col(column).startswith(F.col("_prefix")), "left_anti").drop("_own")


def crawl(pages: DataFrame, seeds: DataFrame, prefix: str, max_pages: int | None = None, disallowed: DataFrame | None = None) -> DataFrame:
    """Addresses reached from seeds (url) by links below a prefix: (url, depth, stored), breadth first over stored pages, until nothing is new.

    A page that isn't stored is reached, counts to no limit and leads nowhere; disallowed (prefix) rows are robots' rules. With max_pages
    the crawl ends in the round in which so many stored pages are reached, and of that round's pages those with the first addresses stay.
    Each round joins the frontier with the links and drops what was seen, and is cut off by a checkpoint.
    """
    edges = links(pages).where(F.col("link").startswith(prefix)).select(F.col("url").alias("from"), F.col("link").alias("to")).distinct()
    edges = checkpoint(edges if disallowed is None else allowed(edges, "to", disallowed))
    stored = pages.select("url").distinct().withColumn("stored", F.lit(True))
    mark = lambda rows: rows.join(stored, "url", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))
    frontier = checkpoint(mark(seeds.select("url").distinct().withColumn("depth", F.lit(0))))
    seen, depth, reached = None, 0, 0
    while not frontier.isEmpty():
        if max_pages is not None:
            here = frontier.where("stored").count()
            if reached + here >= max_pages:
                last = frontier.where("stored").orderBy("url").limit(max_pages - reached)
                last = last.union(frontier.where("not stored"))
                return last if seen is None else seen.union(last)
            reached += here
        seen = frontier if seen is None else checkpoint(seen.union(frontier))
        depth += 1
        fresh = frontier.join(edges, frontier["url"] == edges["from"]).select(F.col("to").alias("url")).distinct()
        frontier = checkpoint(mark(fresh.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth))))
    return frontier if seen is None else seen


def by_rule(pages: DataFrame, rules: list[tuple[str, str, int]], default: tuple[str, int]) -> DataFrame:
    """Adds doc_type and authority of the first rule whose substring the url contains."""
    kind, weight = F.lit(default[0]), F.lit(default[1])
    for part, doc_type, authority in reversed(rules):
        hit = F.contains(F.col("url"), F.lit(part))
        kind, weight = F.when(hit, doc_type).otherwise(kind), F.when(hit, authority).otherwise(weight)
    return pages.withColumn("doc_type", kind).withColumn("authority", weight)


class _Blocks(HTMLParser):
    """Main text as (kind, text, level), what stands in navigation and the like left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.title, self.dropped, self.kind, self.level, self.text = [], [], 0, None, 0, []
        self.in_title = False

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text and self.kind:
            self.out.append((self.kind, text, self.level))
        self.kind, self.level, self.text = None, 0, []

    def handle_starttag(self, tag, attrs):
        self.dropped += tag in DROPPED
        self.in_title = tag == "title"
        if tag in KINDS:
            self.flush()
            self.kind, self.level = KINDS[tag], int(tag[1]) if tag[0] == "h" else 0

    def handle_endtag(self, tag):
        self.dropped -= tag in DROPPED and self.dropped > 0
        self.in_title = self.in_title and tag != "title"
        if tag in KINDS:
            self.flush()

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif self.kind and not self.dropped:
            self.text.append(data)


def page_blocks(pages: DataFrame) -> DataFrame:
    """Rows (page_id, pos, kind, text, level); a page with under LEAST_CHARS of text gives one row of kind failure."""

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"], strict=True):
                parser = _Blocks()
                parser.feed(html or "")
                parser.close()
                parser.flush()
                found = [(page_id, i, k, t, lv) for i, (k, t, lv) in enumerate(parser.out)]
                rows += found if sum(len(x[3]) for x in found) >= LEAST_CHARS else [(page_id, 0, "failure", "too little text", 0)]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "text", "level"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, pos long, kind string, text string, level long")
