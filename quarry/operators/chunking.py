"""Records from documents: headings, form fields, sections, packed chunks, rate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folds import in_order
from ..functions.text import words

MOST_TOKENS, LEAST_CHARS = 320, 25


def heading(title: Column, synonyms: dict[str, str] | None = None) -> Column:
    """A heading without numbering and colon: its synonym if it has one, else titled where it is all capitals, the first letter raised (ß as SS)."""
    bare = F.rtrim(F.trim(F.regexp_replace(title, r"^\s*[0-9]+(\.[0-9]+)*[.)]?\s+", "")), F.lit(":"))
    shouting = (bare == F.upper(bare)) & (bare != F.lower(bare))
    titled = F.when(shouting, F.initcap(F.lower(bare))).otherwise(bare)
    raised = F.concat(F.upper(F.substring(titled, 1, 1)), F.substring(titled, F.lit(2), F.length(titled)))
    out = raised
    for said, meant in reversed((synonyms or {}).items()):
        out = F.when(F.lower(bare) == said, meant).otherwise(out)
    return out


def form_field(label: Column, rules: list[tuple[str, str]]) -> Column:
    """The field of the first pattern that a label matches, else the label in snake case."""
    out = None
    for pattern, field in rules:
        out = F.when(label.rlike(pattern), field) if out is None else out.when(label.rlike(pattern), field)
    snake = F.regexp_replace(F.lower(F.trim(label)), r"[^a-z0-9]+", "_")
    return snake if out is None else out.otherwise(snake)


def first_keyword(text: Column, keywords: dict[str, str]) -> Column:
    """What the first contained keyword stands for; null if none is contained."""
    out = F.lit(None).cast("string")
    for word, value in reversed(keywords.items()):
        out = F.when(F.contains(text, F.lit(word)), value).otherwise(out)
    return out


def sections(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Blocks (doc, pos, kind, text) with the heading that they stand under, and its place."""
    before = Window.partitionBy(doc).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_heading = F.col("kind").isin("heading", "title")
    return blocks.withColumn("section", F.last(F.when(is_heading, F.col("text")), ignorenulls=True).over(before)).withColumn("section_no", F.count(F.when(is_heading, 1)).over(before))


class _Pack:
    """The greedy packing of one section: what is held is the chunk in the making."""

    def __init__(self, key: tuple, most: int):
        self.key, self.most, self.held, self.n = key, most, [], 0

    def chunk(self) -> list[tuple]:
        self.n += 1
        return [(*self.key, self.n - 1, "\n".join(t for t, _ in self.held), tokens_of(sum(w for _, w in self.held)))]

    def row(self, x) -> list[tuple]:
        out = []
        if self.held and tokens_of(sum(w for _, w in self.held) + x.words) > self.most:
            out, self.held = self.chunk(), self.held[-1:] if x.overlap else []
        self.held.append((x.text, x.words))
        return out

    def end(self) -> list[tuple]:
        return self.chunk() if self.held else []


def tokens_of(words: int) -> int:
    """A model's tokens, roughly: words times 1.3, rounded down."""
    return int(words * 1.3)


def pack(blocks: DataFrame, most: int = MOST_TOKENS, doc: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of blocks (doc, section_no, pos, text, overlap): greedy, in order within a section; with overlap the last block of a chunk opens the next.

    Blocks stream through sorted, so a document without headings is no group to hold. Chunks under LEAST_CHARS are left out. Blocks that
    stand together by document stay there. Columns to keep are the same for all of a section, and come back with its chunks.
    """
    keys = [doc, "section_no", *keep]
    rows = blocks.select(*keys, "pos", "text", F.size(words(F.col("text"))).alias("words"), "overlap")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    packed = in_order(rows, keys, ["pos"], lambda key: _Pack(key, most), f"{kinds}, chunk_index long, text string, tokens long", move=False)
    return packed.where(F.length("text") >= LEAST_CHARS)


def rate_chunks(rows: DataFrame, group: list[str], line: Column, order: list[str]) -> DataFrame:
    """One record for each group of a rate table, a line for each row in order; lines come as one text with a count."""
    packed = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy(*group).agg(packed.alias("ls")).select(*group, F.size("ls").cast("long").alias("n_lines"), F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content"))


def form_schema(labels: DataFrame, rules: list[tuple[str, str]], doc: str = "doc_id") -> DataFrame:
    """One record for each form: its labels (doc, pos, label) as canonical fields, in order. A form's labels are few; they make one text."""
    fields = labels.select(doc, "pos", "label", form_field(F.col("label"), rules).alias("field"))
    packed = F.array_sort(F.collect_list(F.struct("pos", "label", "field")))
    return fields.groupBy(doc).agg(packed.alias("fs")).select(doc, F.array_join(F.transform("fs", lambda x: x["field"]), ",").alias("fields"), F.size("fs").cast("long").alias("n"))
