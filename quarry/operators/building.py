"""Records of a knowledge base from sources of several kinds: blocks normalized, then cut as rate tables, sheets, forms or sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import chunking, normalizing

#: A sheet of more rows gives one record a row.
SHEET_ROWS = 8


def normalized(blocks: DataFrame, terms: dict[str, list[str]], synonyms: dict[str, str] | None = None) -> DataFrame:
    """Blocks with headings cleaned, then terms and dates of every text made uniform; `invalid` lists dates that don't exist. Null texts stay null."""
    is_heading = F.col("kind").isin("heading", "title")
    headed = blocks.withColumn("text", F.when(is_heading, chunking.heading(F.col("text"), synonyms)).otherwise(F.col("text")))
    dated = headed.withColumn("_d", normalizing.uniform(F.col("text"), terms))
    return dated.withColumn("text", F.col("_d.text")).withColumn("invalid", F.col("_d.invalid")).drop("_d")


def cells_text(cells: dict[str, Column]) -> Column:
    """Cells by name as one line, empty ones left out."""
    return F.concat_ws("; ", *[F.when(v != "", F.concat(F.lit(f"{k}: "), v)) for k, v in cells.items()])


def sheet_chunks(rows: DataFrame, sheet: list[str], order: list[str], line: Column, most: int = SHEET_ROWS) -> DataFrame:
    """Rows (sheet, n_rows, content): one record for each row of a sheet of more than `most` rows, else one for the sheet, its rows in order.

    Sheets are counted before rows come together, so what is gathered has `most` rows at most. Rows without any value give nothing and don't count.
    """
    lines = rows.select(*sheet, *order, line.alias("line")).where("line <> ''")
    counted = lines.groupBy(*sheet).agg(F.count("*").alias("_n"))
    same = reduce(lambda a, b: a & b, [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in sheet])
    sized = lines.alias("l").join(counted.alias("c"), same).select("l.*", "_n")
    single = sized.where(F.col("_n") > most).select(*sheet, F.lit(1).cast("long").alias("n_rows"), F.col("line").alias("content"))
    ordered = F.array_sort(F.collect_list(F.struct(*order, "line")))
    whole = sized.where(F.col("_n") <= most).groupBy(*sheet).agg(F.count("*").alias("n_rows"), ordered.alias("ls"))
    return single.union(whole.select(*sheet, "n_rows", F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("content")))


def section_chunks(blocks: DataFrame, titles: DataFrame, doc: str = "doc_id", most: int = chunking.MOST_TOKENS) -> DataFrame:
    """Rows (doc, section_no, chunk_index, title, content, tokens, parent_key) of blocks (doc, pos, kind, text) under titles (doc, title, and what else is to come with the chunks).

    A heading that asks is its chunks' title, and they don't overlap; others stand behind the document's title. List items keep their dash.
    Chunks of one section share the parent key. Text before the first heading has the document's title. Titles go to the blocks, which
    stay where they stand by document until they are packed.
    """
    more = [c for c in titles.columns if c not in (doc, "title")]
    placed = chunking.sections(blocks.join(titles, doc, "left"), doc)
    asks = F.coalesce(F.rtrim("section").endswith("?"), F.lit(False))
    text = F.when(F.col("kind") == "list_item", F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))
    body = placed.where(~F.col("kind").isin("heading", "title")).select(doc, "section_no", "section", "title", *more, "pos", text.alias("text"), (~asks).alias("overlap"))
    packed = chunking.pack(body, most, doc, ("section", "title", *more))
    title = F.when(asks, F.col("section")).otherwise(F.concat_ws(" › ", "title", "section"))
    parent = F.concat_ws("#", F.col(doc).cast("string"), F.col("section_no").cast("string"))
    return packed.select(doc, "section_no", "chunk_index", title.alias("title"), F.col("text").alias("content"), "tokens", parent.alias("parent_key"), *more)


def dispatched(kinds: DataFrame, branches: dict[str, DataFrame], default: str, doc: str = "doc_id") -> DataFrame:
    """The records of each document from the branch of its doc_type, or from the default branch if its type has none.

    Branches are frames of the same columns, `doc` among them; each is asked only for its own documents.
    """
    branch = F.when(F.col("doc_type").isin(*branches), F.col("doc_type")).otherwise(default)
    chosen = kinds.select(doc, branch.alias("_branch")).distinct()
    parts = [records.join(chosen.where(F.col("_branch") == name), doc, "left_semi").withColumn("branch", F.lit(name)) for name, records in branches.items()]
    return reduce(DataFrame.unionByName, parts)


def kept_order(authority: Column, dated: Column) -> list[Column]:
    """The order in which the first of equal blocks is kept: the most authority, then undated ones, then the latest date."""
    return [-authority, dated.isNotNull(), -F.unix_date(dated)]


def lexical_text(title: Column, content: Column, tags: Column, product: Column) -> Column:
    """What a record is searched by: title, content, tags and product; missing parts are left out."""
    return F.concat_ws(" ", title, content, tags, product)


def report_lists(records: DataFrame, id_column: str = "record_id") -> DataFrame:
    """Rows (list, id) of records that a build report names: with personal data, superseded, or also found elsewhere."""
    lists = F.array(
        F.when(F.size("pii_kinds") > 0, F.lit("personal_data")),
        F.when(F.col("status") == "superseded", F.lit("superseded")),
        F.when(F.size("also_found_in") > 0, F.lit("near_duplicate")),
    )
    return records.select(F.explode(F.filter(lists, lambda x: x.isNotNull())).alias("list"), id_column)
