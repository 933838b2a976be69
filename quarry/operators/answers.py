"""Answers to searches: citations, sources, extractive text, cells of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_marks(answer: Column) -> Column:
    """Numbers in [n] marks, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("int"))


def valid_marks(marks: Column, n_sources: Column) -> Column:
    """Marks that name one of the sources."""
    return F.filter(marks, lambda n: n.between(1, n_sources))


def citation(record_id: Column, title: Column, uri: Column, section: Column, page: Column) -> Column:
    """`[id] title — file p.N › section`, without what is null."""
    file = F.substring_index(uri, "/", -1)
    return F.concat(F.lit("["), record_id, F.lit("] "), title, F.lit(" — "), file, F.coalesce(F.concat(F.lit(" p."), page.cast("string")), F.lit("")), F.coalesce(F.concat(F.lit(" › "), section), F.lit("")))


def relevance(score: Column) -> Column:
    """A similarity as a whole percentage."""
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)) * 100).cast("int")


def terms_found(text: Column, terms: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def table_cell(text: Column, most: int) -> Column:
    """Text for a table cell: cut with an ellipsis, pipes escaped."""
    return F.replace(F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text), F.lit("|"), F.lit("\\|"))
