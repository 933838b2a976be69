"""Named queries and the SQL each is held against.

A query takes (spark, sf_dir) and gives a DataFrame over whole tables. Modules register theirs with @query when imported.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL that gives the same rows where SQL can."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import build_queries, call_queries, knowledge_queries, more_queries, personal_queries, release_queries, retrieval_queries, rule_queries, store_queries, stream_queries, text_queries  # noqa: E402, F401
