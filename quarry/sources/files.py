"""Files as rows: tables of strings, JSON lines, runs and their labels, recorded calls, rate tables, rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def string_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with every cell a trimmed string: nothing is inferred, blanks stay empty, rows of blanks alone are left out."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', emptyValue="", nullValue="\u0000")
    rows = rows.toDF(*[c.strip() for c in rows.columns])
    trimmed = rows.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c) for c in rows.columns])
    return trimmed.where(F.concat(*[F.col(f"`{c}`") for c in trimmed.columns]) != "")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a path, of a declared schema: blank lines are passed over, what doesn't parse is null; no file gives no rows."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found)
    if files is None or not len(files):
        return spark.createDataFrame([], schema).withColumn("file", F.lit(None).cast("string"))
    return spark.read.schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))


def with_labels(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Runs joined with labels by name; live runs are named after what they replay."""
    return runs.withColumn("name", F.regexp_replace("run", "^live-", "")).join(labels, "name", "left")


def recorded_calls(spark: SparkSession, path: str, schema: str, fields: list[str]) -> DataFrame:
    """Chosen fields of one JSON document for each call, the latest folder first."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    return rows.orderBy(F.desc("file")).select(*fields)


def rates(rows: DataFrame, keys: list[str], value: str, flagged: DataFrame | None = None) -> DataFrame:
    """A rate table with numbers for values: null where a cell is blank or its key is flagged."""
    out = rows.withColumn(value, F.regexp_replace(value, ",", "").try_cast("double"))
    if flagged is None:
        return out
    marks = flagged.select(*keys).distinct().withColumn("_flagged", F.lit(True))
    return out.join(marks, keys, "left").withColumn(value, F.when(F.col("_flagged").isNull(), F.col(value))).drop("_flagged")


def cells(rows: DataFrame, key: str, pos: str, values: str) -> DataFrame:
    """Table rows (key, pos, array of strings) keyed by their first row: a blank header is named by its place, short rows are filled up.

    A table of one row has no header and gives its text as a paragraph.
    """
    first = rows.groupBy(key).agg(F.min_by(values, pos).alias("_header"), F.count("*").alias("_n"), F.min(pos).alias("_first"))
    names = F.transform("_header", lambda h, i: F.when(F.trim(h) == "", F.concat(F.lit("col"), (i + 1).cast("string"))).otherwise(F.trim(h)))
    filled = F.transform(F.sequence(F.lit(1), F.size("_header")), lambda i: F.coalesce(F.get(F.col(values), i - 1), F.lit("")))
    joined = rows.join(first, key).where((F.col("_n") == 1) | (F.col(pos) > F.col("_first")))
    table = F.when(F.col("_n") > 1, F.arrays_zip(names.alias("k"), filled.alias("v")))
    text = F.when(F.col("_n") == 1, F.array_join(values, " ")).otherwise(F.array_join(F.zip_with(names, filled, lambda k, v: F.concat(k, F.lit(": "), v)), "; "))
    return joined.select(key, pos, F.when(F.col("_n") == 1, "paragraph").otherwise("table_row").alias("kind"), table.alias("cells"), text.alias("text"))


def rule_file(path: str) -> dict:
    """A YAML rule file; `extends` names one beside it, whose lists are lengthened and whose tables are overlaid."""
    import os

    import yaml

    with open(path, encoding="utf-8") as f:
        own = yaml.safe_load(f) or {}
    base = own.pop("extends", None)
    return merged(rule_file(os.path.join(os.path.dirname(path), base)), own) if base else own


def merged(base: dict, own: dict) -> dict:
    out = dict(base)
    for k, v in own.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else [*out[k], *v] if isinstance(v, list) and isinstance(out.get(k), list) else v
    return out


EVENT = T.StructType([T.StructField("type", T.StringType()), T.StructField("at", T.DoubleType()), T.StructField("room", T.StringType()), T.StructField("body", T.StringType())])
