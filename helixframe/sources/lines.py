"""Text lines with their file and line number, and tables with a sniffed separator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from helixframe.functions import ordered

LINE_WIDTH = 1 << 16


def read_lines(spark: SparkSession, path) -> DataFrame:
    """(path, value) of text files, plain or compressed."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def read_numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(path, line_no, value) with line numbers from 1 within each file.

    Rows of one file split keep their order, and the row id rises by one within a split; the
    line counts of the earlier splits of a file are added.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    blocks = raw.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    earlier = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("path", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_skip"))
    return raw.join(blocks, ["path", "_block"]).select(
        "path", (F.col("_id") - F.col("_first") + F.col("_skip") + 1).alias("line_no"), "value"
    )


def file_sample(path: Column, suffix: str = ".") -> Column:
    """Sample name: the file name up to the suffix."""
    return F.substring_index(F.substring_index(path, "/", -1), suffix, 1)


def sniff_separator(line: str) -> str:
    """Most frequent of tab, comma, semicolon and bar in the header, else blank."""
    found = {sep: line.count(sep) for sep in "\t,;|"}
    best = max(found, key=found.get)
    return best if found[best] else " "


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Delimited table with header; a first column without a name is called ``index``."""
    header = spark.read.text(path).first()[0]
    sep = sniff_separator(header)
    reader = spark.read.option("sep", sep).option("header", True)
    table = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if not header.split(sep)[0].strip(' "'):
        table = table.withColumnRenamed(table.columns[0], "index")
    return table


def melt(wide: DataFrame, keys: list[str], name: str = "sample", value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, columns, name, value).filter(F.col(value).isNotNull())


def last_seen(lines: DataFrame, is_header: Column, name: str) -> DataFrame:
    """(path, line_no, value) with `name`, the number of the latest header line so far (or null)."""
    return ordered.accumulate(
        lines, ["path"], "line_no", {name: ("max", F.when(is_header, F.col("line_no")))}, width=LINE_WIDTH
    )


def field(column: Column, i: int) -> Column:
    return F.try_element_at(column, F.lit(i))


def checked(condition: Column, message: Column, value: Column, kind: str = "string") -> Column:
    """The value while the condition holds; else the job fails with the message."""
    return F.when(condition, value).otherwise(F.raise_error(message).cast(kind))
