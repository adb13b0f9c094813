"""The domain tables (counts, lengths, groups, calls, intervals, ...) drawn from the given tables.

Each binding exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.plans.registry import Tables


def counts(t: Tables) -> DataFrame:
    return (
        t.lineitem.groupBy(
            F.col("l_partkey").alias("gene"),
            F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string")).alias("sample"),
        )
        .agg(F.sum("l_quantity").alias("value"))
    )


def lengths(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("gene"), (F.col("p_size") * 100).cast("long").alias("length"))


def groups(t: Tables) -> DataFrame:
    key = F.col("s_suppkey")
    return t.supplier.select(
        F.concat(F.lit("s"), (key % 8).cast("string")).alias("sample"),
        F.concat(F.lit("g"), (key % 2).cast("string")).alias("grp"),
        F.concat(F.lit("b"), F.floor(key % 4 / 2).cast("string")).alias("batch"),
    ).distinct()


def gene_terms(t: Tables) -> DataFrame:
    words = F.explode(F.split("p_name", " ")).alias("term")
    return t.part.select(F.col("p_partkey").alias("gene"), words).distinct()


COUNTS = """counts AS (
  SELECT l_partkey AS gene, 's' || CAST(l_suppkey % 8 AS VARCHAR) AS sample, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
LENGTHS = "lengths AS (SELECT p_partkey AS gene, CAST(p_size AS BIGINT) * 100 AS length FROM part)"
GROUPS = """groups AS (
  SELECT DISTINCT 's' || CAST(s_suppkey % 8 AS VARCHAR) AS sample, 'g' || CAST(s_suppkey % 2 AS VARCHAR) AS grp,
         'b' || CAST((s_suppkey % 4) // 2 AS VARCHAR) AS batch FROM supplier)"""
TERMS = """terms AS (
  SELECT DISTINCT p_partkey AS gene, unnest(string_split(p_name, ' ')) AS term FROM part)"""
