"""Set algebra over (name, element) rows. Elements are shuffled by their own hash; a set may be any size."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def intersection(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def union(sets: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def named(sets: dict[str, DataFrame]) -> DataFrame:
    """(name, element) rows from single-column DataFrames."""
    return reduce(
        DataFrame.union,
        [df.select(F.lit(name).alias("name"), F.col(df.columns[0]).alias("element")) for name, df in sets.items()],
    )


def from_columns(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every column of a table as one set; missing cells are dropped."""
    long = table.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "name", "element"
    )
    return long.filter(F.col("element").isNotNull()).distinct()


def in_at_least(members: DataFrame, x: int) -> DataFrame:
    return members.groupBy("element").agg(F.countDistinct("name").alias("n_sets")).filter(F.col("n_sets") >= x)


def _flags(members: DataFrame, names: Sequence[str]) -> DataFrame:
    return members.groupBy("element").agg(
        *[F.bool_or(F.col("name") == n).alias(f"_in{i}") for i, n in enumerate(names)]
    )


_TOKEN = re.compile(r"\s*([()&|^-]|[A-Za-z_]\w*)")
_BINDING = {"|": 1, "^": 2, "&": 3, "-": 4}


def _condition(text: str, flag: dict[str, Column]) -> Column:
    """A membership test from a set expression over - & ^ | and brackets (- binds strongest)."""
    if _TOKEN.sub("", text).strip():
        raise ValueError(f"not a set expression: {text!r}")
    output: list[Column] = []
    stack: list[str] = []

    def reduce_top():
        op, b, a = stack.pop(), output.pop(), output.pop()
        output.append({"|": a | b, "&": a & b, "-": a & ~b, "^": a != b}[op])

    for token in _TOKEN.findall(text):
        if token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                reduce_top()
            stack.pop()
        elif token in _BINDING:
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[token]:
                reduce_top()
            stack.append(token)
        else:
            output.append(flag[token])
    while stack:
        reduce_top()
    (result,) = output
    return result


def evaluate(members: DataFrame, names: Sequence[str], expression: str) -> DataFrame:
    """Elements of an expression such as ``s1 - s2 | s3 & s4`` in one grouped pass."""
    flag = {n: F.col(f"_in{i}") for i, n in enumerate(names)}
    return _flags(members, names).filter(_condition(expression, flag)).select("element")


def regions(members: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exclusive membership regions with size and percent of the union."""
    inside = F.concat_ws("&", *[F.when(F.col(f"_in{i}"), F.lit(n)) for i, n in enumerate(names)])
    sizes = _flags(members, names).groupBy(inside.alias("region")).agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("t")).scalar()
    return sizes.withColumn("percent", F.col("size") / total * 100)


def grouped_regions(members: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Regions of several named choices of sets."""
    parts = []
    for label, names in groups.items():
        chosen = members.filter(F.col("name").isin(list(names)))
        parts.append(regions(chosen, names).withColumn("grouping", F.lit(label)))
    return reduce(DataFrame.unionByName, parts)


def hits_and_misses(detected: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union of both sides with its class: TP, FP or FN."""
    d = detected.select(*keys).distinct().withColumn("_d", F.lit(True))
    k = known.select(*keys).distinct().withColumn("_k", F.lit(True))
    return d.join(k, list(keys), "full").select(
        *keys,
        F.when(F.col("_d") & F.col("_k"), "TP").when(F.col("_d"), "FP").otherwise("FN").alias("outcome"),
    )


def plain_key(*columns: str) -> Column:
    """Lower-case variant key without the chromosome prefix."""
    return F.regexp_replace(F.lower(F.concat_ws("_", *columns)), "^chr", "")


def exclude_listed(variants: DataFrame, excluded: DataFrame, columns: Sequence[str]) -> DataFrame:
    keyed = variants.withColumn("_key", plain_key(*columns))
    gone = excluded.select(plain_key(*columns).alias("_key")).distinct()
    return keyed.join(gone, "_key", "left_anti").drop("_key")


def formatted_union(reports: Sequence[DataFrame], pattern: str, columns: Sequence[str]) -> DataFrame:
    """Distinct formatted keys of several reports."""
    keys = [df.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("key")) for df in reports]
    return reduce(DataFrame.union, keys).distinct()
