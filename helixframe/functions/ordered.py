"""Ordered computations (ranks, running totals, exact quantiles) that survive hot groups.

A window ordered over a whole group puts that group into one task. Here each group is first
reduced to its distinct values with counts, then cut into value ranges at quantile points, so
that one task sorts one range. There are several ranges for each shuffle partition of the session, which
grows with the cluster and its data. The totals of the ranges are
accumulated on their own and joined back. The range of a row depends on its value alone, so a
recomputed task places it in the same range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

LEAST_FAN = 32
RANGES_PER_PARTITION = 8


def with_value_range(df: DataFrame, value: str) -> DataFrame:
    """Add `_range`, the value range a row falls into; it never decreases as the value grows."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fan = max(LEAST_FAN, ceil(sqrt(RANGES_PER_PARTITION * partitions)))
    ranges = fan * fan
    # One text literal that Spark folds; as many literals as ranges would slow the planner down.
    text = ",".join(str(i / ranges) for i in range(1, ranges))
    points = F.split(F.lit(text), ",").cast("array<double>")
    cuts = df.agg(F.percentile_approx(value, points, 10 * ranges).alias("cuts")).scalar()
    v, c = F.col(value), F.col("_cuts")
    outer = F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda i: F.get(c, i * fan - 1))
    inner = F.slice(c, F.col("_coarse") * fan + 1, fan - 1)
    return (
        df.withColumn("_cuts", cuts)
        .withColumn("_coarse", F.size(F.filter(outer, lambda x: x <= v)))
        # Never null: else a join by ranges has Spark test each row for a range, also the rows below an aggregate.
        .withColumn("_range", F.coalesce(F.col("_coarse") * fan + F.size(F.filter(inner, lambda x: x <= v)), F.lit(0)))
        .drop("_cuts", "_coarse")
    )


_FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def _join(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.coalesce(before, F.lit(0)) + here
    return F.least(before, here) if kind == "min" else F.greatest(before, here)


def accumulate(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    folds: Mapping[str, tuple[str, Column]],
    descending: bool = False,
    width: int | None = None,
) -> DataFrame:
    """Running sum, min or max in the order of `value`, inclusive, within `keys`.

    `df` must hold one row per (keys, value). `folds` maps an output column to
    (kind, input expression). Integer positions may be cut into ranges of a fixed `width`
    instead of quantile ranges, which saves the quantile pass.
    """
    keys = list(keys)
    staged = df.filter(F.col(value).isNotNull())
    for name, (_, expr) in folds.items():
        staged = staged.withColumn(f"_in_{name}", expr)
    if width:
        staged = staged.withColumn("_range", F.floor(F.col(value) / width))
    else:
        staged = with_value_range(staged, value)

    def order(name: str) -> Column:
        return F.col(name).desc() if descending else F.col(name).asc()

    per_range = staged.groupBy(*keys, "_range").agg(
        *[_FOLD[kind](f"_in_{n}").alias(f"_tot_{n}") for n, (kind, _) in folds.items()]
    )
    earlier = (
        W.partitionBy(*(keys or [F.lit(0)])).orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = per_range.select(
        *keys,
        "_range",
        *[_FOLD[kind](f"_tot_{n}").over(earlier).alias(f"_pre_{n}") for n, (kind, _) in folds.items()],
    )
    inside = (
        W.partitionBy(*keys, "_range").orderBy(order(value)).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = staged.select(
        *df.columns,
        "_range",
        *[_FOLD[kind](f"_in_{n}").over(inside).alias(f"_loc_{n}") for n, (kind, _) in folds.items()],
    )
    return local.join(offsets, [*keys, "_range"]).select(
        *df.columns,
        *[
            _join(kind, F.col(f"_pre_{n}"), F.col(f"_loc_{n}")).alias(n)
            for n, (kind, _) in folds.items()
        ],
    )


def tie_counts(
    df: DataFrame, keys: Sequence[str], value: str, descending: bool = False, small_groups: bool = False, width: int | None = None,
    **extra: Column,
) -> DataFrame:
    """(keys, value) -> `ties` rows with that value, `upto` rows up to it, `dense` its place.

    `extra` are further aggregates per distinct value. `small_groups` is for groups of a known
    bounded size, where a plain window does. `width` is that of `accumulate`.
    """
    distinct = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("ties"), *[c.alias(n) for n, c in extra.items()]
    )
    if small_groups:
        w = W.partitionBy(*keys).orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(
            W.unboundedPreceding, W.currentRow
        )
        return distinct.withColumn("upto", F.sum("ties").over(w)).withColumn("dense", F.row_number().over(w).cast("long"))
    return accumulate(
        distinct,
        keys,
        value,
        {"upto": ("sum", F.col("ties")), "dense": ("sum", F.lit(1).cast("long"))},
        descending,
        width,
    )


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", descending: bool = False
) -> DataFrame:
    """Every row with its rank within `keys`; equal values share the mean of their places."""
    ranks = tie_counts(df, keys, value, descending).select(
        *keys, value, (F.col("upto") - (F.col("ties") - 1) / 2).alias(name)
    )
    return df.join(ranks, [*keys, value])


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, points: Mapping[str, float], small_groups: bool = False
) -> DataFrame:
    """Exact linearly interpolated quantiles per `keys`, with count `n`.

    `small_groups` is for groups whose size has a known bound (values of one gene over the
    samples): there the built-in exact percentile needs one shuffle only.
    """
    if small_groups:
        return df.groupBy(*keys).agg(
            F.count(value).alias("n"), *[F.percentile(value, float(q)).alias(n) for n, q in points.items()]
        )
    # Only value ranges that hold a wanted place are put in order.
    keys = list(keys)
    staged = with_value_range(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("ties")), value)
    group = W.partitionBy(*(keys or [F.lit(0)]))
    counted = staged.groupBy(*keys, "_range").agg(F.sum("ties").alias("_held")).select(
        *keys, "_range", "_held", F.sum("_held").over(group).alias("n"),
        F.sum("_held").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)).alias("_upto"))
    wanted = F.lit(False)
    for q in points.values():
        for place in (F.floor((F.col("n") - 1) * F.lit(float(q))), F.ceil((F.col("n") - 1) * F.lit(float(q)))):
            wanted = wanted | ((F.col("_upto") - F.col("_held") <= place) & (place < F.col("_upto")))
    chosen = counted.filter(wanted).select(*keys, "_range", "n", (F.col("_upto") - F.col("_held")).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = staged.join(chosen, [*keys, "_range"]).withColumn("upto", F.col("_before") + F.sum("ties").over(inside))
    aggs = [F.max("n").alias("n")]
    for name, q in points.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        for tag, place in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            covers = (F.col("upto") - F.col("ties") <= place) & (place < F.col("upto"))
            aggs.append(F.max(F.when(covers, F.col(value).cast("double"))).alias(f"_{tag}_{name}"))
    picked = placed.groupBy(*keys).agg(*aggs)
    out = []
    for name, q in points.items():
        h = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return picked.select(*keys, "n", *out)


def number_rows(df: DataFrame, unique_order: str, name: str = "row_no") -> DataFrame:
    """Consecutive numbers from 1 in the order of a column without duplicates."""
    return accumulate(df, [], unique_order, {name: ("sum", F.lit(1).cast("long"))})


def with_totals(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Attach per-group aggregates. A grouped aggregate and a join, not a window: the aggregate
    combines on the map side, and the join is split (or broadcast) by Spark from real sizes."""
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, list(keys))
