"""Kendall's tau-b between samples by counting dominance on a grid.

Every sample is cut into value ranges; a value that is a cut has a range of its own. For a pair of samples, the pairs of
genes that differ in both ranges are counted from the grid's cells with prefix sums. The others share a range in one
sample: a range between two cuts holds a bounded number of genes, so each is sorted on its own and its inversions are
counted by merging; a range of one value holds ties only. No pairs of genes are formed.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut_lineage


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """The summed products of weights over places i < j with y[i] > y[j]."""
    y, total, width = np.unique(y, return_inverse=True)[1], 0, 1
    place = np.arange(len(y))
    while width < len(y):
        block, right = place // (2 * width), place // width % 2
        order = np.lexsort((right, y, block))  # equal values: left ones first
        left = np.where(right[order] == 0, weight[order], 0)
        seen = np.cumsum(left)
        sums = np.bincount(block, weights=np.where(right == 0, weight, 0)).astype(np.int64)
        upto = np.cumsum(sums)[block[order]]
        total += int(((upto - seen) * weight[order])[right[order] == 1].sum())
        width *= 2
    return total


def _choose(n: np.ndarray) -> int:
    return int((n * (n - 1) // 2).sum())


def _ties(weight: np.ndarray, *columns: np.ndarray) -> int:
    """Pairs of rows that agree in all the columns."""
    order = np.lexsort(columns)
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[order][1:] != c[order][:-1]
    return _choose(np.add.reduceat(weight[order], np.flatnonzero(change))) if len(order) else 0


def balance(x: np.ndarray, y: np.ndarray, weight: np.ndarray, key: np.ndarray | None = None) -> int:
    """Concordant less discordant pairs; with `key`, only pairs of one key."""
    key = np.zeros(len(x), dtype=np.int64) if key is None else key
    order = np.lexsort((y, x, key))
    x, y, key, weight = x[order], y[order], key[order], weight[order]
    ranked = np.lexsort((y, key))
    level = np.empty(len(y), dtype=np.int64)
    new = np.ones(len(y), dtype=np.int64)
    new[1:] = (y[ranked][1:] != y[ranked][:-1]) | (key[ranked][1:] != key[ranked][:-1])
    level[ranked] = np.cumsum(new)  # keys one above the other, so that no inversion crosses them
    apart = _ties(weight, key) - _ties(weight, x, key) - _ties(weight, y, key) + _ties(weight, x, y, key)
    return apart - 2 * inversions(level, weight)


def _across(cells: np.ndarray) -> int:
    """Concordant less discordant pairs between cells that differ in both ranges."""
    padded = np.zeros((cells.shape[0] + 1, cells.shape[1] + 1), dtype=np.int64)
    padded[1:, 1:] = cells.cumsum(axis=0).cumsum(axis=1)
    below = padded[:-1, :-1]  # both smaller
    above = padded[:-1, -1:] - padded[:-1, 1:]  # smaller in the first, larger in the second
    return int((cells * (below - above)).sum())


def _range(value: Column, cuts: Column) -> Column:
    """Even between two cuts, odd on one. Cuts are distinct and sorted."""
    return 2 * F.size(F.filter(cuts, lambda c: c < value)) + F.array_contains(cuts, value).cast("int")


def kendall_matrix(df: DataFrame, samples: Sequence[str], strip_rows: int = 20_000) -> DataFrame:
    """(a, b, n, corr): tau-b of every ordered pair of samples over the genes both have; null where a sample is constant
    there or fewer than two genes are shared.

    df is (gene, sample, value), one row a gene and sample; null and NaN values are missing. `strip_rows` is how many genes a
    range between two cuts holds, about, and so how many meet in a task.
    """
    place = F.create_map(*[F.lit(v) for i, s in enumerate(samples) for v in (s, i)])
    kept = df.select("gene", place[F.col("sample")].alias("at"), F.col("value").cast("double").alias("v")).filter("at IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    kept = cut_lineage(kept)
    most = kept.groupBy("at").count().agg(F.max("count")).first()[0] or 0
    ranges = max(1, ceil(most / strip_rows))
    if ranges > 1:
        points = [k / ranges for k in range(1, ranges)]
        cuts = kept.groupBy("at").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", points, 100 * ranges))).alias("cuts"))
        kept = cut_lineage(kept.join(cuts, "at").select("gene", "at", "v", _range(F.col("v"), F.col("cuts")).alias("r")))
    else:
        kept = kept.withColumn("r", F.lit(0))
    one = kept.select("gene", F.col("at").alias("a"), F.col("v").alias("x"), F.col("r").alias("rx"))
    two = kept.select("gene", F.col("at").alias("b"), F.col("v").alias("y"), F.col("r").alias("ry"))
    points = one.join(two, "gene").filter("a <= b").groupBy("a", "b", "x", "y", "rx", "ry").agg(F.count("*").alias("n"))
    points = cut_lineage(points)

    def strip(side: str, other: str, less: bool):
        def counted(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, n = pdf[side].to_numpy(), pdf[other].to_numpy(), pdf["n"].to_numpy()
            found = balance(x, y, n) - (balance(x, y, n, pdf["r" + other].to_numpy().astype(np.int64)) if less else 0)
            return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "s": [found]})

        return points.filter(F.col("r" + side) % 2 == 0).groupBy("a", "b", "r" + side).applyInPandas(counted, "a int, b int, s long")

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((int(pdf["rx"].max()) + 1, int(pdf["ry"].max()) + 1), dtype=np.int64)
        cells[pdf["rx"], pdf["ry"]] = pdf["n"]
        return pd.DataFrame({"a": pdf["a"].iloc[:1], "b": pdf["b"].iloc[:1], "s": [_across(cells)]})

    # A pair's cells are (2 x ranges)^2 at most. Pairs in one cell are counted with either side's range, so once less.
    cells = points.groupBy("a", "b", "rx", "ry").agg(F.sum("n").alias("n")).groupBy("a", "b").applyInPandas(grid, "a int, b int, s long")
    s = strip("x", "y", True).union(strip("y", "x", False)).union(cells).groupBy("a", "b").agg(F.sum("s").alias("s"))

    def ties(side: str) -> DataFrame:
        per = points.groupBy("a", "b", side).agg(F.sum("n").cast("double").alias("n"))
        return per.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("t" + side))

    all_ = F.col("n") * (F.col("n") - 1) / 2
    tau = F.try_divide(F.col("s"), F.sqrt(all_ - F.col("tx")) * F.sqrt(all_ - F.col("ty")))
    half = s.join(ties("x"), ["a", "b"]).join(ties("y").drop("n"), ["a", "b"]).select(
        "a", "b", F.col("n").cast("long").alias("n"), F.when(tau.isNotNull(), F.greatest(F.lit(-1.0), F.least(tau, F.lit(1.0)))).alias("corr"))
    both = half.union(half.filter("a <> b").select("b", "a", "n", "corr"))
    label = F.array(*[F.lit(x) for x in samples])
    return both.select(F.get(label, F.col("a")).alias("a"), F.get(label, F.col("b")).alias("b"), "n", "corr")


def correlation_matrix(df: DataFrame, samples: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, n, corr) by the name of the coefficient: pearson, spearman or kendall."""
    from helixframe.operators import pairwise

    return {"pearson": pairwise.pearson_matrix, "spearman": pairwise.spearman_matrix, "kendall": kendall_matrix}[method](df, samples)
