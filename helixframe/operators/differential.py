"""Differential expression between groups of samples and its reports."""

from __future__ import annotations

from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import tails
from helixframe.operators.statistics import adjust, t_statistics
from helixframe.session import cut_lineage


def normalised(counts: DataFrame, factors: DataFrame) -> DataFrame:
    """Rounded counts over the size factor of their sample."""
    return counts.withColumn("value", F.floor(F.col("value") + 0.5)).join(factors, "sample").select(
        "gene", "sample", "value", (F.col("value") / F.col("size_factor")).alias("norm")
    )


def compare_groups(
    counts: DataFrame, factors: DataFrame, members: DataFrame, comparisons: DataFrame, least_total: float = 8
) -> DataFrame:
    """(ctrl, test, gene, log2fc, t_welch, df_welch) for every comparison at once.

    members is (grp, sample). Genes with fewer than `least_total` counts over the samples of a
    comparison are left out. The test is Welch's on log2(normalised + 1).
    """
    sides = comparisons.select("ctrl", "test", F.col("ctrl").alias("grp"), F.lit(True).alias("is_ctrl")).union(
        comparisons.select("ctrl", "test", F.col("test").alias("grp"), F.lit(False))
    )
    chosen = sides.join(members, "grp").select("ctrl", "test", "sample", "is_ctrl").distinct()
    values = normalised(counts, factors).join(chosen, "sample").withColumn("log_norm", F.log2(F.col("norm") + 1))
    keys = ["ctrl", "test", "gene"]
    totals = values.groupBy(*keys).agg(
        F.sum("value").alias("_total"),
        F.avg(F.when(F.col("is_ctrl"), F.col("norm"))).alias("_c"),
        F.avg(F.when(~F.col("is_ctrl"), F.col("norm"))).alias("_t"),
    ).filter(F.col("_total") >= least_total)
    stats = t_statistics(values, keys, "log_norm", ~F.col("is_ctrl")).select(*keys, "t_welch", "df_welch")
    fold = F.log2((F.coalesce("_t", F.lit(0.0)) + 1) / (F.coalesce("_c", F.lit(0.0)) + 1))
    return totals.select(*keys, fold.alias("log2fc")).join(stats, keys)


def dispersion_test(
    counts: DataFrame, factors: DataFrame, members: DataFrame, comparisons: DataFrame, least_total: float = 8
) -> DataFrame:
    """(ctrl, test, gene, base_mean, dispersion, fitted, final, log2fc, se, wald, pvalue): a negative-binomial Wald test.

    The dispersion of a gene is what its variance within the groups leaves beyond counting noise, over the squared mean
    (method of moments). A trend a / mean + b over the genes of a comparison is fitted by least squares; the final value
    is the mean of own and fitted, not below zero. The variance of the log fold change follows from the means and the
    final dispersion. Genes with a group of fewer than two samples or without counts in a group have no test.
    """
    sides = comparisons.select("ctrl", "test", F.col("ctrl").alias("grp"), F.lit(True).alias("is_ctrl")).union(
        comparisons.select("ctrl", "test", F.col("test").alias("grp"), F.lit(False))
    )
    chosen = sides.join(members, "grp").select("ctrl", "test", "sample", "is_ctrl").distinct()
    values = normalised(counts, factors).join(chosen, "sample").join(factors, "sample")
    keys = ["ctrl", "test", "gene"]
    c, t = F.when(F.col("is_ctrl"), F.col("norm")), F.when(~F.col("is_ctrl"), F.col("norm"))
    own = values.groupBy(*keys).agg(
        F.sum("value").alias("_total"), F.avg("norm").alias("base_mean"), F.avg(1 / F.col("size_factor")).alias("_inv"),
        F.avg(c).alias("_m1"), F.avg(t).alias("_m2"), F.var_samp(c).alias("_v1"), F.var_samp(t).alias("_v2"),
        F.count(c).alias("_n1"), F.count(t).alias("_n2"),
    ).filter((F.col("_total") >= least_total) & (F.col("_n1") > 1) & (F.col("_n2") > 1) & (F.col("_m1") > 0) & (F.col("_m2") > 0))
    n1, n2, mean = F.col("_n1").cast("double"), F.col("_n2").cast("double"), F.col("base_mean")
    pooled = ((n1 - 1) * F.col("_v1") + (n2 - 1) * F.col("_v2")) / (n1 + n2 - 2)
    own = cut_lineage(own.withColumn("dispersion", F.greatest((pooled - mean * F.col("_inv")) / (mean * mean), F.lit(0.0))))
    inverse = 1 / mean
    trend = own.groupBy("ctrl", "test").agg(
        F.coalesce(F.regr_slope(F.col("dispersion"), inverse), F.lit(0.0)).alias("_a"),
        F.avg("dispersion").alias("_d"), F.avg(inverse).alias("_i"))
    fitted = F.greatest(F.col("_d") + F.col("_a") * (inverse - F.col("_i")), F.lit(0.0))
    joined = own.join(trend, ["ctrl", "test"]).withColumn("fitted", fitted).withColumn("final", (F.col("dispersion") + F.col("fitted")) / 2)
    fold = F.log2(F.col("_m2") / F.col("_m1"))
    se = F.sqrt((F.col("_inv") / F.col("_m1") + F.col("final")) / n1 + (F.col("_inv") / F.col("_m2") + F.col("final")) / n2) / F.log(F.lit(2.0))
    out = joined.withColumn("log2fc", fold).withColumn("se", se).withColumn("wald", F.try_divide("log2fc", "se"))
    return out.select(*keys, "base_mean", "dispersion", "fitted", "final", "log2fc", "se", "wald").withColumn(
        "pvalue", F.least(tails.normal_two_sided(F.col("wald")), F.lit(1.0)))


def with_p(compared: DataFrame, method: str = "fdr_bh") -> DataFrame:
    # The comparison is read several times below, so it is computed once and kept.
    p = cut_lineage(compared.withColumn("pvalue", tails.t_two_sided(F.col("t_welch"), F.col("df_welch"))))
    tested = p.filter(F.col("pvalue").isNotNull() & ~F.isnan("pvalue"))
    untested = p.join(tested.select("ctrl", "test", "gene"), ["ctrl", "test", "gene"], "left_anti").withColumn(
        "padjust", F.lit(None).cast("double")
    )
    return adjust(tested, ["ctrl", "test"], "pvalue", method, "padjust").unionByName(untested)


def direction(fold: Column) -> Column:
    return F.when(fold == 0, "stable").when(fold > 0, "up").otherwise("down")


def report(
    genes: DataFrame, stats: DataFrame, annotation: DataFrame, fold_cutoff: float = 2, stat_cutoff: float = 0.05,
    judged_by: str = "padjust",
) -> DataFrame:
    """Every gene with fold, p, significance and direction; genes without a test say `untested`."""
    (extra,) = [c for c in annotation.columns if c != "gene"]
    one = annotation.groupBy("gene").agg(F.min(extra).alias(extra))
    fold = F.coalesce(F.when(~F.isnan("log2fc"), F.col("log2fc")), F.lit(0.0))
    tested = F.col("_tested")
    joined = genes.select("gene").distinct().join(stats.withColumn("_tested", F.lit(True)), "gene", "left").join(one, "gene", "left")
    significant = (F.abs(fold) >= log2(fold_cutoff)) & (F.col(judged_by) <= stat_cutoff)

    def shown(value: Column) -> Column:
        return F.when(tested, F.coalesce(value, F.lit("untested"))).otherwise("untested")

    return joined.select(
        "gene", F.coalesce(F.col(extra).cast("string"), F.lit("None")).alias(extra),
        shown(F.format_string("%.4f", fold)).alias("log2fc"),
        shown(F.when(F.col("pvalue").isNotNull(), F.format_string("%.6f", "pvalue"))).alias("pvalue"),
        shown(F.when(F.col("padjust").isNotNull(), F.format_string("%.6f", "padjust"))).alias("padjust"),
        F.when(tested, F.when(significant, "yes").otherwise("no")).otherwise("untested").alias("significant"),
        F.when(tested, direction(fold)).otherwise("untested").alias("regulate"),
    )


def significant_genes(stats: DataFrame, fold_cutoff: float, stat_cutoff: float, judged_by: str) -> DataFrame:
    return stats.filter((F.abs("log2fc") >= log2(fold_cutoff)) & (F.col(judged_by) <= stat_cutoff))


def summary_matrix(genes: DataFrame, significant: DataFrame, comparisons: list[str]) -> DataFrame:
    """yes or no per gene and comparison with the number of yes; significant is (gene, comparison)."""
    wide = significant.groupBy("gene").pivot("comparison", comparisons).agg(F.max(F.lit("yes")))
    out = genes.select("gene").distinct().join(wide, "gene", "left").fillna("no", comparisons)
    n = reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`") == "yes", 1).otherwise(0) for c in comparisons])
    return out.withColumn("total", n)


def summary_totals(significant: DataFrame) -> DataFrame:
    """Significant genes per comparison, and over all of them."""
    per = significant.groupBy("comparison").agg(F.countDistinct("gene").alias("n"))
    return per.union(significant.agg(F.lit("union").alias("comparison"), F.countDistinct("gene").alias("n")))
