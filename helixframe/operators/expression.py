"""Operators on the long expression form (gene, sample, value) and (gene, length).

A cell that is absent from the long form is a missing value. Sample totals are grouped
aggregates joined back, so a sample holding most of the rows still spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.session import cut_lineage

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


# --- normalisation -----------------------------------------------------------------------

def fpkm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    joined = ordered.with_totals(counts.join(lengths, "gene"), ["sample"], total=F.sum("value"))
    return joined.select("gene", "sample", (F.col("value") / F.col("length") / F.col("total") * 1e9).alias("fpkm"))


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    rate = counts.join(lengths, "gene").withColumn("rate", F.col("value") / F.col("length"))
    return ordered.with_totals(rate, ["sample"], total=F.sum("rate")).select(
        "gene", "sample", (F.col("rate") / F.col("total") * 1e6).alias("tpm")
    )


def drop_short(counts: DataFrame, lengths: DataFrame, mean_read_len: int = 149) -> DataFrame:
    """Counts with `eff_length` (length + 1) of the genes longer than a read."""
    usable = lengths.select("gene", (F.col("length") + 1).alias("eff_length")).filter(
        F.col("eff_length") > mean_read_len
    )
    return counts.join(usable, "gene")


def guarded_abundance(
    counts: DataFrame, lengths: DataFrame, mean_read_len: int = 149, dominant_share: float = 0.1, min_total: float = 10
) -> DataFrame:
    """FPKM whose denominator leaves out genes that hold a large share of their sample, and TPM.

    The TPM denominator keeps every gene. A sample whose total is at most `min_total` fails the job.
    """
    usable = drop_short(counts, lengths, mean_read_len)
    totals = usable.groupBy("sample").agg(F.sum("value").alias("total")).withColumn(
        "total",
        F.when(F.col("total") > min_total, F.col("total")).otherwise(
            F.raise_error(F.concat(F.lit("nearly no counts in sample "), F.col("sample"))).cast("double")
        ),
    )
    shared = usable.join(totals, "sample").withColumn(
        "dominant", F.when(F.col("value") / F.col("total") >= dominant_share, F.col("value")).otherwise(0.0)
    )
    denominators = shared.groupBy("sample").agg(
        (F.max("total") - F.when(F.sum("dominant") >= 1, F.sum("dominant")).otherwise(0.0)).alias("kept"),
        F.sum(F.col("value") / F.col("eff_length")).alias("rate_total"),
    )
    rate = F.col("value") / F.col("eff_length")
    return usable.join(denominators, "sample").select(
        "gene", "sample", (rate / F.col("kept") * 1e9).alias("fpkm"), (rate / F.col("rate_total") * 1e6).alias("tpm")
    )


def size_factors(counts: DataFrame, n_samples: int) -> DataFrame:
    """Median-of-ratios factors over the genes counted in every one of the samples."""
    logs = counts.filter((F.col("value") > 0) & F.col("gene").isNotNull()).select("gene", "sample", F.log("value").alias("log_value"))
    genes = logs.groupBy("gene").agg(
        F.avg("log_value").alias("centre"), F.count("*").alias("seen"), F.collect_list(F.struct("sample", "log_value")).alias("cells")
    ).filter(F.col("seen") == n_samples)
    ratios = cut_lineage(genes.select("centre", F.inline("cells")).select("sample", (F.col("log_value") - F.col("centre")).alias("ratio")))
    return ordered.quantiles(ratios, ["sample"], "ratio", {"median": 0.5}).select(
        "sample", F.exp("median").alias("size_factor")
    )


def saturation(values: DataFrame, reference: str, lower: float = 0.1) -> DataFrame:
    """Percent deviation of each fraction from the reference fraction, by quartile of the latter.

    `values` is (gene, sample, value). Strata include both their ends, so a gene on a bound
    counts in two of them.
    """
    full = values.filter((F.col("sample") == reference) & (F.col("value") >= lower)).select(
        "gene", F.col("value").alias("full")
    )
    q = ordered.quantiles(full, [], "full", {"lo": 0.0, **QUARTILES, "hi": 1.0})
    strata = q.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("stratum"), F.col(a).alias("low"), F.col(b).alias("high"))
                    for name, a, b in (
                        ("Q1", "lo", "q1"), ("Q2", "q1", "median"), ("Q3", "median", "q3"), ("Q4", "q3", "hi"),
                    )
                ]
            )
        ).alias("s")
    ).select("s.*")
    # Four rows by construction.
    placed = full.join(F.broadcast(strata), F.col("full").between(F.col("low"), F.col("high")))
    return values.join(placed, "gene").select(
        "gene", "sample", "stratum", F.abs((F.col("value") / F.col("full") - 1) * 100).alias("error")
    )


def log_values(df: DataFrame, base: str = "2", pseudo: float = 1.0) -> DataFrame:
    fn = {"2": F.log2, "10": F.log10, "e": F.log}[base]
    return df.withColumn("log_value", fn(F.col("value") + pseudo))


def zscore(df: DataFrame, by: str) -> DataFrame:
    """Centre and scale by the population deviation of each gene or sample; zero deviation counts as 1."""
    scaled = ordered.with_totals(df, [by], _mean=F.avg("value"), _sd=F.stddev_pop("value"))
    sd = F.when(F.col("_sd") < 1e-12, 1.0).otherwise(F.col("_sd"))
    return scaled.select("gene", "sample", ((F.col("value") - F.col("_mean")) / sd).alias("z"))


# --- gene filters ------------------------------------------------------------------------

def keep_expressed(df: DataFrame, cutoff: float, n_samples: int, needed: int | None = None) -> DataFrame:
    """Genes above the cutoff in at least `needed` samples (default (N - 1) div 3)."""
    needed = (n_samples - 1) // 3 if needed is None else needed
    passed = df.groupBy("gene").agg(F.count_if(F.col("value") > cutoff).alias("n")).filter(F.col("n") >= needed)
    return df.join(passed, "gene", "left_semi")


def keep_variable(
    df: DataFrame, row_sum: float, exp_cutoff: float, cv: float, n_samples: int, needed: float | None = None
) -> DataFrame:
    needed = n_samples / 3 if needed is None else needed
    stats = df.groupBy("gene").agg(
        F.sum("value").alias("total"),
        F.count_if(F.col("value") > exp_cutoff).alias("n"),
        (F.stddev_samp("value") / F.avg("value")).alias("cv"),
    )
    passed = stats.filter((F.col("total") >= row_sum) & (F.col("n") >= needed) & (F.col("cv") > cv))
    return df.join(passed, "gene", "left_semi")


def common_genes(df: DataFrame, samples: DataFrame, n_samples: int) -> DataFrame:
    """Genes with a positive value in every listed sample."""
    inside = df.join(samples, "sample", "left_semi").filter(F.col("value") > 0)
    return inside.groupBy("gene").agg(F.countDistinct("sample").alias("n")).filter(F.col("n") == n_samples).select("gene")


def clean_id(name: str) -> Column:
    """Identifier up to its first underscore and first dot."""
    return F.split(F.split(F.col(name), "_")[0], r"\.")[0]


def by_gene_list(df: DataFrame, id_col: str, targets: DataFrame, exclude: bool = False) -> DataFrame:
    keyed = df.withColumn("_id", clean_id(id_col))
    wanted = targets.select(F.col(targets.columns[0]).alias("_id")).distinct()
    return keyed.join(wanted, "_id", "left_anti" if exclude else "left_semi").drop("_id")


def density_input(df: DataFrame, least_mean: float, pseudo: float = 0.01) -> DataFrame:
    kept = df.groupBy("gene").agg(F.avg("value").alias("m")).filter(F.col("m") >= least_mean)
    return df.join(kept, "gene", "left_semi").select(
        "gene", "sample", F.log2(F.col("value") + pseudo).alias("log_value")
    )


def both_positive(df: DataFrame, reference: str) -> DataFrame:
    """(gene, sample, value, ref) where the sample and the reference are both expressed."""
    ref = df.filter(F.col("sample") == reference).select("gene", F.col("value").alias("ref"))
    return df.filter(F.col("sample") != reference).join(ref, "gene").filter(F.col("value") * F.col("ref") > 0)


# --- aggregation -------------------------------------------------------------------------

def describe(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    simple = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    return simple.join(ordered.quantiles(df, keys, value, QUARTILES).drop("n"), keys)


def rollup_to_gene(df: DataFrame, transcript_to_gene: DataFrame) -> DataFrame:
    """Sum transcript values per gene; `df` is (transcript, sample, value)."""
    return df.join(transcript_to_gene, "transcript").groupBy("gene", "sample").agg(F.sum("value").alias("value"))


def group_means(df: DataFrame, sample_groups: DataFrame) -> DataFrame:
    return df.join(sample_groups, "sample").groupBy("gene", "grp").agg(F.avg("value").alias("mean_value"))


def expressed_per_sample(df: DataFrame, threshold: float) -> DataFrame:
    return df.groupBy("sample").agg(F.count_if(F.col("value") > threshold).alias("expressed"))


# Biotype names by coarse category.
BIOTYPES = {
    "IG": ["IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_LV_gene", "IG_V_gene"],
    "TCR": ["TR_C_gene", "TR_J_gene", "TR_V_gene", "TR_D_gene"],
    "miRNA": ["miRNA"],
    "ncRNA": [
        "Mt_rRNA", "Mt_tRNA", "misc_RNA", "rRNA", "scRNA", "snRNA", "snoRNA", "ribozyme", "sRNA", "scaRNA",
        "vaultRNA",
    ],
    "lncRNA": [
        "3prime_overlapping_ncRNA", "antisense", "antisense_RNA", "bidirectional_promoter_lncRNA", "lincRNA",
        "macro_lncRNA", "non_coding", "processed_transcript", "sense_intronic", "sense_overlapping",
    ],
    "TEC": ["TEC"],
    "protein_coding": ["protein_coding"],
}


def biotype_category(detail: Column) -> Column:
    out = F.when(detail.endswith("pseudogene"), "pseudogene")
    for category, members in BIOTYPES.items():
        out = out.when(detail.isin(members), category)
    return out.otherwise("other")


def detected_by_type(df: DataFrame, gene_types: DataFrame, categories: list[str], lower: float = 2) -> DataFrame:
    """Genes at or above `lower` per sample, one column per category."""
    typed = df.filter(F.col("value") >= lower).join(gene_types, "gene")
    return typed.groupBy("sample").pivot("category", categories).count().fillna(0)


def detected_markers(df: DataFrame, markers: DataFrame, lower: float = 2) -> DataFrame:
    hits = df.filter(F.col("value") >= lower).join(markers, "gene", "left_semi")
    return df.select("sample").distinct().join(
        hits.groupBy("sample").agg(F.countDistinct("gene").alias("markers")), "sample", "left"
    ).fillna(0, ["markers"])


def metagene_score(df: DataFrame, members: DataFrame, geometric: bool = True) -> DataFrame:
    """Mean of the present members per metagene and sample; a zero makes the geometric mean 0.

    `members` is (metagene, gene). The member list is a table of its own: `metagene_members`.
    """
    joined = df.join(members.distinct(), "gene")
    mean = F.avg("value")
    if geometric:
        mean = F.when(F.min("value") <= 0, 0.0).otherwise(
            F.exp(F.avg(F.when(F.col("value") > 0, F.log("value"))))
        )
    return joined.groupBy("metagene", "sample").agg(mean.alias("score"), F.count("*").alias("n_members"))


def metagene_members(df: DataFrame, members: DataFrame) -> DataFrame:
    return members.distinct().join(df, "gene", "left_semi")


def box_stats(
    df: DataFrame, keys: list[str], value: str = "value", k: float = 1.5, small_groups: bool = False
) -> DataFrame:
    """Quartiles and whiskers; the whiskers stop at the extremes."""
    q = ordered.quantiles(df, keys, value, {"lo": 0.0, **QUARTILES, "hi": 1.0}, small_groups)
    reach = (F.col("q3") - F.col("q1")) * k
    return q.select(
        *keys, "n", "q1", "median", "q3",
        F.greatest("lo", F.col("q1") - reach).alias("lower"),
        F.least("hi", F.col("q3") + reach).alias("upper"),
    )


def box_outliers(
    df: DataFrame, keys: list[str], value: str = "value", k: float = 1.5, small_groups: bool = False
) -> DataFrame:
    box = box_stats(df, keys, value, k, small_groups).select(*keys, "lower", "upper")
    return df.join(box, keys).filter((F.col(value) > F.col("upper")) | (F.col(value) < F.col("lower")))


def outlier_samples(df: DataFrame, k: float = 2, at_least: int = 2) -> DataFrame:
    """How often each sample lies outside the k * IQR fence of a gene."""
    # A gene has at most one value per sample.
    hits = box_outliers(df, ["gene"], "value", k, small_groups=True).groupBy("sample").agg(F.count("*").alias("hits"))
    every = df.select("sample").distinct()
    return every.join(hits, "sample", "left").fillna(0, ["hits"]).withColumn("flagged", F.col("hits") >= at_least)


def against_reference(df: DataFrame, reference_samples: DataFrame, median: bool = False) -> DataFrame:
    """(gene, sample, value, ref): each other sample beside the mean or median of the reference samples."""
    inside = df.join(reference_samples, "sample", "left_semi")
    if median:
        ref = ordered.quantiles(inside, ["gene"], "value", {"ref": 0.5}, small_groups=True).drop("n")
    else:
        ref = inside.groupBy("gene").agg(F.avg("value").alias("ref"))
    return df.join(reference_samples, "sample", "left_anti").join(ref, "gene").filter(
        F.col("value") * F.col("ref") > 0
    )


def reference_agreement(df: DataFrame, reference_samples: DataFrame, median: bool = False) -> DataFrame:
    pairs = against_reference(df, reference_samples, median)
    return pairs.groupBy("sample").agg(
        F.count("*").alias("n"),
        F.corr("value", "ref").alias("corr"),
        F.avg(F.abs(F.col("value") - F.col("ref")) / F.col("ref")).alias("mean_deviation"),
    )


def capped_deviation(df: DataFrame, reference_samples: DataFrame) -> DataFrame:
    """Relative deviation from the reference, cut at Q3 + 2 IQR of its sample."""
    dev = against_reference(df, reference_samples).select(
        "gene", "sample", (F.abs(F.col("value") - F.col("ref")) / F.col("ref")).alias("deviation")
    )
    q = ordered.quantiles(dev, ["sample"], "deviation", QUARTILES).select(
        "sample", (F.col("q3") + 2 * (F.col("q3") - F.col("q1"))).alias("ceiling")
    )
    return dev.join(q, "sample").select("gene", "sample", F.least("deviation", "ceiling").alias("deviation"))


def centred_group_means(df: DataFrame, sample_groups: DataFrame) -> DataFrame:
    centred = ordered.with_totals(df, ["gene"], _mean=F.avg("value"))
    return centred.join(sample_groups, "sample").groupBy("gene", "grp").agg(
        F.avg(F.col("value") - F.col("_mean")).alias("centred_mean")
    )


def fraction_table(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Wide sums with their row total, for stacked shares."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.sum(value)).fillna(0)
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c)
    return wide.withColumn("row_total", total)


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    """Group sizes beside their mean."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    return sizes.withColumn("mean_n", sizes.agg(F.avg("n").alias("m")).scalar())


# --- ranks and shares --------------------------------------------------------------------

def top_ranked(df: DataFrame, top: float, in_samples: float, n_genes: int, n_samples: int) -> DataFrame:
    """Genes whose descending average rank is within `top` in at least `in_samples` samples.

    Values of at most 1 are shares of all genes or samples, rounded down.
    """
    top = int(n_genes * top) if top <= 1 else int(top)
    in_samples = int(n_samples * in_samples) if in_samples <= 1 else int(in_samples)
    alive = df.groupBy("gene").agg(F.sum("value").alias("t")).filter(F.col("t") > 0)
    ranked = ordered.average_rank(df.join(alive, "gene", "left_semi"), ["sample"], "value", "rank", descending=True)
    return (
        ranked.groupBy("gene")
        .agg(F.count_if(F.col("rank") <= top).alias("n_top"))
        .filter(F.col("n_top") >= in_samples)
    )


def top_share(df: DataFrame, top: int) -> DataFrame:
    """The leading genes of each sample with their share of its total."""
    # Spark keeps only `top` rows per sample and task before the shuffle (window group limit).
    place = F.row_number().over(W.partitionBy("sample").orderBy(F.desc("value"), "gene"))
    leading = df.withColumn("place", place).filter(F.col("place") <= top)
    totals = df.groupBy("sample").agg(F.sum("value").alias("total"))
    return leading.join(totals, "sample").select(
        "sample", "gene", "place", (F.col("value") / F.col("total")).alias("share")
    )


def top_by_mean(df: DataFrame, k: int) -> DataFrame:
    return df.groupBy("gene").agg(F.avg("value").alias("mean_value")).orderBy(F.desc("mean_value"), "gene").limit(k)


def length_histogram(df: DataFrame, text: str, ratio_limit: float = 0.999) -> DataFrame:
    """Lengths by falling frequency with share, running share and whether the plot shows them."""
    hist = df.groupBy(F.length(text).cast("long").alias("length")).agg(F.count("*").alias("number"))
    total = hist.agg(F.sum("number").alias("t")).scalar()
    # One row per distinct length, so this order is over no more rows than the longest text has letters.
    by_size = W.partitionBy(F.lit(0)).orderBy(F.desc("number"), "length")
    run = hist.select(
        "length", "number",
        F.sum("number").over(by_size.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("running"),
        F.row_number().over(by_size).cast("long").alias("rank"),
    )
    return run.select(
        "length", "number", "rank",
        (F.col("number") / total).alias("ratio"),
        (F.col("running") / total).alias("cum_ratio"),
        ((F.col("running") - F.col("number")) / total < ratio_limit).alias("shown"),
    )


def components_to_explain(df: DataFrame, keys: list[str], share_goal: float) -> DataFrame:
    """Leading values of each key until their running share reaches the goal (at least two kept)."""
    placed = ordered.tie_counts(df, keys, "value", descending=True)
    weighted = ordered.accumulate(
        placed, keys, "value",
        {"running": ("sum", F.col("value") * F.col("ties"))}, descending=True,
    )
    totals = df.groupBy(*keys).agg(F.sum("value").alias("total"))
    joined = weighted.join(totals, keys)
    reached = joined.filter(F.col("running") >= share_goal * F.col("total"))
    return reached.groupBy(*keys).agg(F.greatest(F.min("upto"), F.lit(2)).alias("n_components"))


# --- microsatellites ---------------------------------------------------------------------

def repeat_instability(reads: DataFrame, sites: DataFrame, min_reads: int = 30) -> DataFrame:
    """Instability call per site from repeat counts per read.

    `reads` is (site, repeats), `sites` is (site, expected). Counts seen no more often than
    one percent of the reads plus one are noise.
    """
    seen = reads.groupBy("site", "repeats").agg(F.count("*").alias("n"))
    seen = ordered.with_totals(seen, ["site"], all_reads=F.sum("n"))
    kept = seen.filter(F.col("n") > F.floor(F.col("all_reads") * 0.01) + 1).join(sites, "site")
    n, r = F.col("n"), F.col("repeats")

    def share(cond: Column) -> Column:
        return F.sum(F.when(cond, n).otherwise(0)) / F.sum(n)

    stats = kept.groupBy("site").agg(
        F.sum("n").alias("reads"),
        share(r != F.col("expected")).alias("alt"),
        (share(r > F.col("expected")) + 1e-3).alias("ins"),
        share(r < F.col("expected")).alias("dele"),
        (F.sum(r * n) / F.sum(n)).alias("mean_len"),
        F.sum(r * n).alias("_s"), F.sum(r * r * n).alias("_ss"),
        # Repeat counts are small numbers, so a site has few distinct ones.
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(r.cast("string"), 4, "0"), n.cast("string")))), ","
        ).alias("distribution"),
    )
    threshold = (
        F.when((F.col("alt") > 0.1) & (F.col("alt") <= 0.13), 2.0)
        .when((F.col("alt") > 0.13) & (F.col("alt") <= 0.2), 1.8)
        .otherwise(1.5)
    )
    bias = F.round(F.col("dele") / F.col("ins"), 2)
    var = (F.col("_ss") - F.col("_s") * F.col("_s") / F.col("reads")) / (F.col("reads") - 1)
    return stats.filter(F.col("reads") > min_reads).select(
        "site", "reads", "alt", "mean_len", "distribution", bias.alias("bias"),
        F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd_len"),
        F.when((bias >= threshold) & (F.col("alt") >= 0.1), "yes").otherwise("no").alias("unstable"),
    )


def instability_status(stats: DataFrame, cutoff: float = 0.2) -> DataFrame:
    rate = F.avg(F.when(F.col("unstable") == "yes", 1.0).otherwise(0.0))
    return stats.agg(
        F.count_if(F.col("unstable") == "yes").alias("unstable_sites"),
        F.count("*").alias("all_sites"),
        F.when(F.round(rate, 2) >= cutoff, "MSI:High").otherwise("MSI:Stable").alias("status"),
    )

