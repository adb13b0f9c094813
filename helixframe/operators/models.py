"""Clustering, batch correction and tumour purity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import tails
from helixframe.operators.pairwise import principal_components, wide
from helixframe.session import cut_lineage


# --- clustering --------------------------------------------------------------------------

def _vectors(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Feature vectors in an order that depends on the genes alone, so that seeded starts repeat. A missing cell takes the
    mean of the gene's other cells, which moves the gene nowhere along that sample."""
    cells = [F.col(c).cast("double") for c in columns]
    there = F.filter(F.array(*cells), lambda x: x.isNotNull() & ~F.isnan(x))
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there)
    filled = matrix.withColumn("_mean", mean).filter("_mean IS NOT NULL").select(
        "gene", *[F.when(c.isNull() | F.isnan(c), F.col("_mean")).otherwise(c).alias(n) for c, n in zip(cells, columns)])
    placed = filled.repartition("gene").sortWithinPartitions("gene")
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(placed)


def cluster_genes(df: DataFrame, samples: Sequence[str], k: int, bisecting: bool = False, seed: int = 1) -> DataFrame:
    """(gene, cluster) by k-means over the samples; `bisecting` splits top down into a hierarchy cut at k."""
    features = _vectors(wide(df, "gene", "sample", "value", samples), samples)
    learner = (BisectingKMeans if bisecting else KMeans)(k=k, seed=seed)
    return learner.fit(features).transform(features).select("gene", F.col("prediction").alias("cluster"))


def cluster_samples(df: DataFrame, samples: Sequence[str], k: int, seed: int = 1) -> DataFrame:
    """(sample, cluster) by k-means on the principal components; k is capped at the number of samples."""
    scores = principal_components(df, samples)
    components = sorted({r.component for r in scores.select("component").distinct().collect()})
    table = scores.groupBy(F.col("sample").alias("gene")).pivot("component", components).agg(F.first("score"))
    model = KMeans(k=min(k, len(samples)), seed=seed).fit(_vectors(table, components))
    return model.transform(_vectors(table, components)).select(F.col("gene").alias("sample"), F.col("prediction").alias("cluster"))


def combined_clusters(df: DataFrame, samples: Sequence[str], k_genes: int, k_samples: int) -> DataFrame:
    """Long values with gene cluster and sample cluster, ready to be written per cluster."""
    genes = cluster_genes(df, samples, k_genes).withColumnRenamed("cluster", "gene_cluster")
    own = cluster_samples(df, samples, k_samples).withColumnRenamed("cluster", "sample_cluster")
    return df.join(genes, "gene").join(own, "sample")


# --- batch correction --------------------------------------------------------------------

MOST_ROUNDS = 1_000_000  # past any gene that settles; reaching it is an error


def _shrink(data: np.ndarray, g_hat, d_hat, prior, rounds: int | None, conv: float):
    """Posterior batch mean and variance per gene; without `rounds`, also the round in which a gene settles.

    Missing samples are NaN and do not count; a gene without any sample of the batch takes the prior mean.
    """
    g_bar, t2, a, b = prior
    there = ~np.isnan(data)
    n = there.sum(axis=1)
    g_hat = np.where(n > 0, g_hat, 0.0)
    g, d = np.where(n > 0, g_hat, g_bar), np.where(np.isnan(d_hat), b / (a - 1.0), d_hat)
    settled = np.zeros(len(g), dtype=int)
    i = 0
    while rounds is None or i < rounds:
        i += 1
        if i > MOST_ROUNDS:
            raise ArithmeticError(f"{int((settled == 0).sum())} genes did not settle")
        g_new = (t2 * n * g_hat + d * g_bar) / (t2 * n + d)
        d_new = (0.5 * np.where(there, (data - g_new[:, None]) ** 2, 0.0).sum(axis=1) + b) / (n / 2.0 + a - 1.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            change = np.maximum(np.abs(g_new - g) / np.abs(g), np.abs(d_new - d) / d)
        g, d = g_new, d_new
        settled[(settled == 0) & ~(change > conv)] = i
        if rounds is None and (settled > 0).all():
            break
    return g, d, settled


def correct_batches(
    df: DataFrame, samples: Sequence[str], batches: Sequence[str], covariates: np.ndarray | None = None, conv: float = 1e-4
) -> DataFrame:
    """Empirical-Bayes batch correction of (gene, sample, value); `batches` names the batch of each sample.

    The design is a small matrix on the driver (samples x batches and covariates). Genes are
    independent given the priors, so tasks standardise and shrink their own genes; only the
    priors and the number of rounds are collected. All genes run the number of rounds in which
    the slowest of them settles. A missing sample does not count for its gene: the design is fitted to the samples
    that are there. Genes without spread keep their values. Where the variances of a batch do not differ between the genes (one
    gene, or one sample in the batch), its estimates are used as they are.
    """
    names, levels = list(samples), sorted(set(batches))
    index = [[i for i, x in enumerate(batches) if x == level] for level in levels]
    own = np.zeros((len(names), len(levels)))
    for j, rows in enumerate(index):
        own[rows, j] = 1.0
    design = own if covariates is None else np.hstack([own, covariates])
    rest = design.copy()
    rest[:, : len(levels)] = 0

    full = wide(df, "gene", "sample", "value", names)
    matrix = cut_lineage(full.select("gene", *[F.col(c).cast("double").alias(c) for c in names]))

    def standardise(v: np.ndarray):
        mean, sd = np.full(v.shape, np.nan), np.ones((len(v), 1))
        patterns, which = np.unique(~np.isnan(v), axis=0, return_inverse=True)
        for k, there in enumerate(patterns):
            genes = np.flatnonzero(which.ravel() == k)
            if not there.any():
                continue
            part, seen = design[there], v[genes][:, there]
            coef = np.linalg.pinv(part.T @ part) @ part.T @ seen.T
            grand = (own[there].sum(axis=0) / there.sum()) @ coef[: len(levels)]
            pooled = ((seen - (part @ coef).T) ** 2).mean(axis=1)
            mean[genes] = grand[:, None] + (rest @ coef).T
            sd[genes, 0] = np.where(pooled > 1e-24 * np.maximum(grand**2, 1e-300), np.sqrt(pooled), np.nan)
        return (v - mean) / sd, mean, sd

    def fit(z: np.ndarray):
        g, d = [], []
        for rows in index:
            part = z[:, rows]
            n = (~np.isnan(part)).sum(axis=1)
            mean = np.where(n > 0, np.nansum(part, axis=1) / np.maximum(n, 1), np.nan)
            square = np.where(np.isnan(part), 0.0, (part - mean[:, None]) ** 2).sum(axis=1)
            g.append(mean)
            d.append(np.where(n > 1, square / np.maximum(n - 1, 1), np.nan))
        return g, d

    def estimates(batches_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_in:
            g, d = fit(standardise(pdf[names].to_numpy(dtype=float))[0])
            for j in range(len(levels)):
                yield pd.DataFrame({"batch": j, "g": g[j], "d": d[j]})

    known = matrix.mapInPandas(estimates, "batch int, g double, d double")
    g_known, d_known = (F.when(~F.isnan(c), F.col(c)) for c in ("g", "d"))
    rows = known.groupBy("batch").agg(
        F.avg(g_known).alias("gm"), F.var_pop(g_known).alias("gv"), F.avg(d_known).alias("dm"), F.var_samp(d_known).alias("dv")).collect()
    # Without spread among the variances there is nothing to shrink towards.
    priors = {r.batch: (r.gm, r.gv, (2 * r.dv + r.dm**2) / r.dv, (r.dm * r.dv + r.dm**3) / r.dv) for r in rows if r.dv}

    def rounds_needed(batches_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_in:
            z = standardise(pdf[names].to_numpy(dtype=float))[0]
            g, d = fit(z)
            for j, own_rows in enumerate(index):
                if j not in priors:
                    continue
                settled = _shrink(z[:, own_rows], g[j], d[j], priors[j], None, conv)[2]
                yield pd.DataFrame({"batch": [j], "rounds": [int(settled.max())]})

    counts = matrix.mapInPandas(rounds_needed, "batch int, rounds int").groupBy("batch").agg(F.max("rounds").alias("rounds"))
    rounds = {r.batch: r.rounds for r in counts.collect()}

    def correct(batches_in: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches_in:
            v = pdf[names].to_numpy(dtype=float)
            z, mean, sd = standardise(v)
            g, d = fit(z)
            for j, own_rows in enumerate(index):
                if j in priors:
                    g_new, d_new, _ = _shrink(z[:, own_rows], g[j], d[j], priors[j], rounds[j], conv)
                else:
                    g_new, d_new = np.where(np.isnan(g[j]), 0.0, g[j]), np.where(d[j] > 0, d[j], 1.0)
                z[:, own_rows] = (z[:, own_rows] - g_new[:, None]) / np.sqrt(d_new)[:, None]
            out = np.where(np.isnan(sd), v, z * sd + mean)
            yield pd.DataFrame(out, columns=names).assign(gene=pdf["gene"].to_numpy())[["gene", *names]]

    corrected = matrix.mapInPandas(correct, matrix.schema).unpivot(["gene"], names, "sample", "value")
    return corrected.filter(F.col("value").isNotNull() & ~F.isnan("value"))


# --- tumour purity -----------------------------------------------------------------------

PURITIES = np.arange(0.01, 1, 0.01)
# Interval level and step of the fraction range, weight and tail cutoffs.
INTERVAL, STEP, TAIL = 0.99, 0.005, 0.01


def _origins(ploidy: int, somatic_only: bool):
    """What a variant of this ploidy can come from: expected fraction by purity, the cell fraction as slope and offset of the
    observed fraction, whether it is germline, and whether that is with a loss of the other copy."""
    p = PURITIES
    total = 2 * (1 - p) + ploidy * p
    rows = [(p / (2 - p), (2 - p) / p, 0 * p, False, False)] if ploidy == 2 else []
    rows += [(c * p / total, total / (c * p), 0 * p, False, False) for c in range(1, ploidy + 1)]
    if not somatic_only:
        if ploidy == 2:
            rows.append((1 / (2 - p), (2 - p) / p, (p - 1) / p, True, True))
        rows += [((1 - p + c * p) / total, total / (c * p), (p - 1) / (c * p), True, c == ploidy) for c in range(1, ploidy + 1)]
    return [np.array(x) for x in zip(*rows)]


def _purity_profiles(
    vaf: np.ndarray, depth: np.ndarray, ploidy: int, low: np.ndarray, high: np.ndarray, somatic_only: bool, loh_cutoff: float,
    weight_cutoff: float, points: int = 2048,
) -> tuple[np.ndarray, np.ndarray]:
    """Misfit and germline flag of variants of one ploidy at every purity, over the fractions low..high of each. About
    `points` fractions are in memory at a time."""
    chance, slope, offset, germline, loh = _origins(ploidy, somatic_only)
    logs, others = np.log(chance).ravel(), np.log1p(-chance).ravel()
    counts = np.ceil((high + STEP - low) / STEP).astype(int)
    misfit, flagged = np.empty((len(vaf), len(PURITIES))), np.zeros((len(vaf), len(PURITIES)), dtype=bool)
    for rows in np.split(np.arange(len(vaf)), np.flatnonzero(np.diff(np.cumsum(counts) // points)) + 1):
        n, first = counts[rows], np.cumsum(counts[rows]) - counts[rows]
        own = np.repeat(rows, n)
        span = low[own] + (np.arange(len(own)) - np.repeat(first, n)) * (low + STEP - low)[own]
        span[first + n - 1] = high[rows]
        reads = np.round(depth[own] * span)
        power = tails.log_choose(depth[own], reads)[:, None] + reads[:, None] * logs + (depth[own] - reads)[:, None] * others
        likelihood = np.add.reduceat(np.exp(power) + np.finfo(float).tiny, first).reshape(len(rows), *chance.shape)
        weight = likelihood / likelihood.sum(axis=1, keepdims=True)
        misfit[rows] = ((vaf[rows, None, None] * slope + offset - 1) ** 2 * weight).sum(axis=1)
        if germline.any():
            flagged[rows] = (weight[:, germline].sum(axis=1) > weight_cutoff) & ~(weight[:, loh] > loh_cutoff).any(axis=1)
    return misfit, flagged


def _fraction_bounds(hits: np.ndarray, depth: np.ndarray):
    """Exact binomial interval of the allele fraction, for a whole batch at once."""
    side = (1 - INTERVAL) / 2
    low = tails.beta_quantile(side, np.maximum(hits, 0.5), depth - hits + 1)
    high = tails.beta_quantile(1 - side, hits + 1, np.maximum(depth - hits, 0.5))
    return np.where(hits == 0, 0.0, low), np.where(hits == depth, 1.0, high)


def _subclonal(hits: np.ndarray, depth: np.ndarray, ploidy: np.ndarray) -> np.ndarray:
    """Whether a clonal heterozygous variant would hardly have so few reads, per variant and purity."""
    chance = PURITIES / (2 * (1 - PURITIES) + ploidy[:, None] * PURITIES)
    return tails.binomial_cdf(hits[:, None], depth[:, None], chance) < TAIL


def tumour_purity(
    variants: DataFrame, somatic_only: bool = False, deviations: float = 2.0, loh_cutoff: float = 0.5, weight_cutoff: float = 0.7
) -> DataFrame:
    """Purity per sample in three stages: all variants, without germline ones, without subclonal ones.

    variants: (sample, id, vaf, depth, ploidy). What a variant says depends on its fraction, depth and ploidy alone, so
    variants are counted by these and each combination is worked out once. Sums per sample and purity combine on the
    map side, so one sample may hold any share. Variants without a fraction, without reads or with a ploidy below one
    take no part.
    """
    schema = "vaf double, depth long, ploidy int, misfit array<double>, germline array<boolean>, subclonal array<boolean>"
    same = ["vaf", "depth", "ploidy"]

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ploidy, part in pdf.groupby("ploidy"):
                vaf, depth = part["vaf"].to_numpy(dtype=float), part["depth"].to_numpy(dtype=float)
                hits = np.round(depth * vaf)
                low, high = _fraction_bounds(hits, depth)
                misfit, germ = _purity_profiles(vaf, depth, int(ploidy), low, high, somatic_only, loh_cutoff, weight_cutoff)
                late = _subclonal(hits, depth, np.full(len(part), float(ploidy)))
                yield part[same].assign(misfit=list(misfit), germline=list(germ), subclonal=list(late))

    kinds = [F.col("vaf").cast("double").alias("vaf"), F.col("depth").cast("long").alias("depth"), F.col("ploidy").cast("int").alias("ploidy")]
    usable = variants.select(F.col("sample").cast("string").alias("sample"), *kinds).filter("depth > 0 AND ploidy > 0 AND vaf IS NOT NULL AND NOT isnan(vaf)")
    tally = cut_lineage(usable.groupBy("sample", *same).agg(F.count("*").alias("n")))
    parts = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    worked = tally.select(*same).distinct().repartition(parts, *same).mapInPandas(profile, schema)
    profiles = cut_lineage(tally.join(worked, same).drop(*same))

    def stage(kept: DataFrame, label: str) -> DataFrame:
        sums = kept.select("sample", "n", F.posexplode("misfit").alias("at", "m")).groupBy("sample", "at").agg(
            F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum("n").alias("n")
        )
        best = sums.groupBy("sample").agg(F.min("s").alias("least"), F.min_by("at", F.struct("s", "at")).alias("best"))
        spread = F.sqrt(F.greatest(F.col("ss") / F.col("n") - (F.col("s") / F.col("n")) ** 2, F.lit(0.0)))
        inside = F.col("s") - deviations * spread < F.col("least")
        out = sums.join(best, "sample").groupBy("sample").agg(
            F.max("best").alias("best"), F.max("n").alias("n_variants"),
            F.min(F.when(inside, F.col("at"))).alias("_lo"), F.max(F.when(inside, F.col("at"))).alias("_hi"), F.count_if(inside).alias("_k"),
        )
        return out.select(
            "sample", F.lit(label).alias("stage"), "best", ((F.col("best") + 1) / 100).alias("purity"), "n_variants",
            ((F.col("_lo") + 1) / 100).alias("low"), ((F.col("_hi") + 1) / 100).alias("high"),
            (F.col("_k") < F.col("_hi") - F.col("_lo") + 1).alias("has_gap"),
        )

    one = cut_lineage(stage(profiles, "all"))
    clean = profiles.join(one.select("sample", "best"), "sample").filter(~F.get("germline", F.col("best"))).drop("best")
    two = cut_lineage(stage(clean, "no germline"))
    clonal = clean.join(two.select("sample", "best"), "sample").filter(~F.get("subclonal", F.col("best"))).drop("best")
    return one.union(two).union(stage(clonal, "no germline or subclonal")).drop("best")
