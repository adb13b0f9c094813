"""Negative-binomial models of counts, one for each gene and comparison.

A gene's counts of a comparison (bounded by the samples) are one row of arrays. Rows are fitted side by side in batches: the
coefficients by iteratively reweighted least squares, the dispersion at the largest adjusted profile likelihood. The trend of
the dispersions, their spread around it and the width of the fold changes are sums and quantiles over all genes; they pull the
final dispersions and the shrunken fold changes towards what is common. A group without counts has no finite fold change, but
its gene keeps its place: the likelihood-ratio test needs none, and the shrunken fold change is finite.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ordered, tails
from helixframe.operators.differential import normalised
from helixframe.session import cut_lineage

KEYS = ["ctrl", "test", "gene"]
#: Keeps the coefficient of a group without counts finite.
RIDGE = 1e-6
LEAST_DISPERSION = 1e-8
#: Own dispersions that far above the trend (in spreads of their logarithms) are not pulled down.
OUTLIER = 2.0
LEAST_SPREAD = 0.25
NORMAL_95 = 1.959963984540054
#: Rows whose dispersions are looked for side by side.
SLICE = 256


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers: Stirling's series from 8 on."""
    shift = x.copy()
    for k in range(1, 8):
        shift *= x + k
    z = x + 8
    two = z * z  # whole powers by products; a general power takes most of the time
    three = two * z
    five = three * two
    series = 1 / (12 * z) - 1 / (360 * three) + 1 / (1260 * five) - 1 / (1680 * (five * two))
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(shift)


def trigamma(x: float) -> float:
    total = 0.0
    while x < 8:
        total, x = total + 1 / x**2, x + 1
    return total + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7)


def log_likelihood(y: np.ndarray, mu: np.ndarray, alpha: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Of each row of counts; `alpha` is a column."""
    size = 1 / alpha
    each = log_gamma(y + size) - log_gamma(size) - log_gamma(y + 1) + y * np.log(mu) - y * np.log(size + mu) - size * np.log1p(alpha * mu)
    return np.where(there, each, 0.0).sum(axis=-1)


def fit(y: np.ndarray, factor: np.ndarray, x: np.ndarray, there: np.ndarray, alpha: np.ndarray, ridge: np.ndarray, two: bool = True, rounds: int = 200):
    """(beta, mu, information): coefficients by reweighted least squares on the log scale, with a ridge for each of the two.

    Every round solves two weighted equations for a row; steps are halved while they would lower the penalised likelihood.
    With `two` false the second coefficient stays at zero.
    """
    there = there.astype(float)
    offset, a = np.log(factor), alpha[:, None]
    start = np.log(np.maximum((y * there / factor).sum(axis=1) / np.maximum(there.sum(axis=1), 1), 1e-8))
    beta = np.stack([start, np.zeros_like(start)], axis=1)

    def mean(b: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(b[:, :1] + b[:, 1:] * x + offset, -40, 40))

    def target(b: np.ndarray) -> np.ndarray:
        m = mean(b)
        return (there * (y * np.log(m) - (y + 1 / a) * np.log1p(a * m))).sum(axis=1) - 0.5 * (ridge * b * b).sum(axis=1)

    def information(b: np.ndarray) -> np.ndarray:
        m = mean(b)
        w = there * m / (1 + a * m)
        out = np.empty((len(y), 2, 2))
        out[:, 0, 0], out[:, 1, 1] = w.sum(axis=1), (w * x * x).sum(axis=1)
        out[:, 0, 1] = out[:, 1, 0] = (w * x).sum(axis=1)
        return out

    best = target(beta)
    for _ in range(rounds):
        m = mean(beta)
        rest = there * (y - m) / (1 + a * m)
        slope = np.stack([rest.sum(axis=1), (rest * x).sum(axis=1)], axis=1) - ridge * beta
        h = information(beta)
        h[:, 0, 0] += ridge[:, 0]
        h[:, 1, 1] += ridge[:, 1]
        if not two:
            slope[:, 1], h[:, 0, 1], h[:, 1, 0], h[:, 1, 1] = 0, 0, 0, 1
        det = np.maximum(h[:, 0, 0] * h[:, 1, 1] - h[:, 0, 1] ** 2, 1e-300)
        step = np.stack([h[:, 1, 1] * slope[:, 0] - h[:, 0, 1] * slope[:, 1], h[:, 0, 0] * slope[:, 1] - h[:, 0, 1] * slope[:, 0]], axis=1) / det[:, None]
        step = np.clip(step, -5, 5)
        for _ in range(30):
            new = target(beta + step)
            worse = new < best - 1e-9 * np.abs(best)
            if not worse.any():
                break
            step[worse] /= 2
        beta, best = beta + step, np.maximum(new, best)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    return beta, mean(beta), information(beta)


def profile(y: np.ndarray, mu: np.ndarray, x: np.ndarray, there: np.ndarray, log_alpha: np.ndarray) -> np.ndarray:
    """The adjusted profile log likelihood at (rows, points) of log dispersions; means as they are."""
    alpha = np.exp(log_alpha)[:, :, None]
    found = log_likelihood(y[:, None, :], mu[:, None, :], alpha, there[:, None, :])
    w = there[:, None, :] * mu[:, None, :] / (1 + alpha * mu[:, None, :])
    one, both = w.sum(axis=2), (w * x[:, None, :]).sum(axis=2)
    return found - 0.5 * np.log(np.maximum(one * (w * x[:, None, :] ** 2).sum(axis=2) - both**2, 1e-300))


def best_dispersion(y, mu, x, there, centre: np.ndarray | None = None, spread: np.ndarray | None = None, points: int = 21, zooms: int = 6) -> np.ndarray:
    """The dispersion of the largest adjusted profile likelihood, with a log-normal prior if there is a centre.

    Rows stand alone; they go in slices whose points stay near the processor.
    """
    n = len(y)
    if n > SLICE:
        cut = [None if v is None else [v[lo:lo + SLICE] for lo in range(0, n, SLICE)] for v in (y, mu, x, there, centre, spread)]
        return np.concatenate([best_dispersion(*[None if v is None else v[k] for v in cut], points, zooms) for k in range(len(cut[0]))])
    low, high = np.full(n, math.log(LEAST_DISPERSION)), np.log(np.maximum(10.0, there.sum(axis=1)))
    floor, top = low, high
    for _ in range(zooms):
        at = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, points)
        value = profile(y, mu, x, there, at)
        if centre is not None:
            value = value - (at - np.log(centre)[:, None]) ** 2 / (2 * spread[:, None])
        k = value.argmax(axis=1)
        best, gap = at[np.arange(n), k], (high - low) / (points - 1)
        low, high = np.maximum(best - gap, floor), np.minimum(best + gap, top)
    return np.exp(best)


def _padded(pdf: pd.DataFrame):
    """Counts, factors, the side of the comparison and what is there, as (rows, samples)."""
    width = max((len(v) for v in pdf["counts"]), default=0)
    shape = (len(pdf), width)
    y, f, x, there = np.zeros(shape), np.ones(shape), np.zeros(shape), np.zeros(shape, dtype=bool)
    for k, (a, b, c) in enumerate(zip(pdf["counts"], pdf["factors"], pdf["sides"])):
        y[k, :len(a)], f[k, :len(a)], x[k, :len(a)], there[k, :len(a)] = a, b, c, True
    return y, f, x, there


def _mapped(rows: DataFrame, columns: list[str], added: str, work: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """The rows with further columns that a batch computes at once."""
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in columns) + ", " + added

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                for lo in range(0, len(pdf), 2000):
                    part = pdf.iloc[lo:lo + 2000].reset_index(drop=True)
                    yield pd.concat([part[columns], work(part)], axis=1)

    return cut_lineage(rows.mapInPandas(run, schema))


def _trend(own: DataFrame, most: int = 100) -> DataFrame:
    """(ctrl, test, a0, a1) of the trend a1 / mean + a0: gamma regression, each round weighted by the last fit. Dispersions at the
    floor or far from the fit (below 1e-4 or above 15 times it) do not count; where a coefficient is not positive, the
    trend is the mean."""
    used = cut_lineage(own.filter(F.col("own") > 100 * LEAST_DISPERSION).select("ctrl", "test", "base_mean", "own"))  # each round reads it
    now = {(r.ctrl, r.test): (r.m or 0.1, 0.0, False) for r in own.groupBy("ctrl", "test").agg(F.avg(F.when(F.col("own") > 100 * LEAST_DISPERSION, F.col("own"))).alias("m")).collect()}
    spark = own.sparkSession
    for turn in range(most):
        table = spark.createDataFrame([(c, t, a0, a1) for (c, t), (a0, a1, _) in now.items()], "ctrl string, test string, a0 double, a1 double")
        i, fitted, y = 1 / F.col("base_mean"), F.col("a0") + F.col("a1") / F.col("base_mean"), F.col("own")
        w = 1 / (fitted * fitted)
        ratio = y / fitted
        near = used.join(F.broadcast(table), ["ctrl", "test"])  # one row a comparison
        near = near.filter((ratio > 1e-4) & (ratio < 15)) if turn else near
        sums = near.groupBy("ctrl", "test").agg(*[F.sum(e).alias(n) for n, e in (("w", w), ("wi", w * i), ("wii", w * i * i), ("wy", w * y), ("wiy", w * i * y), ("y", y), ("n", F.lit(1.0)))]).collect()
        moved = False
        for r in sums:
            key = (r.ctrl, r.test)
            a0, a1, fixed = now[key]
            det = r.w * r.wii - r.wi**2
            if fixed:
                continue
            new = ((r.wii * r.wy - r.wi * r.wiy) / det, (r.w * r.wiy - r.wi * r.wy) / det) if det > 1e-12 * r.w * r.wii else (0.0, 0.0)
            if min(new) <= 0:
                now[key] = (r.y / r.n, 0.0, True)
                moved = True
                continue
            moved |= abs(math.log(new[0] / a0)) > 1e-6 or a1 <= 0 or abs(math.log(new[1] / a1)) > 1e-6
            now[key] = (*new, False)
        if not moved:
            break
    return spark.createDataFrame([(c, t, a0, a1) for (c, t), (a0, a1, _) in now.items()], "ctrl string, test string, a0 double, a1 double")


def count_model(counts: DataFrame, factors: DataFrame, members: DataFrame, comparisons: DataFrame, least_total: float = 8) -> DataFrame:
    """(ctrl, test, gene, base_mean, own, trend, dispersion, intercept, coefficient, log2fc, log2fc_shrunken, se, wald, p_wald, lrt, p_lrt).

    counts (gene, sample, value), factors (sample, size_factor), members (grp, sample), comparisons (ctrl, test). In the result is
    every gene with at least `least_total` counts over a comparison's samples, one sample of each group and three in all; a sample
    without a row does not count. `intercept` and `coefficient` solve the score equations on the log scale; `log2fc` is the coefficient in
    powers of two, with no limit but the ridge where a group has no counts. The shrunken fold change has a normal prior whose 95th
    percentile is that of the fold changes of genes with counts in both groups; se and Wald statistic belong to it. The
    likelihood ratio compares with equal groups. Several rows of a gene and sample are added up.
    """
    counts = counts.groupBy("gene", "sample").agg(F.sum("value").alias("value"))
    factors = cut_lineage(factors)  # one row a sample, read twice
    sides = comparisons.select("ctrl", "test", F.col("ctrl").alias("grp"), F.lit(0.0).alias("side")).union(comparisons.select("ctrl", "test", F.col("test").alias("grp"), F.lit(1.0)))
    chosen = sides.join(members, "grp").select("ctrl", "test", "sample", "side").distinct()
    values = normalised(counts, factors).join(chosen, "sample").join(factors, "sample")
    cells = F.sort_array(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value"), F.col("size_factor").cast("double").alias("factor"), "side")))
    rows = values.groupBy(*KEYS).agg(cells.alias("cells"), F.sum("value").alias("total"), F.avg("norm").alias("base_mean")).filter(
        (F.col("total") >= least_total) & (F.size("cells") > 2) & F.exists("cells", lambda c: c["side"] == 0) & F.exists("cells", lambda c: c["side"] == 1))
    parts = [F.col(f"cells.{n}").alias(a) for n, a in (("value", "counts"), ("factor", "factors"), ("side", "sides"))]
    rows = rows.select(*KEYS, "base_mean", *parts)
    base = [*KEYS, "base_mean", "counts", "factors", "sides"]

    def gene_wise(pdf: pd.DataFrame) -> pd.DataFrame:
        y, f, x, there = _padded(pdf)
        n = there.sum(axis=1)
        norm = np.where(there, y / f, 0.0)
        mean = norm.sum(axis=1) / n
        variance = (np.where(there, norm - mean[:, None], 0.0) ** 2).sum(axis=1) / np.maximum(n - 1, 1)
        noise = mean * np.where(there, 1 / f, 0.0).sum(axis=1) / n
        rough = np.clip((variance - noise) / np.maximum(mean**2, 1e-300), LEAST_DISPERSION, 10.0)
        mu = np.maximum(fit(y, f, x, there, rough, np.full((len(y), 2), RIDGE))[1], 1e-6)
        return pd.DataFrame({"own": best_dispersion(y, mu, x, there)})

    own = _mapped(rows, base, "own double", gene_wise)
    trend = _trend(own)
    placed = own.join(F.broadcast(trend), ["ctrl", "test"]).withColumn("trend", F.col("a0") + F.col("a1") / F.col("base_mean")).drop("a0", "a1")
    gap = F.log("own") - F.log("trend")
    spread_of = cut_lineage(placed.filter(F.col("own") > 100 * LEAST_DISPERSION).select("ctrl", "test", gap.alias("gap")))
    middle = ordered.quantiles(spread_of, ["ctrl", "test"], "gap", {"middle": 0.5}).drop("n")
    mad = ordered.quantiles(spread_of.join(middle, ["ctrl", "test"]).withColumn("off", F.abs(F.col("gap") - F.col("middle"))), ["ctrl", "test"], "off", {"mad": 0.5}).drop("n")
    samples = placed.groupBy("ctrl", "test").agg(F.max(F.size("counts")).alias("samples")).join(mad, ["ctrl", "test"], "left").collect()  # one row a comparison
    found = [(r.ctrl, r.test, 1.4826 * (r.mad or 0.0), max((1.4826 * (r.mad or 0.0)) ** 2 - trigamma((r.samples - 2) / 2), LEAST_SPREAD)) for r in samples]
    spread = placed.sparkSession.createDataFrame(found, "ctrl string, test string, off double, spread double")
    placed = placed.join(F.broadcast(spread), ["ctrl", "test"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        y, f, x, there = _padded(pdf)
        ridge = np.full((len(y), 2), RIDGE)
        own, trend = pdf["own"].to_numpy(), pdf["trend"].to_numpy()
        mu = np.maximum(fit(y, f, x, there, np.maximum(own, LEAST_DISPERSION), ridge)[1], 1e-6)
        pulled = best_dispersion(y, mu, x, there, trend, pdf["spread"].to_numpy())
        alpha = np.where(np.log(own) > np.log(trend) + OUTLIER * pdf["off"].to_numpy(), own, pulled)
        beta, full, _ = fit(y, f, x, there, alpha, ridge)
        equal = fit(y, f, x, there, alpha, ridge, two=False)[1]
        ratio = 2 * (log_likelihood(y, np.maximum(full, 1e-15), alpha[:, None], there) - log_likelihood(y, equal, alpha[:, None], there))
        filled = (np.where((x == 0) & there, y, 0).sum(axis=1) > 0) & (np.where((x == 1) & there, y, 0).sum(axis=1) > 0)
        return pd.DataFrame({"dispersion": alpha, "intercept": beta[:, 0], "coefficient": beta[:, 1], "lrt": np.maximum(ratio, 0.0), "filled": filled})

    fitted = _mapped(placed, [*base, "own", "trend"], "dispersion double, intercept double, coefficient double, lrt double, filled boolean", final)
    width = ordered.quantiles(fitted.filter("filled").withColumn("size", F.abs("coefficient")), ["ctrl", "test"], "size", {"q": 0.95}).drop("n")
    fitted = fitted.join(width, ["ctrl", "test"], "left").withColumn("width", F.greatest(F.coalesce("q", F.lit(1.0)) / NORMAL_95, F.lit(1e-3)))

    def shrunken(pdf: pd.DataFrame) -> pd.DataFrame:
        y, f, x, there = _padded(pdf)
        ridge = np.stack([np.full(len(y), RIDGE), 1 / pdf["width"].to_numpy() ** 2], axis=1)
        beta, _, h = fit(y, f, x, there, pdf["dispersion"].to_numpy(), ridge)
        inverse = np.linalg.inv(h + ridge[:, :, None] * np.eye(2))
        spread = np.sqrt(np.maximum((inverse @ h @ inverse)[:, 1, 1], 0.0))
        return pd.DataFrame({"shrunken": beta[:, 1], "deviation": spread})

    kept = [*KEYS, "base_mean", "own", "trend", "dispersion", "intercept", "coefficient", "lrt"]
    out = _mapped(fitted, kept, "shrunken double, deviation double", shrunken)
    two = math.log(2.0)
    out = out.withColumn("wald", F.try_divide("shrunken", "deviation"))
    return out.select(
        *kept[:-1], (F.col("coefficient") / two).alias("log2fc"), (F.col("shrunken") / two).alias("log2fc_shrunken"), (F.col("deviation") / two).alias("se"), "wald",
        F.least(tails.normal_two_sided(F.col("wald")), F.lit(1.0)).alias("p_wald"), "lrt", F.least(tails.normal_two_sided(F.sqrt("lrt")), F.lit(1.0)).alias("p_lrt"))
