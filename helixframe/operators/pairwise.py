"""Matrices between samples (correlation, distance, identity, principal components).

A sample pair needs sums over all genes. Every task adds the sums of its genes to one small
matrix per kind (samples x samples) and hands on that matrix only; no gene emits its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.session import cut_lineage

KINDS = ("n", "x", "xx", "xy", "abs", "sq")


def wide(df: DataFrame, row: str, column: str, value: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(columns)).agg(F.first(value))


def pair_sums(matrix: DataFrame, columns: Sequence[str], absolute: bool = False, centred: bool = False) -> DataFrame:
    """(a, b, n, x, xx, xy, abs, sq) for every ordered column pair over the rows where both have a value.

    x and xx belong to column a; those of b are found under (b, a). `centred` measures from a value near each
    column's median, so that sums of a column with a small spread far from zero keep its digits; a constant
    column then sums to exactly zero. abs and sq are sums over the gaps between the columns as they are.
    """
    names = list(columns)
    middle = np.zeros(len(names))
    if centred:
        found = matrix.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, 100).alias(c) for c in names]).first()
        middle = np.array([found[c] or 0.0 for c in names])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = len(names)
        sums = {k: np.zeros((size, size)) for k in KINDS}
        for batch in batches:
            v = batch[names].to_numpy(dtype=float) - middle
            m = ~np.isnan(v)
            filled, mask = np.where(m, v, 0.0), m.astype(float)
            sums["n"] += mask.T @ mask
            sums["x"] += filled.T @ mask
            sums["xx"] += (filled**2).T @ mask
            sums["xy"] += filled.T @ filled
            if absolute:
                for i in range(size):
                    gap = np.abs(filled[:, [i]] + middle[i] - filled - middle) * mask[:, [i]] * mask
                    sums["abs"][i] += gap.sum(axis=0)
                    sums["sq"][i] += (gap**2).sum(axis=0)
        a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        yield pd.DataFrame({"a": a.ravel(), "b": b.ravel(), **{k: s.ravel() for k, s in sums.items()}})

    schema = "a int, b int, " + ", ".join(f"{k} double" for k in KINDS)
    added = matrix.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(partial, schema)
    label = F.array(*[F.lit(c) for c in names])
    return added.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in KINDS]).select(
        F.get(label, F.col("a")).alias("a"), F.get(label, F.col("b")).alias("b"), *KINDS
    )


def _both(sums: DataFrame) -> DataFrame:
    other = sums.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    return sums.join(other, ["a", "b"])


def correlation(sums: DataFrame, least_rows: int = 0) -> DataFrame:
    """Pearson correlation of every pair from centred sums: null where a column is constant, 0 where fewer than
    `least_rows` rows are shared."""
    n = F.col("n")
    cov = n * F.col("xy") - F.col("x") * F.col("y")
    scale = F.sqrt(n * F.col("xx") - F.col("x") ** 2) * F.sqrt(n * F.col("yy") - F.col("y") ** 2)
    r = F.when(n < least_rows, 0.0).otherwise(F.try_divide(cov, scale))
    return _both(sums).select("a", "b", n.cast("long").alias("n"), F.when(r.isNotNull() & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(r, F.lit(1.0)))).alias("corr"))


def pearson_matrix(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    return correlation(pair_sums(wide(df, "gene", "sample", "value", samples), samples, centred=True))


def spearman_matrix(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks, those of a pair over the genes that both samples have.

    Samples with all genes share one ranking. The others are ranked anew for each partner, so every gene of theirs
    meets each sample once; no more rows than genes times samples times incomplete samples.
    """
    kept = df.filter(F.col("value").isNotNull() & F.col("sample").isin(*samples)).select("gene", "sample", "value")
    genes = kept.select("gene").distinct().count()
    counts = {r["sample"]: r["n"] for r in kept.groupBy("sample").agg(F.countDistinct("gene").alias("n")).collect()}
    whole = [s for s in samples if counts.get(s, 0) == genes]
    partial = [s for s in samples if counts.get(s, 0) < genes]
    parts = []
    if whole:
        ranked = ordered.average_rank(kept.filter(F.col("sample").isin(*whole)), ["sample"], "value", "rank")
        parts.append(correlation(pair_sums(wide(ranked, "gene", "sample", "rank", whole), whole, centred=True)))
    if partial:
        pairs = [(a, b) for i, a in enumerate(samples) for b in samples[i:] if a in partial or b in partial]
        asked = F.broadcast(df.sparkSession.createDataFrame(pairs, "a string, b string"))  # samples squared rows
        one, two = kept.select("gene", F.col("sample").alias("a"), F.col("value").alias("x")), kept.select("gene", F.col("sample").alias("b"), F.col("value").alias("y"))
        both = one.join(two, "gene").join(asked, ["a", "b"])
        for side in ("x", "y"):
            both = ordered.average_rank(both, ["a", "b"], side, f"rank_{side}")
        r = both.groupBy("a", "b").agg(F.count("*").alias("n"), F.corr("rank_x", "rank_y").alias("corr"))
        r = r.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
        parts.append(r.union(r.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "corr")))
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def distances(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Euclidean, city block, cosine and correlation distance of every sample pair."""
    matrix = wide(df, "gene", "sample", "value", samples)
    r = correlation(pair_sums(matrix, samples, centred=True)).select("a", "b", (1 - F.col("corr")).alias("correlation"))
    both = _both(pair_sums(matrix, samples, absolute=True)).select(
        "a", "b", F.sqrt("sq").alias("euclidean"), F.col("abs").alias("cityblock"),
        (1 - F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))).alias("cosine"),
    )
    return both.join(r, ["a", "b"])


def _lightest(d: np.ndarray, within: bool = True) -> list[tuple[int, int]]:
    """A spanning forest of least distances (Prim); infinite ones link nothing.

    With `within` false rows and columns are different samples, and those of the columns are counted on after the rows.
    """
    rows = len(d)
    n, out = rows if within else sum(d.shape), []
    turned = d if within else np.ascontiguousarray(d.T)
    best, link, left = np.full(n, np.inf), np.zeros(n, dtype=int), np.ones(n, dtype=bool)
    for _ in range(n):
        at = int(best.argmin())  # of those left; the others are infinite
        if not np.isfinite(best[at]):
            at = int(left.argmax())  # the next tree
        else:
            out.append((int(link[at]), at))
        left[at], best[at] = False, np.inf
        away, own = (slice(0, n), d[at]) if within else (slice(rows, n), d[at]) if at < rows else (slice(0, rows), turned[at - rows])
        nearer = left[away] & (own < best[away])
        np.copyto(best[away], own, where=nearer)
        np.copyto(link[away], at, where=nearer)
    return out


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The Euclidean distance of each row of x to each of y over the columns both have (nan elsewhere); infinite without any."""
    if not (np.isnan(x).any() or np.isnan(y).any()):
        most = max(np.abs(x).max(initial=0.0), np.abs(y).max(initial=0.0))
        if 4 * most * most * x.shape[1] < 2**53 and (x == np.rint(x)).all() and (y == np.rint(y)).all():
            # Sums of whole numbers of that size are exact in any order.
            square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)
            square -= 2 * (x @ y.T)
            return np.sqrt(square, out=square)
    square, shared = np.zeros((len(x), len(y))), np.zeros((len(x), len(y)), dtype=bool)
    endless = np.isinf(x).any() and np.isinf(y).any()
    for one, two in zip(x.T, y.T):
        a, b = np.flatnonzero(~np.isnan(one)), np.flatnonzero(~np.isnan(two))
        if endless:
            gap = one[:, None] - two
            there = ~np.isnan(gap)
            square += np.where(there, gap, 0.0) ** 2
            shared |= there
        elif len(a) == len(one) and len(b) == len(two):
            square += (one[:, None] - two) ** 2
            shared[:] = True
        else:
            square[np.ix_(a, b)] += (one[a, None] - two[b]) ** 2
            shared[np.ix_(a, b)] = True
    return np.where(shared, np.sqrt(square), np.inf)


def euclidean(df: DataFrame, spanning: bool = False, side: int | None = None, digits: int | None = None) -> DataFrame:
    """(a, b, euclidean), a < b: the distance of every two samples over the genes both have, for any number of samples.

    Samples are dealt by hash over blocks of about `side`, and a task holds two blocks, so neither the driver nor a task
    sees the whole matrix. Pairs without a common gene are left out. With `spanning` a task hands on only a lightest spanning
    forest of its pairs. What it drops is the longest link of a ring, so the least largest step between any two samples,
    and with it single linkage and components at any height, stay as over all pairs. With `digits` there are two more
    columns, pairs and total: the first link of a task holds how many pairs the task saw and the sum of their distances,
    each rounded to so many digits.
    """
    side = side or (2048 if spanning else 512)
    kind = dict(df.dtypes)["sample"]
    cells = df.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))).select("gene", "sample", F.col("value").cast("double").alias("value"))
    vectors = cut_lineage(cells.groupBy("sample").agg(F.sort_array(F.collect_list(F.struct("gene", "value"))).alias("cells")).select(
        "sample", F.col("cells.gene").alias("genes"), F.col("cells.value").alias("values")))
    blocks = max(1, -(-vectors.count() // side))
    own = F.pmod(F.xxhash64("sample"), F.lit(blocks))
    dealt = vectors.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sample", "genes", "values")

    def measured(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("sample").combine_chunks()
        names, lists = part["sample"].combine_chunks(), part["genes"].combine_chunks()
        genes = lists.flatten().dictionary_encode()
        v = np.full((len(part), len(genes.dictionary)), np.nan)
        v[np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy()), genes.indices.to_numpy()] = part["values"].combine_chunks().flatten().to_numpy()
        blocks_of, within = part["own"].to_numpy(), key[0].as_py() == key[1].as_py()
        one, two = (np.flatnonzero(blocks_of == k.as_py()) for k in key)
        d = _gaps(v[one], v[two])
        if within:
            np.fill_diagonal(d, np.inf)
        if spanning:
            ends = np.array(_lightest(d, within), dtype=int).reshape(-1, 2)
            both = one if within else np.concatenate([one, two])
            row, column = ends.min(axis=1), ends.max(axis=1)
            far, low, high = d[row, column if within else column - len(one)], both[row], both[column]
        else:
            row, column = np.nonzero(np.triu(np.isfinite(d), 1) if within else np.isfinite(d))
            far, low, high = d[row, column], one[row], two[column]
        columns = {"a": names.take(pa.array(np.minimum(low, high))), "b": names.take(pa.array(np.maximum(low, high))), "euclidean": pa.array(far)}
        if digits is not None:
            seen, total = 0, 0.0
            for k in range(len(d)):
                finite = d[k, k + 1:] if within else d[k]
                finite = finite[np.isfinite(finite)]
                seen, total = seen + len(finite), total + float(np.round(finite, digits).sum())
            none = [None] * max(0, len(far) - 1)
            columns |= {"pairs": pa.array([seen, *none][:len(far)], pa.int64()), "total": pa.array([total, *none][:len(far)], pa.float64())}
        return pa.table(columns)

    more = "" if digits is None else ", pairs long, total double"
    return dealt.groupBy("i", "j").applyInArrow(measured, f"a {kind}, b {kind}, euclidean double{more}")


def principal_components(df: DataFrame, samples: Sequence[str], explained: float = 0.95, incomplete: bool = False) -> DataFrame:
    """(sample, component, score, ratio) of the samples over gene-centred values.

    Only genes with a value in every sample count, unless `incomplete`: then all do, and an absent cell lies at the mean of
    its gene, which moves the sample nowhere along it. `incomplete_genes` says how many genes that concerns.
    The scores follow from the samples x samples product matrix, the only thing that reaches the
    driver. The sign of a component is set so that its largest score is positive.
    """
    df = df.filter(F.col("sample").isin(*samples) & F.col("value").isNotNull()) if incomplete else df
    full = df.groupBy("gene").agg(F.countDistinct("sample").alias("_n"), F.avg("value").alias("_m"))
    centred = df.join(full if incomplete else full.filter(F.col("_n") == len(samples)), "gene").withColumn("value", F.col("value") - F.col("_m"))
    sums = pair_sums(wide(centred, "gene", "sample", "value", samples), samples).select("a", "b", "xy").collect()
    place = {s: i for i, s in enumerate(samples)}
    gram = np.zeros((len(samples), len(samples)))
    for r in sums:
        gram[place[r.a], place[r.b]] = r.xy
    values, vectors = np.linalg.eigh(gram)
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    ratio = values / values.sum()
    keep = min(max(int(np.searchsorted(np.cumsum(ratio), explained) + 1), 2), len(samples))  # the shares may sum to a little below 1
    scores = vectors[:, :keep] * np.sqrt(values[:keep])
    scores = scores * np.sign(scores[np.abs(scores).argmax(axis=0), np.arange(keep)])
    rows = [
        (s, f"PC{k + 1}", float(scores[i, k]), float(ratio[k])) for i, s in enumerate(samples) for k in range(keep)
    ]
    return df.sparkSession.createDataFrame(rows, "sample string, component string, score double, ratio double")


def incomplete_genes(df: DataFrame, samples: Sequence[str]) -> DataFrame:
    """(genes, incomplete): how many genes there are, and how many lack a value in one of the samples."""
    there = F.col("sample").isin(*samples) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double"))
    per = df.groupBy("gene").agg(F.count_distinct(F.when(there, F.col("sample"))).alias("n"))
    return per.agg(F.count("*").alias("genes"), F.count_if(F.col("n") < len(samples)).alias("incomplete"))


# Lower depth bound, mean and spread of matched pairs, then of unmatched pairs.
IDENTITY_MODEL = [
    (10, 0.874546, 0.022211, 0.310549, 0.060058), (5, 0.785249, 0.021017, 0.279778, 0.054104),
    (2, 0.650573, 0.018699, 0.238972, 0.047196), (1, 0.578386, 0.018526, 0.222322, 0.041186),
    (-1, 0.529327, 0.025785, 0.217839, 0.040334),
]
# The same where related donors are expected.
FAMILY_MODEL = [
    (10, 0.874546, 0.022211, 0.646256175, 0.021336239), (5, 0.785249, 0.021017, 0.598277053, 0.02253561),
    (2, 0.650573, 0.018699, 0.536020197, 0.020461932), (1, 0.578386, 0.018526, 0.49497342, 0.022346597),
    (-1, 0.529327, 0.025785, 0.465275173, 0.028221203),
]
UNIVERSE = 21039  # Fixed value: number of sites on the identity panel.


def identity_depths(sites: DataFrame, universe: int = UNIVERSE) -> DataFrame:
    """Mean depth over the panel and the listed sites, and over the covered sites; sites (sample, index, ref, alt, vaf)."""
    used = sites.filter(F.col("vaf").isNotNull())
    depth = F.sum(F.col("ref") + F.col("alt"))
    covered = F.count_if(F.col("ref") + F.col("alt") > 0)
    count = F.count("*") + universe
    return used.groupBy("sample").agg(
        (depth / count).alias("mean_depth"), F.coalesce(F.try_divide(depth, covered), depth / count).alias("real_depth")
    )


def same_donor(sites: DataFrame, samples: Sequence[str], family: bool = False, nonzero: bool = False) -> DataFrame:
    """Matched or unmatched for every unordered sample pair from their shared allele fractions."""
    used = sites.filter(F.col("vaf").isNotNull())
    r = correlation(pair_sums(wide(used, "index", "sample", "vaf", samples), samples, centred=True), 20).fillna(0.0, ["corr"]).filter(F.col("a") < F.col("b"))
    depth = identity_depths(sites).select("sample", F.col("real_depth" if nonzero else "mean_depth").alias("d"))
    both = (
        r.join(depth.select(F.col("sample").alias("a"), F.col("d").alias("da")), "a")
        .join(depth.select(F.col("sample").alias("b"), F.col("d").alias("db")), "b")
        .withColumn("depth", F.least("da", "db"))
    )
    model = FAMILY_MODEL if family else IDENTITY_MODEL

    def banded(i: int):
        out = F.when(F.col("depth") > model[0][0], F.lit(model[0][i]))
        for row in model[1:-1]:
            out = out.when(F.col("depth") > row[0], F.lit(row[i]))
        return out.otherwise(F.lit(model[-1][i]))

    c = F.col("corr")
    unlike = F.abs(banded(3) - c) - banded(4)
    like = F.abs(banded(1) - c) - banded(2)
    return both.select("a", "b", "n", "corr", "depth", F.when(unlike > like, "matched").otherwise("unmatched").alias("verdict"))


def identity_matrix(verdicts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Correlations of matched pairs as a square table, 0 elsewhere."""
    matched = F.when(F.col("verdict") == "matched", F.col("corr")).otherwise(0.0).alias("corr")
    both = verdicts.select("a", "b", matched).union(verdicts.select("b", "a", matched))
    return both.groupBy("a").pivot("b", list(samples)).agg(F.max("corr")).fillna(0.0)
