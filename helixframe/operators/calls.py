"""Evaluation of detected against known call sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.operators.intervals import WIDTH

# Fixed value: two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval of a proportion; null without trials, and where hits are no part of the trials."""
    p = F.when((hits >= 0) & (hits <= n), F.try_divide(hits, n))
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    # The least and the greatest pass over nulls.
    return F.when(p.isNotNull(), F.greatest((centre - half) / scale, F.lit(0.0))), F.when(p.isNotNull(), F.least((centre + half) / scale, F.lit(1.0)))


def _percent(hits: Column, n: Column, empty: float | None = None) -> Column:
    value = F.round(F.try_divide(hits, n) * 100, 2)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def rates() -> list[Column]:
    """Accuracy, predictive values, sensitivity and specificity from TP, FP, FN and TN, in percent.

    Without positives in a denominator the positive value and the sensitivity are 100.
    """
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    return [
        _percent(tp + tn, tp + fp + fn + tn).alias("accuracy"), _percent(tp, tp + fp, 100.0).alias("ppv"),
        _percent(tn, tn + fn).alias("npv"), _percent(tp, tp + fn, 100.0).alias("sensitivity"),
        _percent(tn, tn + fp).alias("specificity"),
    ]


def concordance(detected: DataFrame, known: DataFrame) -> DataFrame:
    """Detected and known calls (sample, var_id, af) side by side."""
    d = detected.select("sample", "var_id", F.col("af").alias("detected_af"))
    k = known.select("sample", "var_id", F.col("af").alias("expected_af"))
    both = d.join(k, ["sample", "var_id"], "full")
    return both.withColumn(
        "concordance", F.when(F.col("detected_af").isNotNull() & F.col("expected_af").isNotNull(), "Yes").otherwise("No")
    )


def confusion(detected: DataFrame, known: DataFrame, n_variants: int) -> DataFrame:
    """TP, FP, FN and TN per sample; TN is what remains of the panel."""
    c = concordance(detected, known)
    d, k = F.col("detected_af").isNotNull(), F.col("expected_af").isNotNull()
    counted = c.groupBy("sample").agg(
        F.count_if(d & k).alias("TP"), F.count_if(d & ~k).alias("FP"), F.count_if(k & ~d).alias("FN")
    )
    return counted.withColumn("TN", F.lit(n_variants) - F.col("TP") - F.col("FN") - F.col("FP"))


def evaluation(detected: DataFrame, known: DataFrame, n_variants: int) -> DataFrame:
    """Rates per sample and in total, the total with Wilson intervals of accuracy and sensitivity."""
    per = confusion(detected, known, n_variants)
    total = per.agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN", "TN")])
    columns = ["sample", "TP", "FP", "FN", "TN"]
    stacked = per.select(*columns, F.lit(False).alias("_total")).union(
        total.select(F.lit("Total").alias("sample"), "TP", "FP", "FN", "TN", F.lit(True))
    )
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    acc, sens = wilson(tp + tn, tp + fp + fn + tn), wilson(tp, tp + fn)
    bounds = [
        F.when(F.col("_total"), x).alias(n)
        for n, x in zip(("accuracy_low", "accuracy_high", "sensitivity_low", "sensitivity_high"), (*acc, *sens))
    ]
    return stacked.select(*columns, *rates(), *bounds)


def split_low_known(detected: DataFrame, known: DataFrame, cutoff: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Known calls below the cutoff leave both sides: (detected, known, detected although low)."""
    low = known.filter(F.col("af") < cutoff).select("sample", "var_id", F.col("af").alias("expected_af"))
    keys = ["sample", "var_id"]
    return (
        detected.join(low, keys, "left_anti"), known.filter(F.col("af") >= cutoff), detected.join(low, keys),
    )


def _spread(df: DataFrame, keys: list[str], trials: str, known_median: bool = True) -> DataFrame:
    """Range, mean, median, sd and CV of `af` with calls, rate and interval; a lone value has sd 0, none counts as 0."""
    # The group is the repeats of one mutation, a handful of samples.
    agg = df.groupBy(*keys).agg(
        F.count("af").alias("calls"), F.max(trials).alias("trials"), F.min("af").alias("low"), F.max("af").alias("high"),
        F.avg("af").alias("mean"), F.percentile("af", 0.5).alias("median"), F.stddev_samp("af").alias("sd"),
    )
    zero = F.lit(0.0)
    out = agg.select(
        *keys, "calls", "trials", *[F.coalesce(c, zero).alias(c) for c in ("low", "high", "mean", "median", "sd")]
    )
    low, high = wilson(F.col("calls"), F.col("trials"))
    return out.select(
        "*", F.when(F.col("mean") != 0, F.col("sd") / F.col("mean")).otherwise(0.0).alias("cv"),
        (F.col("calls") / F.col("trials")).alias("rate"), low.alias("rate_low"), high.alias("rate_high"),
    )


def replicate_stats(detected: DataFrame, known: DataFrame, design: DataFrame) -> DataFrame:
    """Spread of the detected fraction of every known mutation over the repeats (grp, sample)."""
    sized = design.join(design.groupBy("grp").agg(F.count("*").alias("n_samples")), "grp")
    expected = known.join(sized, "sample").select("grp", "var_id", "n_samples").distinct()
    found = detected.join(design, "sample").select("grp", "var_id", "af")
    return _spread(expected.join(found, ["grp", "var_id"], "left"), ["grp", "var_id"], "n_samples")


def detection_limit(detected: DataFrame, known: DataFrame, gradient: Sequence[float]) -> DataFrame:
    """Spread and call rate by expected fraction; only fractions on the gradient (to 0.01 %) count."""
    step = F.format_string("%.2f%%", F.col("af") * 100)
    wanted = [f"{x * 100:.2f}%" for x in gradient]
    expected = known.select("sample", "var_id", step.alias("expected")).filter(F.col("expected").isin(wanted))
    sizes = expected.groupBy("expected").agg(F.count("*").alias("n_expected"))
    found = expected.join(detected.select("sample", "var_id", "af"), ["sample", "var_id"], "left").join(sizes, "expected")
    agg = found.groupBy("expected").agg(
        F.count("af").alias("calls"), F.max("n_expected").alias("trials"), F.min("af").alias("low"),
        F.max("af").alias("high"), F.avg("af").alias("mean"), F.stddev_samp("af").alias("sd"),
    )
    medians = ordered.quantiles(found.filter(F.col("af").isNotNull()), ["expected"], "af", {"median": 0.5}).drop("n")
    low, high = wilson(F.col("calls"), F.col("trials"))
    zero = F.lit(0.0)
    return agg.join(medians, "expected", "left").select(
        "expected", "calls", "trials", *[F.coalesce(c, zero).alias(c) for c in ("low", "high", "mean", "median", "sd")],
        (F.col("calls") / F.col("trials")).alias("rate"), low.alias("rate_low"), high.alias("rate_high"),
    )


VARIANT = ["sample", "chrom", "pos", "ref", "alt"]


def _near_each_other(rows: DataFrame, distance: int) -> DataFrame:
    """(sample, chrom, pos, missed_near, extra_near): whether a missed row has an extra one of its sample and chromosome
    close by, and the other way round. One pass up and one down over the distinct positions serves both."""
    spots = rows.groupBy("sample", F.col("chrom").alias("_chrom"), "pos").agg(F.bool_or("missed").alias("_m"), F.bool_or("extra").alias("_e"))
    spots = spots.withColumn("chrom", F.concat_ws("|", "sample", "_chrom"))
    missed, extra = F.when(F.col("_m"), F.col("pos")), F.when(F.col("_e"), F.col("pos"))
    up = ordered.accumulate(spots, ["chrom"], "pos", {"_m1": ("max", missed), "_e1": ("max", extra)}, width=WIDTH)
    both = ordered.accumulate(up, ["chrom"], "pos", {"_m2": ("min", missed), "_e2": ("min", extra)}, descending=True, width=WIDTH)

    def close(before: str, after: str) -> Column:
        return F.coalesce(F.least(F.col("pos") - F.col(before), F.col(after) - F.col("pos")) < distance, F.lit(False))

    return both.select("sample", F.col("_chrom").alias("chrom"), "pos", close("_e1", "_e2").alias("missed_near"), close("_m1", "_m2").alias("extra_near"))


def scored_evaluation(
    introduced: DataFrame, reported: DataFrame, original: DataFrame, rejected: DataFrame, panel_size: int,
    distance: int = 50,
) -> DataFrame:
    """Confusion per sample of introduced against reported variants, with two kinds of rescue.

    Reported variants in `original` do not count. A missed variant close to an unexpected one
    rescues both; a missed variant whose site was rejected for polish, else AF, else repeat counts as found.
    rejected: (sample, chrom, pos, reason).
    """
    new = reported.select(*VARIANT).distinct().join(original.select("chrom", "pos", "ref", "alt").distinct(), VARIANT[1:], "left_anti")
    truth = introduced.select(*VARIANT).distinct()
    both = truth.withColumn("_t", F.lit(True)).join(new.withColumn("_n", F.lit(True)), VARIANT, "full")
    rest = both.select(*VARIANT, F.col("_n").isNull().alias("missed"), F.col("_t").isNull().alias("extra"))
    reasons = rejected.groupBy("sample", "chrom", "pos").agg(
        *[F.bool_or(F.col("reason") == r).alias(r) for r in ("polish", "af", "repeat")]
    )
    reason = F.when(F.col("polish"), "polish").when(F.col("af"), "af").when(F.col("repeat"), "repeat")
    site = ["sample", "chrom", "pos"]
    near = _near_each_other(rest.filter("missed OR extra"), distance)
    judged = rest.join(near, site, "left").join(reasons, site, "left")
    size = F.when(F.length("ref") > F.length("alt"), F.length("ref") - F.length("alt")).when(
        F.length("ref") == F.length("alt"), 1
    ).otherwise(0)
    what = (
        F.when(F.col("extra"), F.when(F.col("extra_near"), "extra_near").otherwise("extra"))
        .when(F.col("missed"), F.coalesce(F.when(F.col("missed_near"), "position"), reason, F.lit("missed"))).otherwise("hit")
    )
    rows = judged.select("sample", what.alias("what"), F.when(F.col("extra"), 0).otherwise(size).alias("size"))

    def n(*names: str) -> Column:
        return F.count_if(F.col("what").isin(*names))

    counted = rows.groupBy("sample").agg(
        n("hit", "position", "polish", "af", "repeat").alias("TP"), n("extra").alias("FP"), n("missed").alias("FN"),
        F.sum("size").alias("_length"), n("extra_near").alias("rescued_position"), n("polish").alias("rescued_polish"),
        n("af").alias("rescued_af"), n("repeat").alias("rescued_repeat"),
    )
    return counted.withColumn("TN", F.lit(panel_size) - F.col("_length") - F.col("FN")).drop("_length")


def plain_rates() -> list[Column]:
    """Ratios from TP, FP, FN and TN; the positive value is 0 without true positives."""
    tp, fp, fn, tn = (F.col(c) for c in ("TP", "FP", "FN", "TN"))
    return [
        F.try_divide(tp, tp + fn).alias("sensitivity"), F.try_divide(tn, tn + fp).alias("specificity"),
        F.when(tp > 0, F.try_divide(tp, tp + fp)).otherwise(0.0).alias("ppv"), F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    ]


def totals_by(confused: DataFrame, key: str) -> DataFrame:
    """Summed confusion per key and in total (key null), with ratios."""
    summed = confused.rollup(key).agg(*[F.sum(c).alias(c) for c in ("TP", "FP", "FN", "TN")])
    return summed.select("*", *plain_rates())


def matrix_comparison(calls: DataFrame, positives: DataFrame, n_targets: int) -> DataFrame:
    """Per sample: called mutations, TP, FP, FN and TN; a false negative was called in some sample at least.

    calls: (sample, mutation).
    """
    called = calls.select("sample", "mutation").distinct()
    truth = positives.select("mutation").distinct()
    marked = called.join(truth.withColumn("_p", F.lit(True)), "mutation", "left")
    per = marked.groupBy("sample").agg(F.count("*").alias("positives"), F.count("_p").alias("TP"))
    # Positives that no sample has called are no row of the matrix.
    seen = called.select("mutation").distinct().join(truth, "mutation", "left_semi").agg(F.count("*").alias("n")).scalar()
    out = per.withColumn("FP", F.col("positives") - F.col("TP")).withColumn("FN", seen - F.col("TP"))
    return out.withColumn("TN", F.lit(n_targets) - F.col("TP") - F.col("FP") - F.col("FN"))


def detection_table(samples: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of every sample; a sample without hits has one row `None`."""
    out = samples.select("sample").distinct().join(hits, "sample", "left")
    return out.select(
        "sample", F.coalesce(F.col("mutation").cast("string"), F.lit("None")).alias("mutation"),
        F.coalesce("af", F.lit(0.0)).alias("af"), F.coalesce("depth", F.lit(0)).alias("depth"),
    )


def first_hot_triple(rows: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First (transcript, chgvs, phgvs) of the parallel ';' lists of a row that is hot; `row_id` names the row."""
    lists = F.arrays_zip(
        F.split("transcripts", ";").alias("transcript"), F.split("chgvs_list", ";").alias("chgvs"),
        F.split("phgvs_list", ";").alias("phgvs"),
    )
    triples = rows.select("row_id", "sample", "gene", "af", F.posexplode(lists).alias("place", "t")).select(
        "row_id", "sample", "gene", "af", "place", "t.*"
    )
    hits = triples.join(hot.select(*keys).distinct(), list(keys), "left_semi")
    # Only the best row per id leaves each map task.
    first = F.row_number().over(W.partitionBy("row_id").orderBy("place"))
    return hits.withColumn("_rn", first).filter("_rn = 1").drop("_rn", "place")


def pick_parallel(rows: DataFrame, canonical: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reduce parallel ';' lists to the element of the first canonical transcript, else the first element."""
    stems = canonical.select(F.split(canonical.columns[0], r"\.")[0].alias("_stem")).distinct()
    places = rows.select("row_id", F.posexplode(F.split("transcripts", ";")).alias("_i", "_t")).withColumn(
        "_stem", F.split("_t", r"\.")[0]
    )
    best = places.join(stems, "_stem", "left_semi").groupBy("row_id").agg(F.min("_i").alias("_i"))
    out = rows.join(best, "row_id", "left").withColumn("_i", F.coalesce("_i", F.lit(0)))
    for c in ("transcripts", *columns):
        out = out.withColumn(c, F.get(F.split(c, ";"), F.col("_i")))
    return out.drop("_i")


def mapped_ids(table: DataFrame, mapping: DataFrame, hits: DataFrame) -> DataFrame:
    """Translate ids from one genome build to the other (unmapped ids stay) and attach the hits."""
    out = table.join(mapping.select(F.col("old_id").alias("id"), "new_id"), "id", "left")
    out = out.withColumn("new_id", F.coalesce("new_id", "id"))
    return hits.join(out, "new_id", "left")


def pair_verdicts(pairs: DataFrame, pattern: str = "(TCGA.{8})") -> DataFrame:
    """Matched and unmatched sample pairs against the donor named in their ids: success or problem."""
    same = F.regexp_extract("sample1", pattern, 1) == F.regexp_extract("sample2", pattern, 1)
    good = (F.col("verdict") == "matched") == same
    return pairs.withColumn("outcome", F.when(good, "success").otherwise("problem"))
