"""Purity profiles against a plain version of one variant at a time, and repeated variants."""

import math

import numpy as np
import pytest

from helixframe.operators import models


def _plain(vaf, depth, ploidy, low, high, somatic_only, loh_cutoff=0.5, weight_cutoff=0.7):
    """Misfit and flag of one variant, from the definitions, with exact binomial coefficients."""
    fractions = np.arange(low, high + models.STEP, models.STEP).tolist()  # a fraction at a half read rounds as its digits fall
    fractions[-1] = high
    reads = [round(depth * f) for f in fractions]
    misfit, flags = [], []
    for p in models.PURITIES:
        total, states = 2 * (1 - p) + ploidy * p, []
        for copies in ["lost", *range(1, ploidy + 1)] if ploidy == 2 else range(1, ploidy + 1):
            chance = p / (2 - p) if copies == "lost" else copies * p / total
            states.append((chance, vaf / chance, False, False))
        if not somatic_only:
            for copies in ["lost", *range(1, ploidy + 1)] if ploidy == 2 else range(1, ploidy + 1):
                size, c = (2 - p, 1) if copies == "lost" else (total, copies)
                states.append(((1 - p + c * p) / size, (vaf * size - (1 - p)) / (c * p), True, copies in ("lost", ploidy)))
        masses = [sum(math.comb(depth, k) * q**k * (1 - q) ** (depth - k) + np.finfo(float).tiny for k in reads) for q, *_ in states]
        weights = [m / sum(masses) for m in masses]
        misfit.append(sum((s[1] - 1) ** 2 * w for s, w in zip(states, weights)))
        germ = sum(w for s, w in zip(states, weights) if s[2])
        flags.append(germ > weight_cutoff and not any(w > loh_cutoff for s, w in zip(states, weights) if s[3]))
    return misfit, flags


@pytest.mark.parametrize("ploidy", [1, 2, 3, 5])
@pytest.mark.parametrize("somatic_only", [False, True])
def test_profiles_of_one_variant_at_a_time(ploidy, somatic_only):
    depth = np.array([40.0, 7, 120, 1, 300, 40])
    vaf = np.array([0.3, 0.0, 0.99, 1.0, 0.47, 0.52])
    low, high = models._fraction_bounds(np.round(depth * vaf), depth)
    for points in (1, 50, 2048):
        misfit, flags = models._purity_profiles(vaf, depth, ploidy, low, high, somatic_only, 0.5, 0.7, points)
        for i in range(len(vaf)):
            want, flag = _plain(vaf[i], int(depth[i]), ploidy, low[i], high[i], somatic_only)
            assert np.allclose(misfit[i], want, rtol=1e-8, atol=1e-10)
            assert (flags[i] == flag).mean() > 0.98  # a weight at a cutoff may fall to either side


def test_repeats_count_and_odd_rows_do_not(spark):
    rows = [("t", f"{i}", 0.25 + i % 3 / 100, 200 + i % 2, 2 + i % 2) for i in range(24)]
    schema = "sample string, id string, vaf double, depth long, ploidy long"
    odd = [("t", "a", None, 10, 2), ("t", "b", 0.5, 0, 2), ("t", "c", 0.5, None, 2), ("t", "d", 0.5, 10, 0), ("t", "e", float("nan"), 10, 2), (None, "f", 0.3, 50, 2)]
    once = {(r["stage"]): r for r in models.tumour_purity(spark.createDataFrame(rows, schema)).collect()}
    got = models.tumour_purity(spark.createDataFrame(rows * 3 + odd, schema)).collect()
    thrice = {r.stage: r for r in got if r["sample"] == "t"}
    assert once["all"].n_variants == 24 and thrice["all"].n_variants == 72
    assert [(r.purity, r.has_gap) for r in once.values()] == [(thrice[k].purity, thrice[k].has_gap) for k in once]
    assert models.tumour_purity(spark.createDataFrame([], schema)).count() == 0
