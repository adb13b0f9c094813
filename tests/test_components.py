"""Principal components with absent cells."""

import numpy as np
import pytest

from helixframe.operators import pairwise as pw


def test_incomplete_genes_count_at_their_mean(spark):
    draw = np.random.default_rng(3)
    values = draw.normal(size=(40, 4))
    gone = draw.random((40, 4)) < 0.1
    gone[:, 0] = False
    names = list("abcd")
    df = spark.createDataFrame([(g, names[k], float(values[g, k])) for g in range(40) for k in range(4) if not gone[g, k]] + [(0, "other", 9.0)], "gene int, sample string, value double")
    filled = np.where(gone, np.nan, values)
    filled = np.where(gone, 0.0, filled - np.nanmean(filled, axis=1, keepdims=True))
    scores = pw.principal_components(df, names, 1.0, incomplete=True).collect()
    components = sorted({r.component for r in scores})
    table = np.array([[next(r.score for r in scores if (r.sample, r.component) == (s, c)) for c in components] for s in names])
    assert table @ table.T == pytest.approx(filled.T @ filled)
    counted = pw.incomplete_genes(df, names).first()
    assert (counted.genes, counted.incomplete) == (40, int(gone.any(axis=1).sum()))


@pytest.mark.parametrize("names", [["a", "b", "c", "d", "e", "f", "g", "h"], ["a"]])
def test_all_components_are_no_more_than_samples(spark, names):
    draw = np.random.default_rng(0)
    for seed in range(3):
        values = np.random.default_rng(seed).integers(1, 50, size=(30, len(names))).astype(float)
        df = spark.createDataFrame([(g, s, float(values[g, k])) for g in range(30) for k, s in enumerate(names) if draw.random() < 0.9], "gene int, sample string, value double")
        components = {r.component for r in pw.principal_components(df, names, 1.0, incomplete=True).collect()}
        assert len(components) <= len(names)
