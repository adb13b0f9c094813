"""Batch correction at its limits."""

import numpy as np
import pytest

from helixframe.operators import models as mo

SAMPLES, BATCHES = ["a", "b", "c", "d", "e", "f"], ["x", "x", "x", "y", "y", "y"]


def corrected(spark, rows, batches=BATCHES):
    df = spark.createDataFrame([(g, s, float(v)) for g, values in rows.items() for s, v in zip(SAMPLES, values)], "gene string, sample string, value double")
    out = {}
    for r in mo.correct_batches(df, SAMPLES, batches).collect():
        out.setdefault(r.gene, {})[r.sample] = r.value
    return {g: [v[s] for s in SAMPLES] for g, v in out.items()}


def test_one_gene_takes_its_own_estimates(spark):
    (values,) = corrected(spark, {"g": [1, 2, 3, 11, 12, 13]}).values()
    assert np.mean(values[:3]) == pytest.approx(np.mean(values[3:])) and np.std(values[:3]) == pytest.approx(np.std(values[3:]))


def test_constant_genes_keep_their_values(spark):
    rows = {f"g{k}": [5 + k] * 6 for k in range(3)}
    assert corrected(spark, rows) == {g: [float(x) for x in v] for g, v in rows.items()}


def test_a_batch_of_one_sample(spark):
    draw = np.random.default_rng(1)
    rows = {f"g{k}": draw.normal(k, 1, 6).tolist() for k in range(8)}
    out = corrected(spark, rows, ["x"] * 5 + ["y"])
    assert set(out) == set(rows) and np.isfinite(list(out.values())).all()
