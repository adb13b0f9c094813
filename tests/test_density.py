"""Density over bins against the direct sum."""

import numpy as np
import pytest

from helixframe.operators import density


@pytest.mark.parametrize("points", [1, 40, 3000])
def test_equals_the_direct_sum(spark, points):
    draw = np.random.default_rng(5)
    values = np.concatenate([draw.normal(0, 1, 2000), draw.normal(8, 0.2, 500), [1e4, -300.0], np.full(300, 2.5)])
    grid = np.linspace(-12, 20, points)
    rows = [(float(x),) for x in values] + [(None,), (float("nan"),), (float("inf"),)]
    got = {r.point: r.density for r in density.binned_density(spark.createDataFrame(rows, "x double"), "x", grid).collect()}
    h = values.std(ddof=1) * len(values) ** -0.2
    want = np.exp(-0.5 * ((grid[:, None] - values) / h) ** 2).mean(axis=1) / (h * np.sqrt(2 * np.pi))
    assert np.abs(np.array([got[x] for x in grid]) - want).max() < 1e-6 / (h * np.sqrt(2 * np.pi))


def test_without_a_spread(spark):
    for rows in ([], [(1.0,)], [(1.0,)] * 5, [(None,)]):
        got = density.binned_density(spark.createDataFrame(rows, "x double"), "x", [0.0, 1.0]).collect()
        assert sorted((r.point, r.density) for r in got) == [(0.0, None), (1.0, None)]
    assert density.binned_density(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x", []).count() == 0
