"""Count models: score equations, closed forms, a scan of the likelihood, and genes that are silent in one group."""

import math

import numpy as np
import pytest

from helixframe.operators import countmodel as cm


def test_log_gamma_and_trigamma():
    x = np.array([1e-6, 0.3, 1, 2.5, 40, 1e6])
    assert cm.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)
    assert cm.trigamma(1) == pytest.approx(math.pi**2 / 6) and cm.trigamma(0.5) == pytest.approx(math.pi**2 / 2)


def arrays(rows):
    y = np.array(rows, dtype=float)
    x = np.tile([0.0, 0, 0, 1, 1, 1], (len(y), 1))
    return y, np.ones_like(y), x, np.ones_like(y, dtype=bool)


def test_fit_of_equal_factors_is_the_group_means():
    y, f, x, there = arrays([[3, 5, 7, 20, 30, 40], [0, 0, 1, 0, 2, 0], [900, 1000, 1100, 10, 11, 12]])
    beta, mu, _ = cm.fit(y, f, x, there, np.array([0.1, 0.5, 0.01]), np.full((3, 2), 1e-12))
    for k in range(3):
        low, high = y[k, :3].mean(), y[k, 3:].mean()
        assert mu[k] == pytest.approx([low] * 3 + [high] * 3, rel=1e-6) and beta[k] == pytest.approx([math.log(low), math.log(high / low)], rel=1e-6)


def test_dispersion_is_where_a_scan_finds_it():
    draw = np.random.default_rng(2)
    y, f, x, there = arrays(draw.negative_binomial(4, 4 / (4 + 50), (5, 6)))
    mu = cm.fit(y, f, x, there, np.full(5, 0.2), np.full((5, 2), cm.RIDGE))[1]
    scan = np.linspace(math.log(1e-8), math.log(10), 20_001)
    for k, found in enumerate(cm.best_dispersion(y, mu, x, there)):
        best = scan[cm.profile(y[k:k + 1], mu[k:k + 1], x[k:k + 1], there[k:k + 1], scan[None, :]).argmax()]
        assert math.log(found) == pytest.approx(best, abs=2e-3)


@pytest.fixture(scope="module")
def modelled(spark):
    draw = np.random.default_rng(9)
    samples, factors = [f"s{k}" for k in range(8)], draw.uniform(0.5, 2, 8)
    rows = []
    for g in range(300):
        mean = float(np.exp(draw.normal(4.5, 1)))
        fold = 8.0 if g < 20 else 1.0
        size = 1 / (0.05 + 2 / mean)
        for k in range(8):
            mu = mean * factors[k] * (fold if k % 2 else 1)
            rows.append((f"g{g:03d}", samples[k], float(draw.negative_binomial(size, size / (size + mu)))))
    rows += [("off", s, 0.0 if k % 2 else 200.0 + k) for k, s in enumerate(samples)] + [("few", s, float(k == 0)) for k, s in enumerate(samples)]
    rows += [("gap", s, 50.0 + 3 * k) for k, s in enumerate(samples) if k != 3] + [("same", s, 100.0) for s in samples]
    counts = spark.createDataFrame(rows, "gene string, sample string, value double")
    size = spark.createDataFrame(list(zip(samples, factors.tolist())), "sample string, size_factor double")
    members = spark.createDataFrame([(f"g{k % 2}", s) for k, s in enumerate(samples)], "grp string, sample string")
    out = cm.count_model(counts, size, members, spark.createDataFrame([("g0", "g1")], "ctrl string, test string"))
    found = {r.gene: r for r in out.collect()}
    return rows, dict(zip(samples, factors)), found


def test_every_gene_above_the_limit_is_there(modelled):
    rows, _, found = modelled
    totals = {}
    for g, _, v in rows:
        totals[g] = totals.get(g, 0) + v
    assert set(found) == {g for g, v in totals.items() if v >= 8} and "few" not in found and {"off", "gap", "same"} <= set(found)


def test_coefficients_solve_the_score_equations(modelled):
    rows, factors, found = modelled
    by_gene = {}
    for g, s, v in rows:
        by_gene.setdefault(g, []).append((int(s[1:]) % 2, factors[s], math.floor(v + 0.5)))
    for g, r in found.items():
        slope = [0.0, 0.0]
        for side, factor, y in by_gene[g]:
            mu = factor * math.exp(r.intercept + r.coefficient * side)
            rest = (y - mu) / (1 + r.dispersion * mu)
            slope = [slope[0] + rest, slope[1] + rest * side]
        assert slope[0] == pytest.approx(cm.RIDGE * r.intercept, abs=1e-4) and slope[1] == pytest.approx(cm.RIDGE * r.coefficient, abs=1e-4), g


def test_tests_tell_changed_from_unchanged(modelled):
    found = modelled[2]
    changed = [found[f"g{k:03d}"] for k in range(20)]
    others = [found[f"g{k:03d}"] for k in range(20, 300)]
    assert np.mean([r.p_wald < 0.01 for r in changed]) > 0.9 and np.mean([r.p_lrt < 0.05 for r in others]) < 0.15
    assert all(abs(r.log2fc_shrunken) < abs(r.log2fc) + 1e-9 for r in found.values())
    off = found["off"]
    assert off.log2fc < -10 and math.isfinite(off.log2fc_shrunken) and off.log2fc_shrunken < -1 and off.p_lrt < 1e-6
    assert found["same"].p_lrt > 0.01 and all(math.isfinite(v) for r in found.values() for v in r[3:])


def test_dispersions_are_pulled_towards_the_trend(modelled):
    found = [r for g, r in modelled[2].items() if g.startswith("g0") and r.own > 1e-6]
    apart = lambda name: np.median([abs(math.log(r[name] / r.trend)) for r in found])
    assert apart("dispersion") < apart("own")


def test_dispersions_of_many_rows_take_little_memory():
    import math
    import tracemalloc

    draw = np.random.default_rng(7)
    x = np.concatenate([10.0 ** draw.uniform(-3, 9, 200), np.arange(1.0, 30.0)])
    assert np.allclose(cm.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-10)
    y = draw.poisson(40, (3000, 6)).astype(float)
    mu, side, there = np.full(y.shape, 40.0), np.tile([0.0, 1.0] * 3, (3000, 1)), np.ones(y.shape, dtype=bool)
    there[::7, 2] = False
    tracemalloc.start()
    found = cm.best_dispersion(y, mu, side, there, np.full(3000, 0.1), np.full(3000, 1.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000
    for k in (0, 1, 255, 256, 2999):  # rows stand alone
        row = slice(k, k + 1)
        assert np.isclose(found[k], cm.best_dispersion(y[row], mu[row], side[row], there[row], np.array([0.1]), np.array([1.0]))[0], rtol=1e-6)
