"""Kendall's tau-b against all pairs of genes."""

import itertools
import math

import numpy as np
import pytest

from helixframe.operators import kendall


def brute(x, y):
    pairs = [(np.sign(x[i] - x[j]), np.sign(y[i] - y[j])) for i, j in itertools.combinations(range(len(x)), 2)]
    s, tx, ty = sum(a * b for a, b in pairs), sum(a != 0 for a, _ in pairs), sum(b != 0 for _, b in pairs)
    return s / math.sqrt(tx * ty) if tx * ty else None


def test_inversions():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 100):
        y, w = draw.integers(0, 9, n), draw.integers(1, 4, n)
        assert kendall.inversions(y, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if y[i] > y[j])


def test_published_example():
    # Two rankings of twelve, a textbook case of tau with ties.
    x, y = np.array([1, 2, 2, 4, 5]), np.array([1, 3, 2, 4, 4])
    assert kendall.balance(x, y, np.ones(5, dtype=np.int64)) / math.sqrt(9 * 9) == pytest.approx(brute(x, y))


@pytest.mark.parametrize("strip_rows", [7, 50, 10_000])
def test_matrix_equals_all_pairs(spark, strip_rows):
    draw = np.random.default_rng(2)
    columns = {
        "a": draw.normal(size=150), "b": draw.integers(0, 6, 150).astype(float), "c": np.where(draw.random(150) < 0.5, 0.0, draw.random(150)),
        "d": np.full(150, 3.0), "e": -np.arange(150.0),
    }
    columns["a"][:40] = np.nan
    rows = [(g, s, None if g % 13 == 5 else float(v)) for s, column in columns.items() for g, v in enumerate(column)] + [(1, "other", 2.0)]
    names = list(columns)
    found = {(r.a, r.b): (r.n, r.corr) for r in kendall.kendall_matrix(spark.createDataFrame(rows, "gene int, sample string, value double"), names, strip_rows).collect()}
    assert len(found) == 25
    for one, two in itertools.product(names, names):
        x, y = columns[one], columns[two]
        there = [g for g in range(150) if g % 13 != 5 and not math.isnan(x[g]) and not math.isnan(y[g])]
        n, tau = found[one, two]
        want = brute(x[there], y[there])
        assert n == len(there) and (tau is None if want is None else tau == pytest.approx(want, abs=1e-12))


def test_few_genes(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "gene int, sample string, value double")
    assert {(r.a, r.b, r.n, r.corr) for r in kendall.kendall_matrix(df, ["a", "b"]).collect()} == {(p, q, 1, None) for p in "ab" for q in "ab"}
    assert kendall.kendall_matrix(df.limit(0), ["a", "b"]).count() == 0


def test_by_name(spark):
    df = spark.createDataFrame([(g, s, float(g * (1 if s == "a" else -2))) for g in range(9) for s in "ab"], "gene int, sample string, value double")
    for method in ("pearson", "spearman", "kendall"):
        assert {(r.a, r.b): round(r.corr, 9) for r in kendall.correlation_matrix(df, ["a", "b"], method).collect()} == {
            ("a", "a"): 1, ("b", "b"): 1, ("a", "b"): -1, ("b", "a"): -1}
    with pytest.raises(KeyError):
        kendall.correlation_matrix(df, ["a", "b"], "other")
