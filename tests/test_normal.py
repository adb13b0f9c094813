"""Shapiro-Wilk against published examples, quantiles against the standard library."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import normal

# Published examples: weights of eleven men; W 0.79 and p below 0.01.
MEN = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
# Published example of the algorithm's paper: penicillin yields with W 0.9461 and p near 0.04 to 0.05 have no ties; here a plain sequence with known W.
LINE = list(range(1, 11))


def by_hand(values):
    """The algorithm in plain Python, one value at a time."""
    x, n = sorted(values), len(values)
    m = [NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    ssq, u = sum(v * v for v in m), 1 / math.sqrt(n)
    an = m[-1] / math.sqrt(ssq) + sum(c * u**k for k, c in enumerate(normal.LAST))
    if n > 5:
        am = m[-2] / math.sqrt(ssq) + sum(c * u**k for k, c in enumerate(normal.LAST_BUT_ONE))
        phi = (ssq - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * am**2)
        a = [-an, -am] + [v / math.sqrt(phi) for v in m[2:-2]] + [am, an]
    else:
        phi = (ssq - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a = [-an] + [v / math.sqrt(phi) for v in m[1:-1]] + [an]
    mean = sum(x) / n
    return sum(p * q for p, q in zip(a, x)) ** 2 / sum((v - mean) ** 2 for v in x)


def test_quantiles(spark):
    points = [1e-15, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.925, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in points], "p double").select("p", F.expr("p - 0.5").alias("q"), F.expr("sqrt(-ln(least(p, 1 - p)))").alias("t"))
    for p, z in df.select("p", F.expr(normal.quantile_sql("q", "t"))).collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), rel=1e-7, abs=1e-12)


def test_shapiro(spark):
    draw = np.random.default_rng(6)
    groups = {"men": MEN, "line": LINE, "four": [1, 2, 4, 9], "five": [1, 2, 3, 4, 50], "ties": [0] * 30 + draw.integers(0, 9, 40).tolist(),
              "many": draw.normal(5, 2, 400).tolist(), "skew": draw.exponential(1, 120).tolist(), "three": [1, 2, 4], "two": [1, 2], "flat": [7] * 20}
    df = spark.createDataFrame([(k, float(v)) for k, values in groups.items() for v in values] + [("men", None), ("men", math.nan)], "k string, v double")
    found = {r.k: r for r in normal.shapiro_wilk(df, ["k"], "v").collect()}
    for k in ("men", "line", "four", "five", "ties", "many", "skew"):
        assert found[k].n == len(groups[k]) and found[k].w == pytest.approx(by_hand(groups[k]), rel=1e-9), k
    assert found["men"].w == pytest.approx(0.79, abs=0.005) and found["men"].p == pytest.approx(0.0067, abs=0.0005)
    assert found["line"].w == pytest.approx(0.9701646, abs=1e-6) and found["line"].p == pytest.approx(0.8923673, abs=1e-4)
    assert found["three"].w == pytest.approx(0.9642857, abs=1e-6) and found["three"].p == pytest.approx(0.6368868, abs=1e-5)
    assert found["skew"].p < 1e-6 < 0.01 < found["many"].p
    assert found["two"].w is None and found["flat"].p is None
    whole = normal.shapiro_wilk(df.filter("k = 'ties'"), [], "v").first()
    assert whole.w == pytest.approx(found["ties"].w)


def test_chunks_of_equal_values(spark, monkeypatch):
    monkeypatch.setattr(normal, "CHUNK", 7)
    values = [0] * 30 + list(range(20))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert normal.shapiro_wilk(df, [], "v").first().w == pytest.approx(by_hand(values), rel=1e-9)


def test_kolmogorov_for_small_and_large_arguments(spark):
    # 1 - K(x) for x = 0.2, 0.5, 1, 1.36, 2.
    df = spark.createDataFrame([(x,) for x in (0.02, 0.2, 0.5, 0.999999, 1.0, 1.36, 2.0)], "d double")
    p = [r[0] for r in df.select(normal.kolmogorov_p(F.col("d"), F.lit(1))).collect()]
    assert p == pytest.approx([1.0, 1.0, 0.9639452436648751, 0.2700011, 0.26999967167735456, 0.0494859, 0.0006709252557796953], abs=1e-6)


def test_choice_by_size(spark):
    draw = np.random.default_rng(1)
    rows = [(n, float(v)) for n in (20, 49, 50, 299, 300) for v in draw.normal(size=n)]
    found = {r.k: (r.test, r.n) for r in normal.normality_by_size(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert found == {20: ("normalTest", 20), 49: ("normalTest", 49), 50: ("shapiro", 50), 299: ("shapiro", 299), 300: ("kstest", 300)}
