import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.functions import ordered, tails
from helixframe.operators import intervals as iv
from helixframe.operators import statistics as st


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, and one value a third of them."""
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else "cold", 0.0 if rng.random() < 0.33 else round(rng.random() * 50, 1)) for _ in range(3000)]
    return pd.DataFrame(rows, columns=["g", "v"]), spark.createDataFrame(rows, "g string, v double")


def test_average_rank_matches_pandas(skewed):
    pdf, df = skewed
    pdf = pdf.assign(rank=pdf.groupby("g")["v"].rank())
    got = ordered.average_rank(df, ["g"], "v").toPandas()
    key = ["g", "v", "rank"]
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), pdf[key].sort_values(key).reset_index(drop=True))


def test_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = {r.g: r for r in ordered.quantiles(df, ["g"], "v", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for g, part in pdf.groupby("g"):
        assert [got[g].a, got[g].b, got[g].c] == pytest.approx(list(np.quantile(part["v"], [0.25, 0.5, 0.9])))


def test_numbered_rows_are_consecutive(spark):
    df = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = sorted((r.k, r.row_no) for r in ordered.number_rows(df, "k").collect())
    assert [n for _, n in rows] == list(range(1, len(rows) + 1))


def test_step_up_is_monotone_and_not_below_p(spark):
    rng = random.Random(5)
    ps = [round(rng.random() ** 3, 4) for _ in range(400)]
    got = st.adjust(spark.createDataFrame([(p,) for p in ps], "p double"), []).collect()
    assert all(r.q >= r.p - 1e-12 for r in got)
    qs = [r.q for r in sorted(got, key=lambda r: r.p)]
    assert all(a <= b + 1e-12 for a, b in zip(qs, qs[1:]))
    m, best, want = len(ps), 1.0, {}
    for i in range(m, 0, -1):
        best = min(best, sorted(ps)[i - 1] * m / i)
        want.setdefault(sorted(ps)[i - 1], best)
    lowest = {}
    for r in got:
        lowest[r.p] = r.q
    for p, q in lowest.items():
        assert q <= want[p] + 1e-9


@pytest.fixture(scope="module")
def features():
    rng = random.Random(11)
    feats = []
    for i in range(120):
        start = rng.randrange(0, 40000)
        feats.append((rng.choice("ab"), start, start + rng.choice([1, 20, 300, 9000]), i))
    points = [(rng.choice("ab"), rng.randrange(-10, 50000)) for _ in range(300)]
    return feats, points


def test_points_in_intervals_equals_brute_force(spark, features):
    feats, points = features
    f = spark.createDataFrame(feats, "chrom string, start long, end long, i long")
    p = spark.createDataFrame(points, "chrom string, pos long")
    got = sorted((r.chrom, r.pos, r.i) for r in iv.points_in_intervals(p, f).collect())
    want = sorted((c, x, i) for c, x in points for d, s, e, i in feats if c == d and s <= x <= e)
    assert got == want


def test_half_of_what_a_point_meets_holds_it(spark):
    lengths = [*range(200), 255, 256, 599, 33_600, 1 << 40, (1 << 62) - 1, 1 << 62]
    rows = spark.createDataFrame([(n,) for n in lengths], "n long").select("n", iv._bin_size(F.col("n")).alias("size")).collect()
    assert all(r.size <= r.n + 1 <= 4 * r.size for r in rows)
    f = spark.createDataFrame([("a", 5, 5, 1), ("a", 9, -(10**12), 2), ("a", None, 7, 3), ("a", -7, 5, 4)], "chrom string, start long, end long, i long")
    p = spark.createDataFrame([("a", x) for x in range(-9, 9)], "chrom string, pos long")
    assert sorted((r.pos, r.i) for r in iv.points_in_intervals(p, f).collect()) == sorted([(5, 1), *((x, 4) for x in range(-7, 6))])


def test_depth_meets_regions_once_for_stretches_that_lie_alike(spark, monkeypatch):
    rng = random.Random(4)
    reads = [("a", s, s + rng.choice([3, 8]), f"q{k // 2}") for k in range(400) for s in [rng.randrange(0, 20, 5)]] + [("a", 7, 7, "none")]
    regions, seen = [("a", 0, 10), ("a", 6, 30), ("a", 100, 110)], []
    overlaps = iv.overlaps
    monkeypatch.setattr(iv, "overlaps", lambda a, b, *more: seen.append(a.count()) or overlaps(a, b, *more))
    got = iv.base_depth(spark.createDataFrame(reads, "chrom string, start long, end long, qname string"), spark.createDataFrame(regions, "chrom string, start long, end long"))
    want = {}
    for c, lo, hi in regions:
        for x in range(lo, hi):
            if n := len({q for _, s, e, q in reads if s <= x < e}):
                want[c, lo, hi, x] = n
    assert {(r.chrom, r.start, r.end, r.pos): r.depth for r in got.collect()} == want
    assert seen[0] < 30


def test_overlaps_equals_brute_force(spark, features):
    feats, _ = features
    f = spark.createDataFrame(feats, "chrom string, start long, end long, i long")
    got = sorted((r.i, r.b_i, r.shared) for r in iv.overlaps(f, f).collect())
    want = sorted((i, j, min(e, y) - max(s, x)) for c, s, e, i in feats for d, x, y, j in feats if c == d and s < y and x < e)
    assert got == want


@pytest.mark.parametrize("n", [1, 3])
def test_nearest_features_equals_brute_force(spark, features, n):
    feats, points = features
    points = points[:120]
    f = spark.createDataFrame(feats, "chrom string, start long, end long, i long")
    p = spark.createDataFrame(points, "chrom string, pos long")
    got = sorted((r.chrom, r.pos, r.i, r.distance) for r in iv.locate(p, f, n).collect())
    want = []
    for c, x in sorted(set(points)):
        mine = [t for t in feats if t[0] == c]
        inside = [(c, x, i, 0) for _, s, e, i in mine if s <= x <= e]
        if not inside:
            for side in ([(x - e, i) for _, s, e, i in mine if e < x], [(x - s, i) for _, s, e, i in mine if s > x]):
                gaps = sorted(abs(d) for d, _ in side)
                if gaps:
                    reach = gaps[min(n, len(gaps)) - 1]
                    inside += [(c, x, i, d) for d, i in side if abs(d) <= reach]
        want += inside
    assert got == sorted(want)


def test_within_distance_equals_brute_force(spark):
    rng = random.Random(2)
    left = [("a", rng.randrange(5000)) for _ in range(200)]
    right = [("a", rng.randrange(5000)) for _ in range(40)]
    got = iv.within_distance(spark.createDataFrame(left, "chrom string, pos long"), spark.createDataFrame(right, "chrom string, pos long"), 30, width=256)
    want = sorted((x, min(g) if (g := [abs(x - y) for _, y in right if abs(x - y) < 30]) else -1) for _, x in left)
    assert sorted((r.pos, -1 if r.gap is None else r.gap) for r in got.collect()) == want


def test_tails_against_closed_forms():
    assert tails.beta_inc(2, 3, 0.4) == pytest.approx(sum(math.comb(4, j) * 0.4**j * 0.6 ** (4 - j) for j in range(2, 5)))
    # One degree of freedom is the Cauchy distribution.
    t = 1.7
    assert tails.beta_inc(0.5, 0.5, 1 / (1 + t * t)) == pytest.approx(2 * (0.5 - math.atan(t) / math.pi))
    q = float(tails.beta_quantile(0.3, 2, 3))
    assert tails.beta_inc(2, 3, q) == pytest.approx(0.3, abs=1e-9)
    assert tails.binomial_cdf(3, 10, 0.4) == pytest.approx(sum(math.comb(10, j) * 0.4**j * 0.6 ** (10 - j) for j in range(4)))
    N, K, n = 60, 17, 22
    for k in range(0, 18):
        want = sum(math.comb(K, x) * math.comb(N - K, n - x) for x in range(k, min(K, n) + 1)) / math.comb(N, n)
        got = tails.hypergeometric_upper(np.array([k]), np.array([N]), np.array([K]), np.array([n]))[0]
        assert got == pytest.approx(want, rel=1e-9)
