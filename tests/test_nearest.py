"""Bins of intervals, positions that no feature holds, and the work done for each row."""

import random

from pyspark.sql import functions as F

from helixframe.functions import ordered
from helixframe.operators import intervals as iv


def test_bin_sizes_at_their_limits(spark):
    lengths = sorted({x + d for k in range(32) for x in (4**k,) for d in (-2, -1, 0, 1) if x + d < 2**63} | {-5, 2**63 - 1})
    rows = spark.createDataFrame([(x,) for x in [*lengths, None]], "x long").select("x", iv._bin_size(F.col("x")).alias("s")).collect()
    for x, size in rows:
        assert size == (None if x is None or x < 0 else max(s for s in iv.SIZES if s == 1 or s <= x + 1))
    # One short expression, so that a row's code stays small enough to be compiled.
    assert len(iv._bin_size(F.col("x"))._jc.toString()) < 1000


def test_positions_without_a_feature(spark):
    draw = random.Random(3)
    features = [("c", s, s + draw.randrange(-2, 9), k) for k in range(60) for s in [draw.randrange(400)]] + [("c", None, 5, 90), ("c", 5, None, 91), (None, 0, 400, 92)]
    spots = [(c, p) for c in ("c", "d", None) for p in [*range(-5, 420, 3), None]]
    f = spark.createDataFrame(features, "chrom string, start long, end long, feature long")
    s = spark.createDataFrame(spots, "chrom string, pos long")
    for width in (7, 16_384):
        got = {tuple(r) for r in iv._loose(s, f, width).collect()}
        assert got == {(c, p) for c, p in spots if None not in (c, p) and not any(h == c and None not in (a, e) and a <= p <= e for h, a, e, _ in features)}
    # Where every position is held, nothing is ranked.
    whole = spark.createDataFrame([("c", 0, 500, 1), ("c", 3, 9, 2)], "chrom string, start long, end long, feature long")
    held = spark.createDataFrame([("c", 5), ("c", 5), ("c", 400)], "chrom string, pos long")
    assert sorted((r.pos, r.feature, r.distance) for r in iv.locate(held, whole, 2).collect()) == [(5, 1, 0), (5, 2, 0), (400, 1, 0)]


def test_rows_below_an_aggregate_are_not_tested_for_a_range(spark):
    df = spark.createDataFrame([("a", float(k % 7)) for k in range(50)], "k string, v double")
    out = ordered.tie_counts(df, ["k"], "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "filter(" in x]
    got = {r.v: (r.ties, r.upto, r.dense) for r in out.collect()}
    assert got[0.0] == (8, 8, 1) and got[6.0] == (7, 50, 7)
