import random

import numpy as np

from helixframe.functions import ordered
from helixframe.operators import expression


def test_quantiles_order_only_the_ranges_they_need(spark):
    draw = random.Random(2)
    rows = [("a", float(draw.randint(0, 50))) for _ in range(3000)] + [("b", draw.random()) for _ in range(501)] + [("c", 7.0), ("d", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    points = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.95, "hi": 1.0}
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", points).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        own = [v for x, v in rows if x == k]
        assert got[k].n == len(own) and np.allclose([got[k][p] for p in points], [np.quantile(own, q) for q in points.values()])
    whole = ordered.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole[0].m == np.median([v for _, v in rows if v is not None])


def test_size_factors_read_the_counts_once(spark):
    rows = [(g, f"s{k}", float((g + 1) * (k + 1) + g % 3)) for g in range(40) for k in range(4)] + [(None, "s0", 5.0), (99, "s1", 0.0), (98, "s2", 4.0)]
    counts = spark.createDataFrame(rows, "gene long, sample string, value double")
    out = expression.size_factors(counts, 4)
    assert "gene" not in out._jdf.queryExecution().optimizedPlan().toString()
    logs = np.log(np.array([[(g + 1) * (k + 1) + g % 3 for k in range(4)] for g in range(40)]))
    want = np.exp(np.median(logs - logs.mean(axis=1, keepdims=True), axis=0))
    assert np.allclose([r.size_factor for r in out.orderBy("sample").collect()], want)
