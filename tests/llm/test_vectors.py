"""Hard negatives and centroid clustering against brute force, and on odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import centroids, negatives

SCHEMA = "vec_id long, label int, embedding array<float>, cluster int, score double, key long, extra string"


def vectors(llm, rows):
    return llm.createDataFrame([(i, y, v, 9, 0.5, 1, "x") for i, y, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def many():
    draw = np.random.default_rng(3)
    x = np.round(draw.normal(0, 0.3, (300, 64)), 1)  # rounded, so that scores and distances tie
    x[40:60] = x[40]
    return [(k * 5, k % 3, x[k].tolist()) for k in range(300)]


ODD = [(1, None, [0.5] * 64), (2, 1, None), (3, 1, [None] * 64), (4, 1, [math.nan] * 64), (5, 1, [math.inf] * 64), (6, 1, []), (None, 1, [0.25] * 64),
       (200, 1, [0.5] * 64), (200, 1, [0.5] * 64), (300, 1, [1e6] * 64), (700, 2, [0.5] * 63), (8, 2, [0.5] * 64), (9, 1, [0.5] * 64)]


def brute_negatives(rows, is_anchor):
    """All scores of every anchor, sorted."""
    kept = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
            if y is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 1e5 for x in v)]
    out, seen = [], set()
    for i, y, v in kept:
        if i is None or not is_anchor(i) or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        others = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, z) for j, z, w in kept if j != i)
        for top, none, positive, _ in [o for o in others if o[3] == y][:5]:
            fit = [o for o in others if o[3] != y and -80 * top <= -100 * o[0] <= -100 * top][:5]
            out += [(i, None if none else positive, k, None if o[1] else o[2], -top, -o[0]) for k, o in enumerate(fit, 1)]
    return sorted(map(str, out))


def floats(rows):
    return [(i, y, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, y, v in rows]


@pytest.mark.parametrize("block_rows, shard_blocks", [(1000, 64), (16, 2)])
def test_negatives_equal_brute_force(llm, many, block_rows, shard_blocks):
    rows = many + ODD
    found = negatives.hard_negatives(vectors(llm, rows), F.col("vec_id") % 100 == 0, block_rows=block_rows, shard_blocks=shard_blocks)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(str(tuple(r)) for r in found.collect())
    assert got == brute_negatives(floats(rows), lambda i: i % 100 == 0) and got


def test_scan_drops_rows_before_the_last_dimension(many):
    x = np.floor(256 * np.array([v for _, _, v in many])).astype(np.int32).T
    x[:8] *= 40  # few dimensions decide
    block = negatives.Block({"ids": np.arange(300).tobytes(), "unnamed": np.zeros(300, dtype=bool).tobytes(), "labels": np.zeros(300, dtype=np.int32).tobytes(),
                             "columns": [c.tobytes() for c in x], "least": x.min(axis=1).tolist(), "most": x.max(axis=1).tolist()})
    anchor = x[:, np.abs(x[0]).argmax()].astype(np.int64)
    left, exact = [], x.astype(np.int64).T @ anchor
    floor = int(np.sort(exact)[-5])

    def useful(low, high):
        left.append(len(low))
        assert (low <= high).all()
        return high >= floor

    places, scores = block.scan(anchor, np.ones(300, dtype=bool), useful)
    assert left[2] < 300 and left == sorted(left, reverse=True)
    assert scores.tolist() == exact[places].tolist() and set(np.flatnonzero(exact >= floor)) <= set(places.tolist())


def test_negatives_of_nothing(llm):
    assert negatives.hard_negatives(vectors(llm, []), F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(vectors(llm, ODD[:6]), F.col("vec_id") % 100 == 0).count() == 0


def brute_clusters(rows, clusters, rounds):
    ids = [i for i, _ in rows]
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], dtype=np.int64)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, hashlib.sha256(f"1:{ids[k]}".encode()).hexdigest(), x[k].tolist()))
    c = x[order[:clusters]]
    for k in range(rounds + 1):
        distance = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = distance.argmin(axis=1)
        if k < rounds:
            c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    near = distance.min(axis=1)
    digest = [hashlib.sha256(",".join(map(str, r.tolist())).encode()).hexdigest() for r in c]
    return sorted(str((i, int(j), int(d), int(near[own == j].sum()), int(near.sum()), digest[j])) for i, j, d in zip(ids, own, near))


@pytest.mark.parametrize("clusters, rounds", [(16, 3), (7, 6), (400, 1)])
def test_clusters_equal_brute_force(llm, many, clusters, rounds):
    rows = floats(many + [r for r in ODD if r[2] == [0.5] * 64 or r[0] is None])
    found = centroids.clustered(vectors(llm, rows).repartition(3), clusters, rounds)
    got = sorted(str(tuple(r)) for r in found.drop("evaluated").collect())
    assert got == brute_clusters([(i, v) for i, _, v in rows], clusters, rounds)


def test_bounds_save_distances(llm):
    draw = np.random.default_rng(5)
    middle = draw.normal(0, 3, (8, 64))
    rows = [(k, 0, (middle[k % 8] + draw.normal(0, 0.1, 64)).tolist()) for k in range(400)]
    found = centroids.clustered(vectors(llm, rows), 8, 5).agg(F.avg("evaluated")).first()[0]
    assert found < 0.5 * 8 * 6


def test_net_displacement_is_tighter_than_drifts():
    history = np.array([[[0, 0]], [[30, 40]], [[0, 0]]])
    assert centroids.displacement(history)[:, 0] == pytest.approx([0, 50, 0])


def test_clusters_of_odd_rows(llm):
    found = {(r.vec_id, r.distance is None) for r in centroids.clustered(vectors(llm, ODD + [(10, 1, [3e6] * 64)])).collect()}
    assert (10, True) in found and {i for i, _ in found} == {1, 8, 9, 10, 200, 300, None}
    assert centroids.clustered(vectors(llm, ODD[1:6])).count() == 0
    assert centroids.clustered(vectors(llm, [])).columns[:3] == ["vec_id", "cluster", "distance"]
