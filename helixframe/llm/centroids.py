"""Centroid clustering with bounds that follow the net displacement of centroids (ns-bounds).

Every vector keeps, for each centroid, the exact squared distance of its last evaluation and the round of it. The
history of the centroids is kept too, so in a later round the stored distance is loosened by the norm of the total
displacement between those two rounds. That is never more than the sum of the drifts of the rounds between. A vector
whose loosened own distance stays below all other bounds keeps its centroid; else the bounds that fail are evaluated
again, exactly, in integers. Vectors and their bounds are a written table; only centroids, which the number of
clusters bounds, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import finite_integers, shaped, written

#: Components reach below this in absolute value, so squared distances of up to 64 components fit a long.
LARGEST = 1 << 27
STATE = "vec_id long, vector array<int>, cluster int, distance long, far array<long>, seen array<int>, evaluated int"


def _matrix(column: pa.Array, width: int, kind: str = "int64") -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def displacement(history: np.ndarray) -> np.ndarray:
    """(rounds, clusters): how far each centroid now is from where it was in each round, rounded up."""
    moved = (history[-1] - history).astype(float)
    return np.sqrt((moved * moved).sum(axis=2)) * (1 + 1e-9)


def reassign(
    x: np.ndarray, cluster: np.ndarray, far: np.ndarray, seen: np.ndarray, history: np.ndarray, moved: np.ndarray, exact_own: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row of `x`, ties to the smaller number, and how many distances that took.

    `far` and `seen` hold squared distances and the rounds they come from (negative: never), and are brought up to date.
    """
    now, rows = len(history) - 1, np.arange(len(x))
    centroids = history[now]
    new = seen[:, 0] < 0

    def evaluate(i: np.ndarray, j: np.ndarray) -> None:
        far[i, j] = ((x[i] - centroids[j]) ** 2).sum(axis=1)
        seen[i, j] = now

    bound = np.sqrt(far.astype(float))
    loose = moved[seen, np.arange(far.shape[1])]
    low = bound * (1 - 1e-9) - loose
    high = bound[rows, cluster] * (1 + 1e-9) + loose[rows, cluster]
    low[rows, cluster] = np.inf
    failed = new | (high >= low.min(axis=1, initial=np.inf))
    work = np.zeros(len(x), dtype=np.int32)
    again = np.flatnonzero(failed | exact_own)
    again = again[seen[again, cluster[again]] != now]
    evaluate(again, cluster[again])
    work[again] += 1
    # The own distance is exact now: only bounds that do not lie above it are looked at again.
    at = np.flatnonzero(failed)
    own = np.sqrt(far[at, cluster[at]].astype(float)) * (1 + 1e-9)
    open_ = (low[at] <= own[:, None]) | new[at, None]
    open_[np.arange(len(at)), cluster[at]] = False
    i, j = np.nonzero(open_)
    evaluate(at[i], j)
    np.add.at(work, at[i], 1)
    open_[np.arange(len(at)), cluster[at]] = True
    known = np.where(open_, far[at], np.iinfo(np.int64).max)
    cluster = cluster.copy()
    cluster[at] = known.argmin(axis=1)
    return cluster, work


def _assigned(state: DataFrame, history: np.ndarray, last: bool) -> DataFrame:
    moved, k, width = displacement(history), history.shape[1], history.shape[2]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            cluster = batch.column(2).to_numpy(zero_copy_only=False)
            far, seen = _matrix(batch.column(4), k).copy(), _matrix(batch.column(5), k, "int32").copy()
            cluster, work = reassign(x, cluster, far, seen, history, moved, last)
            distance = far[np.arange(len(x)), cluster]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), _lists(far, pa.int64()),
                _lists(seen, pa.int32()), pa.array(batch.column(6).to_numpy() + work, pa.int32())], names=[c.split()[0] for c in STATE.split(", ")])

    return written(state.mapInArrow(step, STATE), "centroid-state")


def _centres(state: DataFrame, before: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one stays. Tasks add up their own rows first."""
    k, width = before.shape

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, width + 1), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                cluster = batch.column(1).to_numpy()
                np.add.at(sums[:, :width], cluster, _matrix(batch.column(0), width))
                sums[:, width] += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(sums[:, width])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), _lists(sums[used], pa.int64())], names=["cluster", "sums"])

    parts = state.select("vector", "cluster").mapInArrow(totals, "cluster int, sums array<long>")
    cells = parts.select("cluster", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("part").alias("total"))
    after = np.array(before)
    found: dict[int, dict[int, int]] = {}
    for r in cells.collect():  # clusters x components, whatever the number of vectors
        found.setdefault(r["cluster"], {})[r["place"]] = r["total"]
    for cluster, sums in found.items():
        after[cluster] = [sums[place] // sums[width] for place in range(width)]
    return after


def clustered(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1, vector: str | Column = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluated), one row per kept row of `vectors`.

    Kept are vectors of exactly `width` components, none null or not finite; components become floor(scale * x). The
    first centroids are the vectors of the smallest SHA-256 of `seed:vec_id`; ties, and rows without an id, which come
    last, go by their components. With fewer kept vectors than `clusters` there are as many centroids as vectors.
    `evaluated` is the number of exact distances that the vector took in all its rounds + 1 assignments. A component of
    2**27 or more makes squared distances leave a long: such a vector is returned with nulls and moves no centroid.
    Repeated rows and null ids stay and count each; other columns are not read; an empty table gives an empty result.
    """
    rows = shaped(vectors.withColumn("_vector", vectors[vector] if isinstance(vector, str) else vector), vec_id="long", _vector="array<double>")
    kept = rows.filter(F.size("_vector") == width).select("vec_id", finite_integers(F.col("_vector"), scale, LARGEST).alias("cell")).filter("cell.ok")
    fit = kept.filter("cell.fits").select("vec_id", F.col("cell.parts").alias("vector"))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = fit.orderBy(key.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()  # `clusters` vectors
    history = np.array([r["vector"] for r in start], dtype=np.int64).reshape(1, len(start), width)
    none = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"), ("evaluated", "int"))]
    beyond = kept.filter("NOT cell.fits").select("vec_id", *none)
    if not start:
        return beyond
    k = len(start)
    state = fit.select("vec_id", "vector", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"),
                       F.array_repeat(F.lit(0).cast("long"), k).alias("far"), F.array_repeat(F.lit(-1), k).alias("seen"), F.lit(0).alias("evaluated"))
    for _ in range(rounds):
        state = _assigned(state, history, False)
        history = np.concatenate([history, _centres(state, history[-1])[None]])
    state = _assigned(state, history, True)
    sums = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in history[-1]]
    about = vectors.sparkSession.createDataFrame(
        [(j, sums.get(j, 0), sum(sums.values()), digests[j]) for j in range(k)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance", "evaluated").join(F.broadcast(about), "cluster").select(
        "vec_id", *[c for c in beyond.columns[1:]]).unionByName(beyond)
