"""Hard negatives by a vertical scan of columnar blocks (branch and bound on decomposed data).

Rows are packed into blocks that hold one column per dimension, with its least and largest value. An anchor reads the
columns of a block in descending order of its own magnitudes and adds up partial inner products. What the dimensions
still unread can add lies between sums of their least and largest contributions; rows whose bounds leave the anchor's
windows, or cannot reach the best found so far, drop out of the candidate bitmap. The few left are read to the end, so
scores and windows are exact. A shard is a bounded number of blocks; every anchor visits every shard, and only its best
rows of a shard are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import finite_integers, shaped
from helixframe.session import cut_lineage

BLOCK_ROWS = 8192
SHARD_BLOCKS = 64
#: Dimensions read between two looks at the bounds.
STRIDE = 8
#: Components reach below this in absolute value, so that 100 times a score of 64 components fits a long.
LARGEST = 1 << 25

BLOCK = "ids binary, unnamed binary, labels binary, dims int, columns array<binary>, least array<int>, most array<int>"


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """Columnar blocks of (vec_id, label, vector), packed where the rows are. Shorter vectors end in zeros."""

    def packed(ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        dims = max(map(len, vectors))
        x = np.zeros((dims, len(vectors)), dtype=np.int32)
        for k, v in enumerate(vectors):
            x[:len(v), k] = v
        named = np.array([i is not None for i in ids])
        row = [np.array([i or 0 for i in ids], dtype=np.int64).tobytes(), (~named).tobytes(), np.array(labels, dtype=np.int32).tobytes(), dims,
               [c.tobytes() for c in x], x.min(axis=1).tolist(), x.max(axis=1).tolist()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (
            pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32())))], names=[c.split()[0] for c in BLOCK.split(", ")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        for batch in batches:
            for into, column in zip(held, batch.columns):
                into.extend(column.to_pylist() if into is not held[2] else [np.array(v, dtype=np.int32) for v in column.to_pylist()])
            while len(held[0]) >= block_rows:
                yield packed(*(part[:block_rows] for part in held))
                held = tuple(part[block_rows:] for part in held)
        if held[0]:
            yield packed(*held)

    return rows.select("vec_id", "label", "vector").mapInArrow(pack, BLOCK)


class Block:
    """One block as arrays."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.unnamed = np.frombuffer(row["unnamed"], dtype=bool)
        self.labels = np.frombuffer(row["labels"], dtype=np.int32)
        self.columns = [np.frombuffer(c, dtype=np.int32) for c in row["columns"]]
        self.least, self.most = np.array(row["least"], dtype=np.int64), np.array(row["most"], dtype=np.int64)

    def scan(self, anchor: np.ndarray, bitmap: np.ndarray, useful: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(places, exact scores) of the rows of `bitmap` that are still `useful` by their lowest and highest possible score."""
        dims = min(len(anchor), len(self.columns))
        q = anchor[:dims]
        order = np.argsort(-np.abs(q), kind="stable")
        ends = np.stack([q * self.least[:dims], q * self.most[:dims]])[:, order]
        rest_low = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
        rest_high = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
        places = np.flatnonzero(bitmap)
        scores = np.zeros(len(places), dtype=np.int64)
        for read in range(0, dims + 1, STRIDE):
            left = useful(scores + rest_low[read], scores + rest_high[read])
            if not left.all():
                places, scores = places[left], scores[left]
            if not len(places):
                break
            for d in order[read:read + STRIDE].tolist():
                scores = scores + self.columns[d][places] * q[d]
        if len(places) and dims % STRIDE:
            left = useful(scores, scores)
            places, scores = places[left], scores[left]
        return places, scores


def _best(scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the highest scores, ties to the smaller id, rows without id last."""
    return np.lexsort((ids, unnamed, -scores))[:most]


class Best:
    """The best rows found so far."""

    def __init__(self, most: int):
        self.most = most
        self.scores, self.unnamed, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)

    def add(self, block: Block, places: np.ndarray, scores: np.ndarray) -> None:
        if len(places):
            scores = np.concatenate([self.scores, scores])
            unnamed, ids = np.concatenate([self.unnamed, block.unnamed[places]]), np.concatenate([self.ids, block.ids[places]])
            at = _best(scores, unnamed, ids, self.most)
            self.scores, self.unnamed, self.ids = scores[at], unnamed[at], ids[at]

    def floor(self) -> int | None:
        """The score that a further row must reach; none while there is room."""
        return int(self.scores[-1]) if len(self.scores) == self.most else None

    def rows(self) -> list[tuple[int | None, int]]:
        return [(None if u else i, s) for i, u, s in zip(self.ids.tolist(), self.unnamed.tolist(), self.scores.tolist())]


def positives_in(blocks: list[Block], anchor_id: int, label: int, anchor: np.ndarray, most: int) -> list[tuple]:
    """(place, id, score): the anchor's best other rows of its label."""
    best = Best(most)
    for block in blocks:
        bitmap = (block.labels == label) & (block.unnamed | (block.ids != anchor_id))

        def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            floor = best.floor()
            if len(low) > most:
                reached = int(np.partition(low, len(low) - most)[len(low) - most])
                floor = reached if floor is None else max(floor, reached)
            return np.ones(len(high), dtype=bool) if floor is None else high >= floor

        best.add(block, *block.scan(anchor, bitmap, useful))
    return [(0, i, s) for i, s in best.rows()]


def negatives_in(blocks: list[Block], anchor_id: int, label: int, anchor: np.ndarray, wanted: list[int], most: int, percent: int) -> list[tuple]:
    """(place, id, score): for each wanted positive score, by place, the best rows of other labels in its window."""
    tops = {p: Best(most) for p in dict.fromkeys(wanted) if percent * p <= 100 * p}
    for block in blocks:
        bitmap = (block.labels != label) & (block.unnamed | (block.ids != anchor_id))

        def useful(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(low), dtype=bool)
            for p, top in tops.items():
                floor = top.floor()
                keep |= (low <= p) & (100 * high >= percent * p) & (True if floor is None else high >= floor)
            return keep

        places, scores = block.scan(anchor, bitmap, useful)
        for p, top in tops.items():
            inside = (scores <= p) & (100 * scores >= percent * p)
            top.add(block, places[inside], scores[inside])
    return [(place, i, s) for place, p in enumerate(wanted) if p in tops for i, s in tops[p].rows()]


def _visited(blocks: DataFrame, anchors: DataFrame, shards: int, found: Callable[[list[Block], dict], list[tuple]]) -> DataFrame:
    """(key, place, id, score): what `found` gives for each anchor in each shard. A shard's blocks come first, then its anchors."""
    sides = blocks.withColumn("kind", F.lit(0)).unionByName(
        anchors.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1)), allowMissingColumns=True)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    shard, held = row["shard"], []
                if row["kind"] == 0:
                    held.append(Block(row))
                else:
                    out.extend((row["key"], *hit) for hit in found(held, row))
            columns = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "place", "id", "score"])

    placed = sides.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    return placed.mapInArrow(visit, "key long, place int, id long, score long")


def _top(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def hard_negatives(
    vectors: DataFrame, anchors: Column, scale: int = 256, positives: int = 5, negatives: int = 5, percent: int = 80,
    block_rows: int = BLOCK_ROWS, shard_blocks: int = SHARD_BLOCKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `vectors` where `anchors` is true.

    vectors: (vec_id, label, embedding). Rows with a null label, a null vector, or a null or non-finite component take no part.
    Components become floor(scale * x); a score is the inner product, a shorter vector ends in zeros. Higher scores come first,
    ties by smaller vec_id, null ids last. The positives of an anchor are its best other rows of its label; the negatives of a
    positive its best rows of other labels with a score from `percent` per cent of the positive's score up to that score
    (none below a negative score). A row with the anchor's own id counts as the anchor. Other repeated rows count each; equal
    anchors are one, and anchors that share an id but not their rows are searched one by one. A row with a component of 2**25
    or more takes no part, since its scores may not fit a long. An empty table gives an empty result; other columns are not read.
    """
    rows = shaped(vectors.withColumn("_anchor", anchors), vec_id="long", label="int", embedding="array<double>", _anchor="boolean")
    rows = rows.filter("label IS NOT NULL AND embedding IS NOT NULL").select(
        "vec_id", "label", F.col("_anchor"), finite_integers(F.col("embedding"), scale, LARGEST).alias("cell")).filter("cell.fits")
    rows = rows.select("vec_id", "label", "_anchor", F.col("cell.parts").alias("vector"))
    own = cut_lineage(rows.filter("_anchor AND vec_id IS NOT NULL").select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), "vector").distinct())
    own = own.withColumn("key", F.monotonically_increasing_id())
    blocks = cut_lineage(_blocks(rows, block_rows))
    # One number a block; shards are as even as its hash makes them.
    count = blocks.select("dims").count()
    shards = max(1, min(count, vectors.sparkSession.sparkContext.defaultParallelism), -(-count // shard_blocks))
    blocks = blocks.withColumn("shard", F.pmod(F.xxhash64("ids", "labels"), F.lit(shards)).cast("int"))

    def same(held: list[Block], row: dict) -> list[tuple]:
        return positives_in(held, row["anchor_id"], row["anchor_label"], np.array(row["vector"], dtype=np.int64), positives)

    best = cut_lineage(_top(_visited(blocks, own, shards, same).drop("place"), ["key"], positives).select(
        "key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    wanted = best.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("wanted"))

    def other(held: list[Block], row: dict) -> list[tuple]:
        return negatives_in(held, row["anchor_id"], row["anchor_label"], np.array(row["vector"], dtype=np.int64), row["wanted"], negatives, percent)

    found = _top(_visited(blocks, own.join(wanted, "key"), shards, other), ["key", "place"], negatives)
    return found.join(best, ["key", "place"]).join(own.select("key", "anchor_id"), "key").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
