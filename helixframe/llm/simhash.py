"""SimHash near-duplicates by a forest of vantage-point trees.

Fingerprints are spread almost evenly over 64 bits, where the distances to a vantage point differ by only
a few bits: within 3 bits, one cut at the median sends six of ten points to both sides. The upper levels
therefore work in subspaces, where the same triangle bound is sharp. Two fingerprints within r bits agree
wholly on some of the `views` blocks of bits, so there their distances to every vantage point are equal
and the shells of the upper tree do not overlap: the shell paths are the values of the blocks. Below,
cells with many members are cut by the whole Hamming distance to a vantage point of their own; a shell
also gets the members of the r shells above it, since a neighbour can be no further off. What is still
large is cut into blocks that meet pair by pair, so no task holds an unbounded cell. Within a leaf, the
members are sorted by distance to its vantage point and only those in the window that the triangle bound
leaves are compared. A leaf returns links that join its members as all its pairs would, at most one a member.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import shaped, text_of
from helixframe.operators.graph import components
from helixframe.session import cut_lineage

#: A to Z in lower case, and every white space that words are cut at (U+0009 to U+000D) as a space.
_PLAIN = str.maketrans({c: chr(c + 32) for c in range(ord("A"), ord("Z") + 1)} | {c: " " for c in range(9, 14)})
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], dtype=np.int64)


def words_of(text: str) -> list[str]:
    return [w for w in text.translate(_PLAIN).split(" ") if w]


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    shingles = map(" ".join, zip(*(words[k:] for k in range(width)))) if len(words) > width else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8")
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text_col: str = "text") -> Column:
    """The fingerprint of a text column as a long (the same 64 bits). Null texts are empty."""

    @F.pandas_udf(T.LongType())
    def signed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return signed(text_of(docs[text_col]))


def views(radius: int, count: int, target: int = 64) -> list[int]:
    """Bit masks of subspaces such that two fingerprints within `radius` bits agree on one of them.

    Of b blocks, b - radius agree. More blocks give longer masks: the fewest are taken for which `count`
    evenly spread fingerprints leave at most `target` in a cell.
    """
    for blocks in range(radius + 1, 2 * radius + 4):
        size = 64 * (blocks - radius) // blocks
        if count / 2.0**size <= target or blocks == 2 * radius + 3:
            edges = [64 * k // blocks for k in range(blocks + 1)]
            masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
            return [sum(chosen) for chosen in itertools.combinations(masks, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _leaf(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the members as all pairs within `radius` would, by windows around a vantage point."""
    far = np.bitwise_count(values ^ values[0]).astype(np.int64)
    order = np.argsort(far, kind="stable")
    values, far = values[order], far[order]
    links = []
    if len(values) <= 32:
        a, b = np.triu_indices(len(values), 1)
        near = np.bitwise_count(values[a] ^ values[b]) <= radius
        root = list(range(len(values)))
        for at, other in zip(a[near].tolist(), b[near].tolist()):
            i, j = at, other
            while root[i] != i:
                i = root[i]
            while root[j] != j:
                j = root[j]
            if i != j:
                root[j] = i
                links.append((values[at], values[other]))
        return links
    left = np.ones(len(values), dtype=bool)
    for seed in range(len(values)):
        if not left[seed]:
            continue
        left[seed], stack = False, [seed]
        while stack:
            at = stack.pop()
            lo, hi = np.searchsorted(far, (far[at] - radius, far[at] + radius + 1))
            there = np.flatnonzero(left[lo:hi]) + lo
            hits = there[np.bitwise_count(values[there] ^ values[at]) <= radius]
            left[hits] = False
            stack.extend(hits.tolist())
            links.extend((values[at], v) for v in values[hits])
    return links


def _links(cells: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links within each cell; `cells` is (keys, fp). Cells arrive whole in sorted batches.

    They are dealt by a hash of the keys: a shuffle by the keys themselves is left out where a join by these keys stands
    below, and that join may then read its shuffle by map tasks or in skewed pieces, which parts the cells.
    """
    names = [*keys, "fp"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(table: pd.DataFrame) -> pa.RecordBatch:
            values = table["fp"].to_numpy().view(np.uint64)
            marks = table[keys].to_numpy()
            change = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            starts = np.concatenate([[0], change])
            sizes = np.diff(np.append(starts, len(table)))
            out = [np.empty((0, 2), dtype=np.uint64)]
            for size in np.unique(sizes[sizes > 1]).tolist():
                at = starts[sizes == size]
                if size <= 16:  # most cells: all of a size at once, to find the few with any link
                    i, j = np.triu_indices(size, 1)
                    near = np.bitwise_count(values[at[:, None] + i] ^ values[at[:, None] + j]) <= radius
                    at = at[near.any(axis=1)]
                out.extend(np.array(links, dtype=np.uint64) for s in at.tolist() if (links := _leaf(values[s:s + size], radius)))
            pairs = np.concatenate(out).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        rest = None
        for batch in batches:
            table = batch.to_pandas()
            table = table if rest is None else pd.concat([rest, table], ignore_index=True)
            same = (table[keys] == table[keys].iloc[-1]).all(axis=1).to_numpy()
            rest, table = table[same], table[~same]
            if len(table):
                yield found(table)
        if rest is not None and len(rest):
            yield found(rest)

    placed = cells.select(*names, F.xxhash64(*keys).alias("_dealt")).repartition("_dealt").sortWithinPartitions(*names)
    return placed.select(*names).mapInArrow(search, "a long, b long")


def near_links(prints: DataFrame, radius: int = 3, leaf: int = 1024) -> DataFrame:
    """(a, b): links within `radius` bits between distinct fingerprints (`fp` long) that join them as all such pairs would."""
    distinct = cut_lineage(prints.select("fp").distinct())
    masks = views(radius, distinct.count())
    filed = distinct.select(
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("view", "cell"), "fp"
    )
    sizes = filed.groupBy("view", "cell").agg(F.count("*").alias("members"), F.min("fp").alias("vantage")).filter("members > 1")
    sizes = cut_lineage(sizes)
    small = filed.join(sizes.filter(F.col("members") <= leaf), ["view", "cell"], "left_semi")
    links = _links(small, ["view", "cell"], radius)
    large = sizes.filter(F.col("members") > leaf)
    if large.isEmpty():
        return links
    # Shells around the vantage point; a member also visits the shells below it that may hold neighbours.
    own = filed.join(large, ["view", "cell"]).withColumn("far", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
    shells = own.select("view", "cell", "fp", F.explode(F.sequence(F.greatest(F.col("far") - radius, F.lit(0)), F.col("far"))).alias("shell"))
    shell_sizes = shells.groupBy("view", "cell", "shell").agg(F.count("*").alias("members"))
    shells = shells.join(shell_sizes, ["view", "cell", "shell"])
    # Blocks of a large shell meet pair by pair, each pair in a leaf of its own.
    blocks = F.ceil(F.col("members") / leaf).cast("int")
    block = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    pairs = shells.withColumn("blocks", blocks).withColumn("block", block).select(
        "view", "cell", "shell", "fp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), "block"
    ).select("view", "cell", "shell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "fp")
    return links.union(_links(pairs, ["view", "cell", "shell", "low", "high"], radius))


def _solve(docs: DataFrame, radius: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) by row, and (fp, root, component_id, copies) by fingerprint."""
    rows = shaped(docs, doc_id="long", text="string")
    rows = cut_lineage(rows.select("doc_id", F.xxhash64(text_of()).alias("text_key"), fingerprints(rows, width).alias("fp")))
    prints = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")))
    labels = components(near_links(prints, radius)).withColumnRenamed("component", "root")
    nodes = prints.join(labels, prints.fp == labels.node, "left").select(
        "fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, cut_lineage(nodes.join(least, "root").select("fp", "root", "component_id", "copies"))


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, copies), one row per row of `docs`.

    A component is what can be reached over fingerprints within `radius` bits, its id the smallest doc_id
    in it; `copies` counts the rows with the same fingerprint. Equal fingerprints are one node, so copies
    cost nothing. Null and empty texts and texts of white space have fingerprint zero, which links like any
    other. Null ids are kept and never name a component, unless it has no other id. Repeated rows stay; other
    columns are not read; an empty table gives an empty result.
    """
    rows, nodes = _solve(docs, radius, width)
    return rows.join(nodes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def keep_first(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """One row of each component with all its columns: that of the smallest doc_id, nulls last; equal rows count once.

    Texts are joined by id and hash, so they are shuffled once; only repeated rows need a second look.
    """
    rows, nodes = _solve(docs, radius, width)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = rows.join(nodes, "fp").groupBy("root").agg(first.alias("k")).select(
        F.col("k.doc_id").alias("_kept_id"), F.col("k.text_key").alias("_kept_text"))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_of(docs["text"])) == F.col("_kept_text"))
    twice = cut_lineage(rows.groupBy("doc_id", "text_key").count().filter("count > 1")
                        .select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_text")))
    if twice.isEmpty():
        return docs.join(kept, same, "left_semi")
    kept = cut_lineage(kept)
    equal = F.col("_kept_id").eqNullSafe(F.col("_i")) & (F.col("_kept_text") == F.col("_t"))
    pairs = twice.select(F.col("_kept_id").alias("_i"), F.col("_kept_text").alias("_t"))
    once = docs.join(kept.join(pairs, equal, "left_anti"), same, "left_semi")
    return once.unionByName(docs.join(kept.join(pairs, equal, "left_semi"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
