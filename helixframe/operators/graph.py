"""Hierarchies and components by iterated joins on frontiers. Each round is written to the shared
checkpoint folder, so neither lineage nor the loss of an executor makes a round expensive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.session import cut_lineage


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) for every node under each root, itself included; edges is (node, parent).

    The edges are written once for all rounds, and the joins of a round pass nothing through the driver.
    """
    step = cut_lineage(edges.filter(F.col("node") != F.col("parent")).select(F.col("parent").alias("_p"), F.col("node").alias("_n")).distinct())
    parts = [cut_lineage(roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node")).distinct())]
    while True:
        reached = parts[-1].join(step.hint("merge"), F.col("node") == F.col("_p")).select("root", F.col("_n").alias("node")).distinct()
        frontier = cut_lineage(reached.join(_all(parts).hint("merge"), ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return _all(parts)
        parts.append(frontier)


def _all(parts: list[DataFrame]) -> DataFrame:
    """The rounds so far as one table; each is written once and none is written again."""
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def subtree_expression(edges: DataFrame, expression: str) -> DataFrame:
    """Nodes of ``a-b-c`` or ``a+b`` over subtrees, read from left to right.

    As in the notation this follows, + (like &) is the intersection and - the difference; | is the union.
    """
    names = re.split(r"[-+&|]", expression)
    operators = re.findall(r"[-+&|]", expression)
    if not all(re.fullmatch(r"\w+", n) for n in names):
        raise ValueError(f"not a subtree expression: {expression!r}")
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["node"]
    roots = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "root string").select(F.col("root").cast(kind))
    members = descendants(edges, roots)

    def part(name: str) -> DataFrame:
        return members.filter(F.col("root") == F.lit(name).cast(kind)).select("node")

    out = part(names[0])
    for op, name in zip(operators, names[1:]):
        if op == "-":
            out = out.join(part(name), "node", "left_anti")
        elif op == "|":
            out = out.union(part(name)).distinct()
        else:
            out = out.join(part(name), "node", "left_semi")
    return out


def depth(edges: DataFrame) -> DataFrame:
    """(node, depth): the longest way up along parents; a node without a parent other than itself has 0.

    Edges are written once, and the joins of a round pass nothing through the driver.
    A round takes the nodes one step further down, so more rounds than nodes mean a cycle, which is an error, as is a
    graph of which some node cannot be reached from a root.
    """
    nodes = edges.select("node").union(edges.select(F.col("parent"))).filter("node IS NOT NULL").distinct()
    nodes = cut_lineage(nodes)
    up = cut_lineage(edges.select("node", "parent").filter("node <> parent").distinct())
    rounds = [cut_lineage(nodes.join(up.hint("merge"), "node", "left_anti").select("node", F.lit(0).alias("depth")))]
    count = nodes.count()
    below = up.select(F.col("node").alias("_child"), "parent")
    while True:
        if len(rounds) > count + 1:
            raise ValueError("the hierarchy holds a cycle")
        current = cut_lineage(
            rounds[-1].join(below.hint("merge"), F.col("node") == F.col("parent"))
            .select(F.col("_child").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        )
        if current.isEmpty():
            break
        rounds.append(current)
    out = cut_lineage(_all(rounds).groupBy("node").agg(F.max("depth").alias("depth")))
    if out.count() < count:
        raise ValueError("the hierarchy holds a cycle")
    return out


def nodes_by_rank(nodes: DataFrame) -> DataFrame:
    """(rank, members, lowest id); the members of a rank stay rows of the node table."""
    return nodes.groupBy("rank").agg(F.countDistinct("tax_id").alias("members"), F.min("tax_id").alias("first_id"))


def class_edges(parents: DataFrame, members: DataFrame) -> DataFrame:
    """Class edges and member edges: class -> parent, and gene:protein -> class for classes in the hierarchy."""
    known = parents.select("class").union(parents.select("parent")).distinct()
    own = members.select(F.concat_ws(":", "gene", "protein").alias("source"), F.col("variant_class").alias("class"))
    return parents.select(F.col("class").alias("source"), F.col("parent").alias("target")).union(
        own.join(known, "class", "left_semi").select("source", F.col("class").alias("target"))
    ).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component), the component being its smallest node.

    Labels spread along edges and then jump to the label of their label, which halves the rounds.
    """
    both = cut_lineage(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("_near"))
        spread = labels.join(near, labels.node == near.a).select("node", F.least("component", "_near").alias("component"))
        spread = cut_lineage(spread)
        target = spread.select(F.col("node").alias("_t"), F.col("component").alias("_jump"))
        jumped = cut_lineage(
            spread.join(target, spread.component == target._t, "left")
            .select("node", F.least("component", F.coalesce("_jump", "component")).alias("component"))
        )
        changed = jumped.join(labels.withColumnRenamed("component", "_old"), "node").filter("component <> _old")
        labels = jumped
        if changed.isEmpty():
            return labels


def mixed_components(labels: DataFrame, donors: DataFrame) -> DataFrame:
    """Components that hold samples of more than one donor; donors is (node, donor)."""
    sized = labels.join(donors, "node").groupBy("component").agg(
        F.countDistinct("donor").alias("donors"), F.count("*").alias("members")
    )
    return sized.filter("donors > 1")
