"""Contained changes against all pairs, and a hot gene."""

import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators import relations as rel

TABLE = [(1, "A", "p.Val600Glu"), (2, "A", "p.Val600Lys;x"), (3, "B", "p.Val600Glu"), (4, None, "p.Val600Glu"), (5, "A", None), (6, "C", ""), (7, "C", "any"),
         (1, "A", "p.Val600Glu"), (8, "D", "gly12"), (9, "A", "")]
HOT = [("A", "p.(Val600Glu)"), ("A", "Lys;"), ("A", None), (None, "p.Val600Glu"), ("C", ""), ("D", "Gly12"), ("E", "x")]


@pytest.mark.parametrize("texts_in_task", [1, 20_000])
def test_equals_all_pairs(spark, texts_in_task):
    table = spark.createDataFrame(TABLE, "id int, gene string, change string")
    hot = spark.createDataFrame(HOT, "gene string, phgvs string")
    found = sorted((r.id for r in rel.contained_change(table, hot, texts_in_task).collect()))
    want = sorted(i for i, g, c in TABLE if any(g is not None and g == h and c is not None and p is not None and p.replace("(", "").replace(")", "") in c for h, p in HOT))
    assert found == want == [1, 1, 2, 6, 7]
    assert rel.contained_change(table, hot.limit(0)).count() == 0 and rel.contained_change(table.limit(0), hot).count() == 0


def test_a_hot_gene_is_read_once(spark):
    texts = spark.range(100_000).select(F.lit("G").alias("gene"), F.concat(F.lit("p.Ala"), F.col("id").cast("string"), F.lit("Val")).alias("change"))
    changes = spark.range(10_000).select(F.lit("G").alias("gene"), F.concat(F.lit("(Ala"), (F.col("id") * 10).cast("string"), F.lit("Val)")).alias("phgvs"))
    start = time.monotonic()
    assert rel.contained_change(texts, changes).count() == 10_000
    assert time.monotonic() - start < 60  # a thousand million pairs would take far longer
