"""Matching of sample names, and hierarchy rounds that keep off the driver."""

from helixframe.operators import graph as gr
from helixframe.operators import relations as rel


def test_a_name_is_cut_only_to_lengths_asked_for(spark):
    original = spark.createDataFrame([("abcdef-xx", 3), ("abcxyz-xx", 1), ("abc-xx", 2), ("b", 0)], "sample string, line_no long")
    again = spark.createDataFrame([("abczz",), ("abcdefzz",), ("qqqzz",), ("zz",)], "sample string")
    matched = rel.match_samples(again, original, 2)
    # No row for every prefix of a name.
    assert "sequence(" not in matched._jdf.queryExecution().analyzed().toString()
    got = {r["sample"]: r["original"] for r in matched.collect()}
    # Every name starts with the empty stem of "zz", the earliest line being "b".
    assert got == {"abczz": "abcxyz-xx", "abcdefzz": "abcdef-xx", "qqqzz": None, "zz": "b"}


def test_rounds_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], gr.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(gr, "cut_lineage", seen)
    edges = spark.range(1, 40).selectExpr("id AS node", "id DIV 3 AS parent")
    assert dict(gr.depth(edges).filter("node IN (0, 1, 3, 9, 39)").collect()) == {0: 0, 1: 1, 3: 2, 9: 3, 39: 4}
    assert gr.descendants(edges, spark.createDataFrame([(4,)], "root long")).count() == 1 + 3 + 4
    assert plans and not [p for p in plans if "BroadcastExchange" in p]
