"""Rounded means at exact ties, in any order of the rows."""

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from helixframe.functions.means import rounded_mean

TIE = [0.01] * 6 + [0.03, 0.08]  # the mean is 0.02125; added up in this order it falls below


@pytest.mark.parametrize("order", [TIE, TIE[::-1], TIE[3:] + TIE[:3]])
def test_a_cell_shows_the_exact_mean(spark, tmp_path, order):
    rows = [(1, 1, x, 0.5) for x in order]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_tax double, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    (row,) = queries()["J27_value_with_p"](spark, str(tmp_path)).collect()
    assert row["cell"] == "0.0213(p=0.5000)"


def test_a_fold_at_a_tie_goes_up(spark, tmp_path):
    # Half a tick above and below zero: 50,000.50 / 10,000 - 5 is 0.00005.
    rows = [(k, 50_000.0 + x, 1.0) for k, sign in ((1, 1), (2, -1), (3, 191)) for x in (0.2 * sign, 0.8 * sign)]
    spark.createDataFrame(rows, "l_partkey long, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "n", 1) for k in (1, 2, 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["gene"]: r["log2fc"] for r in queries()["M20_report"](spark, str(tmp_path)).collect()}
    assert got == {1: "0.0001", 2: "-0.0001", 3: "0.0096"}


@pytest.mark.parametrize("values", [[float("nan"), 1.0], [1e30, 1.0], [1e-30, 3e-30], [None, 2.0], [None, None], [float("inf"), 1.0]])
def test_other_values_keep_the_plain_mean(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ((got, want),) = df.agg(rounded_mean(F.col("v"), 40).alias("a"), F.round(F.avg("v"), 40).alias("b")).collect()
    assert got == want or (got != got and want != want)
